"""Keep an expensive expression from being copied by the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a column that later filters and projections read but never recompute.

    Catalyst pushes filters below a projection by copying its expressions into them. It
    does not do so below a generator, so the value is exploded from a one-element array,
    which stays inside the compiled stage.
    """
    return df.select("*", F.explode(F.array(expression)).alias(name))
