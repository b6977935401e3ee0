"""Tumbling windows over event time on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.operators import aggregates


def event_time_windows(
    inputs: DataFrame, seconds: int, context: Sequence[str] = aggregates.CONTEXT
) -> DataFrame:
    """One accumulator row per window and group, from a stream that carries a watermark.

    Spark folds each micro-batch per group before the shuffle, so a group that holds most
    rows sends one row per task.
    """
    grouped = inputs.groupBy(F.window("event_ts", f"{seconds} seconds"), *aggregates.GROUP)
    acc = grouped.agg(
        *aggregates.accumulators(),
        aggregates.first_context("arrival_seq", context),
        F.min("arrival_seq").alias("seq"),
    )
    return acc.select("*", "context.*").drop("context")
