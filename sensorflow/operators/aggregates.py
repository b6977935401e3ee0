"""Windowed aggregation of aggregation inputs.

Inputs are rows with the group columns, `value` (or `value_ts` for the datetime field),
the context columns and `arrival_seq`. Every aggregation type is a Column over one small
accumulator, so batch plans, event-time streams and timer-driven windows finish alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.functions import scalars
from sensorflow.schemas import RESULT

GROUP = ("job_id", "grouping_field", "grouping_key", "aggregation_type", "field")
CONTEXT = ("sensor", "measurement_unit", "location", "steps_hash")

INF = float("inf")
# Stands for the arrival order of a row that has none.
UNORDERED = (1 << 63) - 1


def _unless(v: Column, extreme: float) -> Column:
    return F.coalesce(F.when(v != F.lit(extreme), v), F.lit(0.0))


# Aggregation type -> result, over the accumulator columns total, n, low, high.
AGGREGATES: dict[str, Callable[[], Column]] = {
    "sum": lambda: F.coalesce(F.col("total"), F.lit(0.0)),
    "max": lambda: _unless(F.col("high"), -INF),
    "min": lambda: _unless(F.col("low"), INF),
    "avg": lambda: F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(0.0)),
}


def register_aggregate(name: str, result: Callable[[], Column]) -> None:
    """Add an aggregation type as a Column over total, n, low and high."""
    AGGREGATES[name] = result


def accumulators() -> list[Column]:
    """First-level accumulator. All buffers are fixed-width, which keeps Spark's hash aggregate."""
    v = F.col("value")
    number = F.when(~F.isnan(v), v)
    return [
        F.sum(v).alias("total"),
        F.count(v).alias("n"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.min("value_ts").alias("low_ts"),
        F.max("value_ts").alias("high_ts"),
    ]


def merged_accumulators() -> list[Column]:
    return [
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("low_ts").alias("low_ts"),
        F.max("high_ts").alias("high_ts"),
    ]


def first_context(seq: str, context: Sequence[str] = CONTEXT) -> Column:
    """Context columns of the earliest row.

    Rows without an order of arrival come last. Of rows that arrived together, or of which
    none has an order, the one with the least values counts, null before all, so that
    partial results merge to one context in any order.
    """
    arrival = F.coalesce(F.col(seq), F.lit(UNORDERED)).alias("seq")
    return F.min_by(F.struct(*context), F.struct(arrival, *context)).alias("context")


def partial_windows(inputs: DataFrame, seconds: int) -> DataFrame:
    """First level of `aggregate_windows`: an accumulator per window, group and context."""
    windowed = inputs.withColumn("window", scalars.window_of(F.col("event_ts"), seconds))
    return windowed.groupBy("window", *GROUP, *CONTEXT).agg(*accumulators(), F.min("arrival_seq").alias("seq"))


def merge_windows(partial: DataFrame) -> DataFrame:
    """Second level: one result row per window and group."""
    merged = partial.groupBy("window", *GROUP).agg(
        *merged_accumulators(), first_context("seq"), F.min("seq").alias("seq")
    )
    return finish(merged.select("*", "context.*").drop("context"))


def aggregate_windows(inputs: DataFrame, seconds: int) -> DataFrame:
    """Batch form: window over event time, one row per window and group.

    Two levels. The first groups by the context columns too and holds only numbers, so
    each mapper folds its rows, hot groups included, in a hash aggregate before the
    shuffle. The second sees a few rows per group and picks the first context.
    """
    return merge_windows(partial_windows(inputs, seconds))


def finish(acc: DataFrame) -> DataFrame:
    """Accumulator rows to result rows (without the step list, which joins on its hash)."""
    kind = F.col("aggregation_type")
    on_clock = F.col("field") == "datetime"
    number = F.lit(None).cast("double")
    for name, result in AGGREGATES.items():
        number = F.when(kind == name, result()).otherwise(number)
    clock = F.when(kind == "max", F.col("high_ts")).when(kind == "min", F.col("low_ts"))
    values = {
        "result_kind": F.lit("aggregate"),
        "result_double": F.when(~F.coalesce(on_clock, F.lit(False)), number),
        "result_string": F.when(on_clock, scalars.instant_text(clock)),
        "sensor_type": F.col("sensor"),
    }
    ready = {*acc.columns}
    return acc.select(
        *[
            values.get(f.name, F.col(f.name) if f.name in ready else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in RESULT
        ]
    )
