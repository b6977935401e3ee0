"""Tumbling windows over the clock of the stream, closed by timers.

Timers fire when a window's end has passed, with or without further input. Rows are folded
per Arrow batch before the shuffle, so a group that holds most rows reaches its state as a
few partial accumulators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorflow.operators import aggregates
from sensorflow.streaming.processors import (
    MAX_LONG,
    MIN_LONG,
    NUMBERS,
    ClockWindows,
    batch_fold,
    text_fields,
)

def _as_partials(inputs: DataFrame, context: Sequence[str]) -> DataFrame:
    """Each input row as an accumulator of one row; nothing in it is null but text."""
    v = F.col("value")
    number = v.isNotNull() & ~F.isnan(v)
    return inputs.select(
        *aggregates.GROUP,
        F.when(number, v).otherwise(0.0).alias("total"),
        F.when(v.isNotNull() & F.isnan(v), 1).otherwise(0).cast("long").alias("nans"),
        F.when(v.isNotNull(), 1).otherwise(0).cast("long").alias("n"),
        F.when(number, v).otherwise(aggregates.INF).alias("low"),
        F.when(number, v).otherwise(-aggregates.INF).alias("high"),
        F.coalesce(F.unix_micros("value_ts"), F.lit(MAX_LONG)).alias("low_us"),
        F.coalesce(F.unix_micros("value_ts"), F.lit(MIN_LONG)).alias("high_us"),
        F.coalesce("arrival_seq", F.lit(MAX_LONG)).alias("seq"),
        *context,
    )


def clock_windows(
    inputs: DataFrame, seconds: int, context: Sequence[str] = aggregates.CONTEXT
) -> DataFrame:
    """One accumulator row per window of arrival and group."""
    partials = _as_partials(inputs, context)
    folded = partials.mapInPandas(batch_fold(aggregates.GROUP), partials.schema)
    emitted = T.StructType(
        [
            *text_fields(aggregates.GROUP),
            T.StructField("start_us", T.LongType()),
            *NUMBERS,
            *text_fields(context),
        ]
    )
    closed = folded.groupBy(*aggregates.GROUP).transformWithStateInPandas(
        ClockWindows(seconds, aggregates.GROUP, context), emitted, "Append", "ProcessingTime"
    )
    width = F.lit(seconds * 1_000_000)

    def stamp(us: str, none: int):
        return F.when(F.col(us) != none, F.timestamp_micros(us))

    return closed.select(
        *aggregates.GROUP,
        F.struct(
            F.timestamp_micros("start_us").alias("start"),
            F.timestamp_micros(F.col("start_us") + width).alias("end"),
        ).alias("window"),
        F.when(F.col("nans") > 0, F.lit(float("nan"))).otherwise(F.col("total")).alias("total"),
        "n",
        "low",
        "high",
        stamp("low_us", MAX_LONG).alias("low_ts"),
        stamp("high_us", MIN_LONG).alias("high_ts"),
        F.when(F.col("seq") != MAX_LONG, F.col("seq")).alias("seq"),
        *context,
    )
