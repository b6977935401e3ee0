"""Rows that a delay leaves out, kept beside those it lets in.

Spark drops rows whose window the watermark has passed. Here every micro-batch is split
instead: rows in time go to one table, late ones to another, and the watermark, which is
the greatest time of an event so far less the delay, to a third. All three are committed by
batch, and a batch is split by the watermark of the batches before it, so a batch that
is replayed is split alike, and both tables together always hold the input. The split is
a map over the batch; nothing is shuffled. A row without a time is in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorflow.functions import scalars
from sensorflow.functions.vocabulary import DEFAULT_WINDOW_SECONDS
from sensorflow.operators import aggregates
from sensorflow.sinks import committed

MARK = T.StructType([T.StructField("watermark", T.TimestampType())])
SIDES = ("on_time", "late")


def watermark(spark: SparkSession, output: str, before: int | None = None):
    """The time up to which windows are closed, by the batches before one; null at first."""
    marks = committed.read(spark, f"{output}/watermark", MARK, lambda b: before is None or b < before)
    return marks.agg(F.max("watermark")).first()[0]


def is_late(mark, seconds: int) -> Column:
    """Whether the window of an event is closed."""
    end = scalars.window_of(F.col("event_ts"), seconds)["end"]
    return F.coalesce(end <= F.lit(mark).cast("timestamp"), F.lit(False))


def split_batch(rows: DataFrame, batch: int, output: str, seconds: int, delay_seconds: int) -> None:
    """Writes one batch; again with the same number, it replaces what it wrote."""
    spark = rows.sparkSession
    late = is_late(watermark(spark, output, batch), seconds)
    delay = F.expr(f"INTERVAL '{delay_seconds}' SECOND")
    folders = {
        "on_time": committed.write(rows.where(~late), f"{output}/on_time", batch),
        "late": committed.write(rows.where(late), f"{output}/late", batch),
        "watermark": committed.write(
            rows.agg((F.max("event_ts") - delay).alias("watermark")), f"{output}/watermark", batch
        ),
    }
    for table, folder in folders.items():
        committed.commit(spark, f"{output}/{table}", {batch: folder})


def start_split(
    events: DataFrame,
    output: str,
    checkpoint: str,
    delay_seconds: int,
    seconds: int = DEFAULT_WINDOW_SECONDS,
    **trigger,
) -> StreamingQuery:
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(lambda rows, batch: split_batch(rows, batch, output, seconds, delay_seconds))
        .start()
    )


def rows(spark: SparkSession, output: str, side: str, schema: T.StructType) -> DataFrame:
    """One of the SIDES."""
    return committed.read(spark, f"{output}/{side}", schema)


def closed_windows(inputs: DataFrame, mark, seconds: int = DEFAULT_WINDOW_SECONDS) -> DataFrame:
    """Results of the windows that no row in time can still change."""
    windowed = aggregates.aggregate_windows(inputs, seconds)
    return windowed.where(F.col("window.end") <= F.lit(mark).cast("timestamp"))
