"""The result store: full history, and the newest row per id, both in Parquet.

A batch that is replayed after a lost executor or a restart replaces what it wrote before,
at once for readers (`committed`). The newest rows are a view of the history; compaction
keeps it short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorflow.schemas import RESULT
from sensorflow.sinks import committed, documents

STORED = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        *RESULT.fields,
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("collection", T.StringType()),
    ]
)


def _newer() -> Column:
    """Order of writes: later batch, later window, later arrival; content breaks ties."""
    return F.struct(
        "batch_id",
        F.col("window.end").alias("window_end"),
        "seq",
        "result_kind",
        "result_double",
        "result_string",
        F.to_json("result_event").alias("event"),
    )


def newest(results: DataFrame) -> DataFrame:
    """The last written row per id. Each mapper keeps one row per id before the shuffle."""
    columns = [c for c in results.columns if c not in ("_id", "collection")]
    return (
        results.groupBy("collection", "_id")
        .agg(F.max_by(F.struct(*columns), _newer()).alias("last"))
        .select("_id", "collection", "last.*")
    )


def stamped(results: DataFrame, batch_id: int) -> DataFrame:
    """Identified rows with their batch and the time they are written."""
    return (
        documents.identified(results)
        .withColumn("processed_at", F.current_timestamp())
        .withColumn("batch_id", F.lit(batch_id).cast("long"))
        .select(*STORED.fieldNames())
    )


def write_batch(results: DataFrame, batch_id: int, output: str) -> None:
    """Store one batch, once; an empty one too, for it may replay one whose rows must not stay.

    Rebalancing sizes the files of a collection and splits a collection that holds most
    rows.
    """
    rows = stamped(results, batch_id).hint("rebalance", "collection")
    folder = committed.write(rows, f"{output}/history", batch_id, ["collection"])
    committed.commit(results.sparkSession, f"{output}/history", {batch_id: folder})


def history(spark: SparkSession, output: str) -> DataFrame:
    """Every result row ever written."""
    return committed.read(spark, f"{output}/history", STORED)


def _upto(spark: SparkSession, output: str) -> int:
    """The batch that the compacted table reaches to; -1 before there is one."""
    return max(committed.batches(spark, f"{output}/base"), default=-1)


def latest(spark: SparkSession, output: str) -> DataFrame:
    """The newest row per id, from the compacted table and the batches after it.

    Reading one collection prunes to its folders.
    """
    upto = _upto(spark, output)
    recent = committed.read(spark, f"{output}/history", STORED, lambda b: b > upto)
    if upto < 0:
        return newest(recent)
    return newest(committed.read(spark, f"{output}/base", STORED).unionByName(recent))


def compact(spark: SparkSession, output: str, upto: int) -> None:
    """Write the newest row per id of all batches up to `upto` as one table, and the batches
    it takes in as one batch of the history.

    Run it between batches; what no longer counts goes with `clean`.
    """
    before = _upto(spark, output)
    if before >= upto:
        return
    taken = [b for b in committed.batches(spark, f"{output}/history") if before < b <= upto]
    rows = committed.read(spark, f"{output}/history", STORED, lambda b: b in taken)
    base = rows if before < 0 else committed.read(spark, f"{output}/base", STORED).unionByName(rows)
    kept = newest(base).select(*STORED.fieldNames()).hint("rebalance", "collection")
    folder = committed.write(kept, f"{output}/base", upto, ["collection"])
    if len(taken) > 1:
        merged = committed.write(rows.hint("rebalance", "collection"), f"{output}/history", upto, ["collection"])
        committed.commit(spark, f"{output}/history", {max(taken): merged}, drop=taken)
    committed.commit(spark, f"{output}/base", {upto: folder}, drop=[before])


def clean(spark: SparkSession, output: str, older_than_ms: int = 3_600_000) -> int:
    """Removes files that no longer count and that no reader started before can still use."""
    return sum(committed.clean(spark, f"{output}/{t}", older_than_ms) for t in ("history", "base"))


def upsert_writer(output: str, compact_every: int = 50):
    """A function for `foreachBatch`; every `compact_every` batches the earlier ones are compacted."""

    def write(results: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            compact(results.sparkSession, output, batch_id - 1)
            clean(results.sparkSession, output)
        write_batch(results, batch_id, output)

    return write
