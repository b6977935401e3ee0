"""Results as JSON documents, a line each, in one folder per collection.

A write is an upsert by id: of the documents of one id the last written one counts, and
inside a batch the newest result. A replayed batch replaces what it wrote before, at once
for readers (`committed`). Batch and stream write alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorflow.sinks import committed, documents, store

LINES = T.StructType([T.StructField("document", T.StringType()), T.StructField("collection", T.StringType())])


def write_batch(results: DataFrame, batch_id: int, output: str) -> None:
    """Writes the newest result of each id as its document."""
    spark = results.sparkSession
    made = store.newest(store.stamped(results, batch_id)).select(
        documents.result_document(F.col("processed_at")).alias("document"), "collection"
    )
    folder = committed.attempt(batch_id)
    made.hint("rebalance", "collection").write.partitionBy("collection").text(f"{output}/{folder}")
    committed.commit(spark, output, {batch_id: folder})


def _lines(spark: SparkSession, output: str) -> DataFrame:
    reader, chosen = committed.located(spark, output, LINES)
    if not chosen:
        return spark.createDataFrame([], LINES).withColumn("batch", F.lit(0).cast("long"))
    batch = F.regexp_extract("attempt", "^(-?[0-9]+)-", 1).cast("long")
    return reader.text(chosen).select("document", "collection", batch.alias("batch"))


def documents_of(lines: DataFrame) -> DataFrame:
    """The last written document per collection and id."""
    identified = lines.withColumn("_id", F.get_json_object("document", "$._id"))
    return (
        identified.groupBy("collection", "_id")
        .agg(F.max_by(F.struct("document", "batch"), F.struct("batch", "document")).alias("last"))
        .select("collection", "_id", "last.*")
    )


def read(spark: SparkSession, output: str) -> DataFrame:
    """collection, _id, document and batch of what the store holds; one collection prunes to its folders."""
    return documents_of(_lines(spark, output))


def compact(spark: SparkSession, output: str, upto: int) -> None:
    """Writes the documents of all batches up to `upto` as one; run it between batches."""
    taken = [b for b in committed.batches(spark, output) if b <= upto]
    if len(taken) < 2:
        return
    rows = documents_of(_lines(spark, output).where(F.col("batch").isin(taken))).select("document", "collection")
    folder = committed.attempt(max(taken))
    rows.hint("rebalance", "collection").write.partitionBy("collection").text(f"{output}/{folder}")
    committed.commit(spark, output, {max(taken): folder}, drop=taken)


def document_writer(output: str, compact_every: int = 50):
    """A function for `foreachBatch`."""

    def write(results: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            compact(results.sparkSession, output, batch_id - 1)
            committed.clean(results.sparkSession, output, 3_600_000)
        write_batch(results, batch_id, output)

    return write
