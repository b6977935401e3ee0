"""Tables made of batches, of which readers see whole ones only.

Every attempt to write a batch has a folder of its own. A manifest names the folder that
counts for each batch; it is written under another name and then renamed to the next
number, which is one step on any file system. So a reader sees the former or the new
rows of a batch, never half of them, and what no manifest names any more may go. A table
has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEPT_MANIFESTS = 10


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _numbers(spark: SparkSession, table: str) -> list[int]:
    folder, files, _ = _files(spark, f"{table}/manifests")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def version(spark: SparkSession, table: str) -> int:
    """A number that rises with every commit; 0 before the first."""
    return max(_numbers(spark, table), default=0)


def batches(spark: SparkSession, table: str) -> dict[int, str]:
    """The folder that counts for each batch."""
    number = version(spark, table)
    if not number:
        return {}
    path, files, jvm = _files(spark, f"{table}/manifests/{number}.json")
    stream = files.open(path)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(k): v for k, v in json.loads(text).items()}


def _publish(spark: SparkSession, table: str, named: dict[int, str]) -> None:
    number = version(spark, table) + 1
    draft, files, _ = _files(spark, f"{table}/manifests/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(named, sort_keys=True).encode()))
    out.close()
    final, _, _ = _files(spark, f"{table}/manifests/{number}.json")
    if not files.rename(draft, final):
        raise RuntimeError(f"another writer has committed version {number} of {table}")


ATTEMPT = T.StructField("attempt", T.StringType())


def attempt(batch: int) -> str:
    """A new folder for an attempt to write a batch."""
    return f"batches/attempt={batch}-{uuid.uuid4().hex}"


def write(frame: DataFrame, table: str, batch: int, partition_by: Sequence[str] = ()) -> str:
    """The rows in a folder of their own, which no reader sees before `commit`."""
    folder = attempt(batch)
    frame.write.partitionBy(*partition_by).parquet(f"{table}/{folder}")
    return folder


def commit(spark: SparkSession, table: str, folders: dict[int, str], drop: Sequence[int] = ()) -> None:
    """From now on these folders count for their batches; the batches in `drop` don't count."""
    named = {k: v for k, v in batches(spark, table).items() if k not in drop}
    _publish(spark, table, named | folders)


def located(spark: SparkSession, table: str, schema: T.StructType, only=lambda batch: True):
    """(reader, folders) of all batches, or of some; the rows have their `attempt` as well."""
    chosen = [f"{table}/{f}" for b, f in sorted(batches(spark, table).items()) if only(b)]
    whole = T.StructType([*schema.fields, ATTEMPT])
    return spark.read.schema(whole).option("basePath", f"{table}/batches"), chosen


def read(spark: SparkSession, table: str, schema: T.StructType, only=lambda batch: True) -> DataFrame:
    """The rows of all batches, or of some."""
    reader, chosen = located(spark, table, schema, only)
    if not chosen:
        return spark.createDataFrame([], schema)
    return reader.parquet(*chosen).select(*schema.fieldNames())


def clean(spark: SparkSession, table: str, older_than_ms: int) -> int:
    """Removes folders and manifests that no longer count and are older than that; how many."""
    named = set(batches(spark, table).values())
    removed = 0
    now = int(spark.sparkContext._jvm.java.lang.System.currentTimeMillis())
    folder, files, _ = _files(spark, f"{table}/batches")
    for status in files.listStatus(folder) if files.exists(folder) else ():
        old = now - status.getModificationTime() > older_than_ms
        if old and f"batches/{status.getPath().getName()}" not in named:
            files.delete(status.getPath(), True)
            removed += 1
    for number in _numbers(spark, table)[:-KEPT_MANIFESTS]:
        path, files, _ = _files(spark, f"{table}/manifests/{number}.json")
        files.delete(path, False)
    return removed
