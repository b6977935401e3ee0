"""Session settings the library relies on, and the folder for written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Settings worth having in every session; none of them changes a result.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    # Plans are built from many small Columns; recording a call site for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def use_utc(spark: SparkSession) -> SparkSession:
    """Times in events are instants; text forms of them are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, on every master by the same rule.

    It lies below the folder of `spark.checkpoint.dir`, else below the warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Whether the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle goes when they end; else it stays until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table below the work folder: computed once, of a true size."""
    spark = rows.sparkSession
    folder = work_dir(spark, name)
    with shuffles_dropped(spark):
        rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)
