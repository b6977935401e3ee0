"""The jobs registered so far: each config resolved once, when it is registered.

A batch of accepted configs becomes one batch of the registry table, in the form the event
join needs: parameters cast, defaults set, step lists hashed. The rows of a batch that is
replayed replace what it wrote before. Of the registrations of a (sensor, job) the last
one counts, by order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorflow.operators import configs
from sensorflow.schemas import JOB_CONFIG
from sensorflow.sinks import committed
from sensorflow.sources.streams import ARRIVAL

# Registrations that were there before the stream come before all that it brings.
GIVEN = -1


def _resolved(accepted: DataFrame) -> DataFrame:
    return configs.prepared(accepted, carry=("arrival",))


def schema(spark: SparkSession) -> T.StructType:
    nothing = T.StructType([*JOB_CONFIG.fields, T.StructField("arrival", ARRIVAL)])
    return T.StructType([*_resolved(spark.createDataFrame([], nothing)).schema, T.StructField("batch", T.LongType())])


def arrival_of(configs_: DataFrame) -> Column:
    """The order of a config's arrival; configs numbered by `seq` come in that order."""
    if "arrival" in configs_.columns:
        return F.col("arrival").cast(ARRIVAL)
    number = F.col("seq") if "seq" in configs_.columns else F.lit(None)
    return F.struct(
        F.lit(None).cast("timestamp").alias("at"), F.lit("").alias("source"), F.lit(0).cast("long").alias("place"), number.cast("long").alias("line")
    )


def register(accepted: DataFrame, table: str, batch: int = GIVEN) -> None:
    """Adds a batch of accepted configs."""
    spark = accepted.sparkSession
    rows = _resolved(accepted.withColumn("arrival", arrival_of(accepted)))
    folder = committed.write(rows.withColumn("batch", F.lit(batch).cast("long")), table, batch)
    committed.commit(spark, table, {batch: folder})


def create(spark: SparkSession, table: str) -> None:
    """Makes an empty registry where there is none, so that plans look alike before and after."""
    if not committed.version(spark, table):
        folder = committed.write(spark.createDataFrame([], schema(spark)), table, GIVEN)
        committed.commit(spark, table, {GIVEN: folder})


def registrations(spark: SparkSession, table: str) -> DataFrame:
    """Every registration ever made, resolved."""
    return committed.read(spark, table, schema(spark))


def registered(spark: SparkSession, table: str) -> DataFrame:
    """The last registration of each (sensor, job), without its order."""
    rows = registrations(spark, table)
    key = ("routing_sensor", "cfg_job_id")
    rest = [c for c in rows.columns if c not in (*key, "batch", "arrival")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("batch", "arrival")).alias("last"))
    return last.select(*key, "last.*")
