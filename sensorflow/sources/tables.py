"""Sensor events from the activity table (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.functions import scalars
from sensorflow.schemas import EVENT_COLUMNS

ROOMS = 8

# Activity types stand for sensors where rules depend on a sensor's name.
SENSOR_OF_ACTIVITY = {
    "click": "temperature",
    "view": "humidity",
    "purchase": "air_quality",
    "signup": "pressure",
    "error": "noise",
}


def instant_of(naive: Column) -> Column:
    """A zone-less timestamp read as UTC, whatever zone the session has."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, naive))


def activity_columns(dirty: bool = False, named_sensors: bool = False) -> dict[str, Column]:
    room = F.concat(F.lit("room-"), F.pmod(F.col("user_id"), F.lit(ROOMS)).cast("string"))
    if dirty:
        room = F.concat(F.lit("  R"), F.substring(room, 2, 20), F.lit(" \t"))
    sensor = F.col("event_type")
    if named_sensors:
        sensor = F.lit(None)
        for activity, name in SENSOR_OF_ACTIVITY.items():
            sensor = F.when(F.col("event_type") == activity, F.lit(name)).otherwise(sensor)
    ts = instant_of(F.col("ts"))
    return {
        "job_id": F.lit(None).cast("string"),
        "sensor": sensor,
        "measurement": F.col("value"),
        "measurement_unit": F.lit("units"),
        "datetime": scalars.instant_text(ts),
        "location": room,
        "data_quality": F.lit(None).cast("string"),
        "event_ts": ts,
        "arrival_seq": F.col("event_id"),
    }


def activity_events(
    spark: SparkSession, sf_dir: str, dirty: bool = False, named_sensors: bool = False
) -> DataFrame:
    columns = activity_columns(dirty, named_sensors)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        *[columns[c].alias(c) for c in EVENT_COLUMNS]
    )
