"""Shapes shared by the queries: result rows as flat columns, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.functions import scalars
from sensorflow.plans.job import Job
from sensorflow.session import use_utc
from sensorflow.sources.tables import SENSOR_OF_ACTIVITY, activity_events

HOUR, DAY = 3600, 86_400


def job(job_id: str, *steps: dict) -> Job:
    return Job.from_dict({"jobId": job_id, "transformations": list(steps)})


def element(kind: str, **params) -> dict:
    return {"type": kind, "params": params}


def aggregation(kind: str, key_by: str | None = "location", **params) -> dict:
    return {"type": kind, "keyBy": key_by, "params": params}


def events(spark: SparkSession, sf_dir: str, **kind) -> DataFrame:
    return activity_events(use_utc(spark), sf_dir, **kind)


# Result rows as flat columns ------------------------------------------------


def passed(results: DataFrame) -> DataFrame:
    """Passthrough and error rows."""
    e = F.col("result_event")
    return results.where("result_kind IN ('passthrough', 'error')").select(
        "job_id",
        "result_kind",
        "grouping_field",
        "grouping_key",
        e["sensor"].alias("sensor"),
        F.round(e["measurement"], 6).alias("measurement"),
        e["measurementUnit"].alias("measurement_unit"),
        e["datetime"].alias("datetime"),
        e["location"].alias("location"),
        F.col("seq").alias("event_id"),
    )


def window_start() -> Column:
    return scalars.instant_text(F.col("window.start"))


def windowed(results: DataFrame) -> DataFrame:
    return results.where("result_kind = 'aggregate'").select(
        "job_id",
        window_start().alias("window_start"),
        "grouping_field",
        "grouping_key",
        "aggregation_type",
        "field",
        F.round("result_double", 6).alias("result_double"),
        "result_string",
        "sensor_type",
        "measurement_unit",
        "location",
        F.col("seq").alias("first_event_id"),
    )


# The same in SQL ------------------------------------------------------------


def iso(ts: str) -> str:
    return (
        f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') "
        f"WHEN epoch_us({ts}) % 1000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') END"
    )


_NAMED = " ".join(f"WHEN '{a}' THEN '{s}'" for a, s in SENSOR_OF_ACTIVITY.items())


def source(dirty: bool = False, named_sensors: bool = False) -> str:
    """The activity table as sensor events."""
    room = "'  Room-' || (user_id % 8) || ' ' || chr(9)" if dirty else "'room-' || (user_id % 8)"
    sensor = f"CASE event_type {_NAMED} END" if named_sensors else "event_type"
    return (
        f"(SELECT event_id, ts, {sensor} AS sensor, value AS measurement, 'units' AS unit, "
        f"{iso('ts')} AS datetime, {room} AS location FROM events)"
    )


def passed_sql(
    job_id: str,
    where: str,
    measurement: str = "measurement",
    location: str = "location",
    src: str | None = None,
    sensor: str = "sensor",
) -> str:
    return (
        f"SELECT '{job_id}' AS job_id, 'passthrough' AS result_kind, 'sensor' AS grouping_field, "
        f"{sensor} AS grouping_key, {sensor} AS sensor, round({measurement}, 6) AS measurement, "
        f"unit AS measurement_unit, datetime, {location} AS location, event_id "
        f"FROM {src or source()} WHERE {where}"
    )


_SQL_RESULT = {
    "sum": "round(coalesce(sum({v}), 0.0), 6)",
    "max": "round(coalesce(max({v}), 0.0), 6)",
    "min": "round(coalesce(min({v}), 0.0), 6)",
    "avg": "round(coalesce(sum({v}) / nullif(count({v}), 0), 0.0), 6)",
}


def windowed_sql(
    job_id: str,
    kind: str,
    where: str,
    key_by: str = "location",
    key: str | None = None,
    field: str = "measurement",
    bucket: str = "1 hour",
    value: str = "measurement",
    location: str = "location",
    src: str | None = None,
) -> str:
    result = _SQL_RESULT[kind].format(v=f"({value})")
    text = "CAST(NULL AS VARCHAR)"
    if field == "datetime":
        result, text = "CAST(NULL AS DOUBLE)", iso(f"{kind}(ts)")
    start = f"time_bucket(INTERVAL '{bucket}', ts)"
    grouping = key or (location if key_by == "location" else key_by)
    return (
        f"SELECT '{job_id}' AS job_id, strftime({start}, '%Y-%m-%dT%H:%M:%SZ') AS window_start, "
        f"'{key_by}' AS grouping_field, {grouping} AS grouping_key, '{kind}' AS aggregation_type, "
        f"'{field}' AS field, {result} AS result_double, {text} AS result_string, "
        f"arg_min(sensor, event_id) AS sensor_type, arg_min(unit, event_id) AS measurement_unit, "
        f"arg_min({location}, event_id) AS location, min(event_id) AS first_event_id "
        f"FROM {src or source()} WHERE {where} GROUP BY {start}, {grouping}"
    )


def union_sql(*parts: str) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)
