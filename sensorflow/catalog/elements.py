"""Element steps, one job each, and passthrough of what survives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.catalog.common import (
    aggregation,
    element,
    events,
    job,
    passed,
    passed_sql,
    source,
)
from sensorflow.operators import quality
from sensorflow.plans import compiled
from sensorflow.plans.job import Job

MID_JANUARY_MS = 1_705_276_800_000  # 2024-01-15T00:00:00Z


def _passthrough(j: Job, **kind):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return passed(compiled.run_job(events(spark, sf_dir, **kind), j))

    return query


_GREATER = job("greater", element("filter_greater", sensor="click", field="measurement", threshold=50.0))
_LESS = job("less", element("filter_less", sensor="view", threshold="12.5"))
_DATED = job(
    "dated", element("filter_greater", sensor="view", field="datetime", threshold=MID_JANUARY_MS)
)
_CROSS = job(
    "cross",
    element(
        "filter_cross_field",
        filter_sensor="click",
        filter_operator=">",
        filter_threshold=100,
        target_sensor="view",
    ),
)
_CROSS_EQ = job(
    "cross-eq",
    element(
        "filter_cross_field",
        filter_sensor="error",
        filter_operator="=",
        filter_threshold=20.0005,
        target_sensor="signup",
    ),
)
_SCALED = job("scaled", element("normalize", sensor="click", field="measurement", min=10, max=100))
_DEGENERATE = job("degenerate", element("normalize", sensor="click", min=35.0, max=35.0))
_LOWER = job("lower", element("to_lowercase", sensor="view", field="location"))
_UPPER = job("upper", element("to_uppercase", sensor="view"))
_UPPER_SENSOR = job("upper-sensor", element("to_uppercase", sensor="view", field="sensor"))
_TRIM = job("trim", element("trim_whitespace", sensor="view", field="location"))
_CHAIN = job(
    "chain",
    element("trim_whitespace", field="location"),
    element("to_lowercase", field="location"),
    element("filter_greater", sensor="purchase", threshold=20),
    element("normalize", min=0, max=200),
    element("filter_less", threshold=0.5),
)
_MISSED = job(
    "missed",
    element("filter_greater", sensor="click", threshold=40),
    aggregation("max", sensor="view", field="measurement"),
)
_BROKEN = job(
    "broken", element("filter_greater", sensor="click", threshold=150), aggregation("max", field=None)
)

_TRIMMED = r"regexp_replace(location, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiled.run_job(events(spark, sf_dir), _DEGENERATE)
    v = F.col("result_event.measurement")
    return out.select(
        F.col("seq").alias("event_id"),
        F.when(~F.isnan(v), v).alias("measurement"),
        F.isnan(v).alias("is_nan"),
    )


def _surviving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element steps alone, as a filter and projection of the events."""
    kept = compiled.apply_elements(events(spark, sf_dir, dirty=True), _CHAIN)
    return kept.select(
        F.col("arrival_seq").alias("event_id"),
        "sensor",
        F.round("measurement", 6).alias("measurement"),
        "location",
    )


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiled.run_job(events(spark, sf_dir), _BROKEN)
    return out.select(
        "job_id",
        "result_kind",
        "grouping_key",
        "sensor_type",
        "location",
        F.col("result_event").isNull().alias("no_result"),
        F.col("seq").alias("event_id"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, named_sensors=True)
    label = quality.quality_label(F.col("sensor"), F.col("measurement"))
    return e.select(F.col("arrival_seq").alias("event_id"), "sensor", label.alias("data_quality"))


def _clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = quality.clamp_range(events(spark, sf_dir, named_sensors=True))
    return e.select(F.col("arrival_seq").alias("event_id"), "sensor", "measurement")


def _rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    low = quality.round_measurement(F.col("measurement") - F.lit(50.0))
    return e.select(
        F.col("arrival_seq").alias("event_id"),
        quality.round_measurement(F.col("measurement")).alias("measurement"),
        low.alias("shifted"),
    )


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Half of the sensors keep their activity name, which has no unit of its own.
    e = events(spark, sf_dir, named_sensors=True)
    odd = F.col("arrival_seq") % 2 == 1
    mixed = e.withColumn("sensor", F.when(odd, F.col("sensor")).otherwise(F.lit("vibration")))
    return quality.with_unit(mixed).select(
        F.col("arrival_seq").alias("event_id"), "sensor", "measurement_unit"
    )


_CHAIN_WHERE = "sensor = 'purchase' AND measurement > 20 AND least(1.0, measurement / 200) < 0.5"
_NAMED = source(named_sensors=True)

_TOLERANT = job(
    "tolerant",
    element("normalize", sensor="click", min=10, max=110),
    element("to_uppercase", field="location"),
    element("trim_whitespace", field="measurement_unit"),
    element("normalize", field="no such field", min=0, max=1),
)


def _tolerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that meet null, NaN and fields that are not there leave these as they were."""
    gaps = events(spark, sf_dir)
    turn = F.col("arrival_seq") % 4
    gaps = gaps.withColumns(
        {
            "measurement": F.when(turn == 1, F.lit(float("nan"))).when(turn != 0, F.col("measurement")),
            "location": F.when(turn != 2, F.col("location")),
            "measurement_unit": F.when(turn != 3, F.col("measurement_unit")),
        }
    )
    kept = compiled.apply_elements(gaps, _TOLERANT)
    return kept.select(
        F.col("arrival_seq").alias("event_id"),
        F.when(F.isnan("measurement"), "nan").when(F.col("measurement").isNull(), "null").otherwise("number").alias("kind"),
        F.when(~F.isnan("measurement"), F.round("measurement", 6)).alias("measurement"),
        "location",
        "measurement_unit",
    )


QUERIES = {
    "step_tolerance": (
        _tolerated,
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'nan' ELSE 'number' END AS kind, "
        "CASE WHEN event_id % 4 >= 2 THEN round(least(1.0, greatest(0.0, (measurement - 10) / 100)), 6) END AS measurement, "
        "CASE WHEN event_id % 4 <> 2 THEN upper(location) END AS location, "
        f"CASE WHEN event_id % 4 <> 3 THEN unit END AS measurement_unit FROM {source()} WHERE sensor = 'click'",
    ),
    "filter_greater": (
        _passthrough(_GREATER),
        passed_sql("greater", "sensor = 'click' AND measurement > 50"),
    ),
    "filter_less": (
        _passthrough(_LESS),
        passed_sql("less", "sensor = 'view' AND measurement < 12.5"),
    ),
    "filter_datetime": (
        _passthrough(_DATED),
        passed_sql("dated", f"sensor = 'view' AND epoch_us(ts) // 1000 > {MID_JANUARY_MS}"),
    ),
    "filter_cross_field": (
        _passthrough(_CROSS),
        passed_sql("cross", "sensor = 'view' OR (sensor = 'click' AND measurement > 100)"),
    ),
    "filter_cross_field_eq": (
        _passthrough(_CROSS_EQ),
        passed_sql(
            "cross-eq",
            "sensor = 'signup' OR (sensor = 'error' AND abs(measurement - 20.0005) < 0.001)",
        ),
    ),
    "normalize": (
        _passthrough(_SCALED),
        passed_sql(
            "scaled",
            "sensor = 'click'",
            measurement="greatest(0.0, least(1.0, (measurement - 10) / 90))",
        ),
    ),
    "normalize_degenerate": (
        _degenerate,
        "SELECT event_id, CASE WHEN value > 35 THEN 1.0::DOUBLE WHEN value < 35 THEN 0.0::DOUBLE END AS measurement, "
        "value = 35 AS is_nan FROM events WHERE event_type = 'click'",
    ),
    "to_lowercase": (
        _passthrough(_LOWER, dirty=True),
        passed_sql("lower", "sensor = 'view'", location="lower(location)", src=source(dirty=True)),
    ),
    "to_uppercase": (
        _passthrough(_UPPER, dirty=True),
        passed_sql("upper", "sensor = 'view'", location="upper(location)", src=source(dirty=True)),
    ),
    "to_uppercase_sensor": (
        _passthrough(_UPPER_SENSOR),
        passed_sql("upper-sensor", "sensor = 'view'", src=f"(SELECT * REPLACE (sensor AS sensor), upper(sensor) AS loud FROM {source()})", sensor="loud"),
    ),
    "trim_whitespace": (
        _passthrough(_TRIM, dirty=True),
        passed_sql("trim", "sensor = 'view'", location=_TRIMMED, src=source(dirty=True)),
    ),
    "step_chain": (
        _passthrough(_CHAIN, dirty=True),
        passed_sql(
            "chain",
            _CHAIN_WHERE,
            measurement="least(1.0, measurement / 200)",
            location=f"lower({_TRIMMED})",
            src=source(dirty=True),
        ),
    ),
    "surviving_events": (
        _surviving,
        "SELECT event_id, sensor, round(least(1.0, measurement / 200), 6) AS measurement, "
        f"lower({_TRIMMED}) AS location FROM {source(dirty=True)} WHERE {_CHAIN_WHERE}",
    ),
    "fallback_passthrough": (
        _passthrough(_MISSED),
        passed_sql("missed", "sensor = 'click' AND measurement > 40"),
    ),
    "error_results": (
        _errors,
        "SELECT 'broken' AS job_id, 'error' AS result_kind, sensor AS grouping_key, sensor AS sensor_type, "
        f"location, TRUE AS no_result, event_id FROM {source()} WHERE sensor = 'click' AND measurement > 150",
    ),
    "quality_label": (
        _labelled,
        "SELECT event_id, sensor, CASE "
        "WHEN sensor = 'temperature' AND abs(measurement - 22) > 15 THEN 'poor' "
        "WHEN sensor = 'temperature' AND abs(measurement - 22) > 8 THEN 'good' "
        "WHEN sensor = 'humidity' AND (measurement < 20 OR measurement > 80) THEN 'fair' "
        "WHEN sensor = 'air_quality' AND measurement > 150 THEN 'poor' "
        "WHEN sensor = 'air_quality' AND measurement > 100 THEN 'fair' "
        "WHEN sensor = 'noise' AND measurement > 70 THEN 'poor' "
        f"ELSE 'excellent' END AS data_quality FROM {_NAMED}",
    ),
    "clamp_range": (
        _clamped,
        "SELECT event_id, e.sensor, least(hi, greatest(lo, measurement)) AS measurement "
        f"FROM {_NAMED} e JOIN (VALUES ('temperature', -30.0::DOUBLE, 70.0::DOUBLE), ('pressure', 950, 1080), "
        "('humidity', 20, 90), ('air_quality', 0, 200), ('light', 50, 1000), ('noise', 30, 80)) "
        "AS r(sensor, lo, hi) ON e.sensor = r.sensor",
    ),
    "round_measurement": (
        _rounded,
        "SELECT event_id, floor(value * 10 + 0.5) / 10 AS measurement, "
        "floor((value - 50) * 10 + 0.5) / 10 AS shifted FROM events",
    ),
    "unit_lookup": (
        _units,
        "SELECT event_id, s AS sensor, CASE s WHEN 'temperature' THEN 'Celsius' WHEN 'pressure' THEN 'hPa' "
        "WHEN 'humidity' THEN 'percent' WHEN 'air_quality' THEN 'AQI' WHEN 'light' THEN 'lux' "
        "WHEN 'noise' THEN 'dB' ELSE 'units' END AS measurement_unit FROM "
        f"(SELECT event_id, CASE WHEN event_id % 2 = 1 THEN sensor ELSE 'vibration' END AS s FROM {_NAMED})",
    ),
}
