"""Windowed aggregations, group keys, context and many jobs at once."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.catalog.common import (
    DAY,
    HOUR,
    aggregation,
    element,
    events,
    job,
    passed_sql,
    source,
    union_sql,
    window_start,
    windowed,
    windowed_sql,
)
from sensorflow.operators import aggregates, configs, steps
from sensorflow.plans import compiled, data_driven, indexed
from sensorflow.plans.job import Job, jobs_frame, load_jobs
from sensorflow.schemas import STEPS

JOB_FILES = Path(__file__).resolve().parents[2] / "jobs"


def _windows(j: Job, seconds: int, **kind):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windowed(compiled.run_job(events(spark, sf_dir, **kind), j, seconds))

    return query


def _by_location(kind: str) -> Job:
    return job(
        f"hourly-{kind}",
        element("filter_greater", sensor="click", threshold=5.0),
        aggregation(kind, sensor="click", field="measurement"),
    )


MAX_BY_LOCATION = _by_location("max")
_HOURLY = {kind: _by_location(kind) for kind in ("sum", "max", "min", "avg")}
_DAILY_AVG = job(
    "daily-avg",
    element("normalize", min=0, max=100),
    aggregation("avg", key_by=None, sensor="purchase"),
)
_LATEST_TIME = job(
    "latest-time",
    element("filter_less", sensor="view", threshold=30),
    aggregation("max", sensor="view", field="datetime"),
    aggregation("min", sensor="view", field="datetime"),
)
_NO_VALUES = job(
    "no-values",
    *[aggregation(k, sensor="error", field="voltage") for k in ("sum", "max", "min", "avg")],
)
_BY_SENSOR = job("by-sensor", aggregation("sum", key_by="sensor", sensor="signup"))
_KEYS = {
    "sensor": "sensor",
    "measurement": "CAST(measurement AS VARCHAR)",
    "measurement_unit": "unit",
    "datetime": "datetime",
    "location": "location",
    "data_quality": "'unknown'",
    "jobId": "'unknown'",
    "altitude": "'unknown'",
}
_EACH_KEY = job(
    "each-key", *[aggregation("max", key_by=k, sensor="view", field="measurement") for k in _KEYS]
)
_FANOUT = job(
    "fanout",
    element("filter_greater", sensor="view", threshold=10),
    aggregation("max", key_by="location", sensor="view"),
    aggregation("avg", key_by="sensor"),
    aggregation("sum", key_by="location", sensor="click"),
)


def _hourly_sql(kind: str) -> str:
    return windowed_sql(f"hourly-{kind}", kind, "sensor = 'click' AND measurement > 5")


def _flat(results: DataFrame) -> DataFrame:
    """Every kind of result row in one shape."""
    direct = F.col("result_kind") == "passthrough"
    e = F.col("result_event")
    return results.select(
        "job_id",
        "grouping_key",
        "location",
        window_start().alias("window_start"),
        "aggregation_type",
        F.round(F.when(direct, e["measurement"]).otherwise(F.col("result_double")), 6).alias("result_double"),
        F.when(direct, e["datetime"]).otherwise(F.col("result_string")).alias("result_string"),
        F.col("seq").alias("event_id"),
    )


def _flat_windows_sql(*args, **kwargs) -> str:
    return (
        "SELECT job_id, grouping_key, location, window_start, aggregation_type, result_double, "
        f"result_string, first_event_id AS event_id FROM ({windowed_sql(*args, **kwargs)})"
    )


def _flat_passed_sql(*args, **kwargs) -> str:
    return (
        "SELECT job_id, grouping_key, location, CAST(NULL AS VARCHAR) AS window_start, "
        "CAST(NULL AS VARCHAR) AS aggregation_type, measurement AS result_double, "
        f"datetime AS result_string, event_id FROM ({passed_sql(*args, **kwargs)})"
    )


_DIRTY_NAMED = source(dirty=True, named_sensors=True)
_SCALED = "greatest(0.0, least(1.0, measurement / 100))"

_TIDY = r"upper(regexp_replace(location, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'))"


def _share(low: int, width: int) -> str:
    return f"greatest(0.0, least(1.0, (measurement - {low}) / {width}))"


ALL_JOBS_SQL = union_sql(
    _flat_windows_sql("stale-air-peaks", "max", "sensor = 'air_quality' AND measurement > 85.5", src=_DIRTY_NAMED),
    _flat_windows_sql("damp-corners", "avg", "sensor = 'humidity' AND measurement > 62.5", src=_DIRTY_NAMED),
    _flat_windows_sql("bright-spots", "min", "sensor = 'light' AND measurement > 140", src=_DIRTY_NAMED),
    _flat_windows_sql("dry-spell-start", "min", "sensor = 'humidity' AND measurement < 18.25", field="datetime", src=_DIRTY_NAMED),
    _flat_windows_sql("loudest-moments", "max", "sensor = 'noise' AND measurement > 33.5", src=_DIRTY_NAMED),
    _flat_windows_sql("humidity-share", "max", "sensor = 'humidity'", value=_share(20, 200), src=_DIRTY_NAMED),
    _flat_windows_sql("pressure-floor", "min", "sensor = 'pressure' AND measurement < 512", src=_DIRTY_NAMED),
    _flat_windows_sql("tidy-light-average", "avg", "sensor = 'light'", location=_TIDY, src=_DIRTY_NAMED),
    _flat_passed_sql("warm-readings", "sensor = 'temperature' AND measurement > 17.5", src=_DIRTY_NAMED),
    _flat_passed_sql("dim-readings", "sensor = 'light' AND measurement < 75.5", src=_DIRTY_NAMED),
    _flat_passed_sql("noise-share", "sensor = 'noise'", measurement=_share(10, 200), src=_DIRTY_NAMED),
    _flat_passed_sql("tidy-pressure-places", "sensor = 'pressure'", location=_TIDY, src=_DIRTY_NAMED),
    _flat_passed_sql("noise-without-light", "sensor = 'noise' AND measurement > 44", src=_DIRTY_NAMED),
)


def _all_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, dirty=True, named_sensors=True)
    return _flat(compiled.run_jobs(e, load_jobs(JOB_FILES), HOUR))


def _all_data_driven(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, dirty=True, named_sensors=True)
    return _flat(data_driven.run(e, jobs_frame(spark, load_jobs(JOB_FILES)), HOUR))


_PAIR_JOBS = [
    job("p1", element("filter_greater", sensor="click", threshold=1)),
    job("p2", aggregation("max", sensor="click")),
    job("p3", element("trim_whitespace", field="location"), aggregation("sum", sensor="view")),
    job("p4", element("filter_less", sensor="missing", threshold=1)),
]


def _pairs(broadcast_bytes: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = events(spark, sf_dir)
        ready = configs.prepared(jobs_frame(spark, _PAIR_JOBS))
        joined = data_driven.join_configs(e, ready, broadcast_bytes=broadcast_bytes)
        return joined.select(
            F.col("cfg_job_id").alias("job_id"), "sensor", F.col("arrival_seq").alias("event_id")
        )

    return query


_PAIRS_SQL = (
    "SELECT job_id, sensor, event_id FROM (SELECT event_type AS sensor, event_id FROM events) e "
    "JOIN (VALUES ('p1', 'click'), ('p2', 'click'), ('p3', 'view'), ('p4', 'missing')) AS c(job_id, s) "
    "ON e.sensor = c.s"
)


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements, direct rows and windows of two jobs in one table."""
    jobs = [MAX_BY_LOCATION, job("greater", element("filter_greater", sensor="view", threshold=100))]
    results = compiled.run_jobs(events(spark, sf_dir), jobs, DAY).unionByName(
        configs.config_acks(jobs_frame(spark, jobs))
    )
    return results.groupBy("job_id", "result_kind").agg(
        F.count("*").alias("n"), F.round(F.sum("result_double"), 6).alias("total")
    )


_EACH_KIND = job("each-kind", *[aggregation(k, sensor="click") for k in ("sum", "max", "min", "avg")])


def _with_nans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh measurement is no number: extremes pass it by, sums and means carry it."""
    spoilt = F.when(F.col("arrival_seq") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("measurement"))
    e = events(spark, sf_dir).withColumn("measurement", spoilt)
    r = F.col("result_double")
    return compiled.run_jobs(e, [_EACH_KIND], HOUR).select(
        "aggregation_type",
        "grouping_key",
        F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.isnan(r).alias("is_nan"),
        F.when(F.col("aggregation_type").isin("max", "min"), r).alias("extreme"),
    )


_WITH_NANS_SQL = union_sql(
    *[
        f"SELECT '{kind}' AS aggregation_type, 'room-' || (user_id % 8) AS grouping_key, "
        "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, "
        + ("FALSE" if kind in ("max", "min") else "count(*) FILTER (event_id % 11 = 0) > 0")
        + " AS is_nan, "
        + (f"coalesce({kind}(value) FILTER (event_id % 11 <> 0), 0.0)" if kind in ("max", "min") else "CAST(NULL AS DOUBLE)")
        + " AS extreme FROM events WHERE event_type = 'click' GROUP BY user_id % 8, date_trunc('hour', ts)"
        for kind in ("sum", "max", "min", "avg")
    ]
)


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step and an aggregation that a user has added, in one job."""
    steps.register_step("multiply", lambda row, p: row.having(measurement=row.fields["measurement"] * p.number("by")))
    aggregates.register_aggregate("span", lambda: F.col("high") - F.col("low"))
    try:
        added = job("added", element("multiply", sensor="view", by=2), aggregation("span", sensor="view"))
        found = compiled.run_jobs(events(spark, sf_dir), [added], DAY)
    finally:
        del steps.STEP_BUILDERS["multiply"], aggregates.AGGREGATES["span"]
    return found.select(
        "aggregation_type",
        "grouping_key",
        F.date_format("window.start", "yyyy-MM-dd").alias("day"),
        F.round("result_double", 6).alias("span"),
    )


_UNION_SQL = union_sql(
    "SELECT job_id, 'aggregate' AS result_kind, count(*) AS n, round(sum(result_double), 6) AS total FROM ("
    + windowed_sql("hourly-max", "max", "sensor = 'click' AND measurement > 5", bucket="1 day")
    + ") GROUP BY job_id",
    "SELECT 'greater' AS job_id, 'passthrough' AS result_kind, count(*) AS n, CAST(NULL AS DOUBLE) AS total "
    "FROM events WHERE event_type = 'view' AND value > 100",
    "SELECT job_id, 'ack' AS result_kind, 1 AS n, CAST(NULL AS DOUBLE) AS total "
    "FROM (VALUES ('hourly-max'), ('greater')) AS t(job_id)",
)


_ANY_SENSOR = job("any-order", aggregation("sum", key_by="sensor", sensor="signup"))


def _unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which many arrived together, and some have no order of arrival at all."""
    seq = F.col("arrival_seq")
    order = F.when(F.dayofmonth("event_ts") % 3 == 0, F.lit(None)).when(seq % 2 == 0, F.floor(seq / 1000))
    rows = events(spark, sf_dir).withColumn("arrival_seq", order.cast("long"))
    return windowed(compiled.run_job(rows, _ANY_SENSOR, DAY))


_UNORDERED_SQL = f"""
WITH o AS (
  SELECT *, time_bucket(INTERVAL '1 day', ts) AS start,
    CASE WHEN day(ts) % 3 <> 0 AND event_id % 2 = 0 THEN event_id // 1000 END AS seq FROM {source()} WHERE sensor = 'signup')
SELECT 'any-order' AS job_id, strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS window_start, 'sensor' AS grouping_field,
  sensor AS grouping_key, 'sum' AS aggregation_type, 'measurement' AS field, round(sum(measurement), 6) AS result_double,
  CAST(NULL AS VARCHAR) AS result_string, sensor AS sensor_type, 'units' AS measurement_unit,
  first(location ORDER BY seq NULLS LAST, location) AS location, min(seq) AS first_event_id FROM o GROUP BY start, sensor
"""

_SENSORS = ("click", "view", "purchase", "signup", "error")


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per customer, each with its own threshold; every third one aggregates."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    sensor = F.element_at(F.array(*map(F.lit, _SENSORS)), (F.col("k") % 5 + 1).cast("int"))
    turn = F.col("k") % 3
    limit = F.when(turn == 1, F.col("k") % 10 / 100 + 0.02).otherwise(F.col("k") % 100 + 330.0)

    def step(kind, params, key_by=None):
        named = F.create_map(*[x for n, v in params.items() for x in (F.lit(n), v.cast("string"))])
        return F.struct(kind.alias("type"), named.alias("params"), F.lit(key_by).cast("string").alias("keyBy"))

    own = {"sensor": sensor, "threshold": limit}
    first = step(F.when(turn == 1, "filter_less").otherwise("filter_greater"), own)
    last = step(F.lit("max"), {"sensor": sensor}, "location")
    jobs = customers.select(
        F.concat(F.lit("customer-"), F.col("k").cast("string")).alias("jobId"),
        F.when(turn == 2, F.array(first, last)).otherwise(F.array(first)).cast(STEPS).alias("transformations"),
        F.col("k").alias("seq"),
    )
    results = indexed.run(events(spark, sf_dir), jobs, DAY)
    return results.select(
        "job_id",
        "result_kind",
        window_start().alias("window_start"),
        "grouping_key",
        F.round(F.coalesce("result_double", "result_event.measurement"), 6).alias("result"),
        F.col("transformations")[0]["params"]["threshold"].try_cast("double").alias("threshold"),
        F.col("seq").alias("event_id"),
    )


_MANY_SQL = f"""
WITH j AS (
  SELECT 'customer-' || c_custkey AS job_id, c_custkey % 3 AS turn,
    ['click', 'view', 'purchase', 'signup', 'error'][c_custkey % 5 + 1] AS own,
    CASE c_custkey % 3 WHEN 1 THEN (c_custkey % 10) / 100 + 0.02::DOUBLE ELSE c_custkey % 100 + 330.0::DOUBLE END AS threshold
  FROM customer),
p AS (
  SELECT j.*, e.* FROM j JOIN {source()} AS e ON e.sensor = j.own
    AND CASE turn WHEN 1 THEN measurement < threshold ELSE measurement > threshold END)
SELECT job_id, 'passthrough' AS result_kind, CAST(NULL AS VARCHAR) AS window_start, sensor AS grouping_key,
  round(measurement, 6) AS result, threshold, event_id FROM p WHERE turn < 2
UNION ALL SELECT job_id, 'aggregate', strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%dT%H:%M:%SZ'), location,
  round(max(measurement), 6), any_value(threshold), min(event_id) FROM p WHERE turn = 2
GROUP BY job_id, time_bucket(INTERVAL '1 day', ts), location
"""


QUERIES = {
    **{
        f"agg_{kind}": (_windows(_HOURLY[kind], HOUR), _hourly_sql(kind))
        for kind in ("sum", "max", "min", "avg")
    },
    "agg_max_ten_seconds": (
        _windows(MAX_BY_LOCATION, 10),
        windowed_sql("hourly-max", "max", "sensor = 'click' AND measurement > 5", bucket="10 seconds"),
    ),
    "agg_avg_daily_normalized": (
        _windows(_DAILY_AVG, DAY),
        windowed_sql("daily-avg", "avg", "sensor = 'purchase'", key_by="sensor", bucket="1 day", value=_SCALED),
    ),
    "agg_max_datetime": (
        _windows(_LATEST_TIME, HOUR),
        union_sql(
            windowed_sql("latest-time", "max", "sensor = 'view' AND measurement < 30", field="datetime"),
            windowed_sql("latest-time", "min", "sensor = 'view' AND measurement < 30", field="datetime"),
        ),
    ),
    "agg_empty_default": (
        _windows(_NO_VALUES, DAY),
        union_sql(
            *[
                windowed_sql("no-values", k, "sensor = 'error'", field="voltage", bucket="1 day", value="NULL::DOUBLE")
                for k in ("sum", "max", "min", "avg")
            ]
        ),
    ),
    "agg_context_first": (
        _windows(_BY_SENSOR, DAY),
        windowed_sql("by-sensor", "sum", "sensor = 'signup'", key_by="sensor", bucket="1 day"),
    ),
    "group_keys_each": (
        _windows(_EACH_KEY, DAY),
        union_sql(
            *[
                windowed_sql("each-key", "max", "sensor = 'view'", key_by=k, key=sql, bucket="1 day")
                for k, sql in _KEYS.items()
            ]
        ),
    ),
    "multi_agg_fanout": (
        _windows(_FANOUT, HOUR),
        union_sql(
            windowed_sql("fanout", "max", "sensor = 'view' AND measurement > 10"),
            windowed_sql("fanout", "avg", "sensor = 'view' AND measurement > 10", key_by="sensor"),
        ),
    ),
    "multi_job_join": (_pairs(data_driven.BROADCAST_BYTES), _PAIRS_SQL),
    "multi_job_join_shuffled": (_pairs(0), _PAIRS_SQL),
    "union_results": (_union, _UNION_SQL),
    "agg_with_nans": (_with_nans, _WITH_NANS_SQL),
    "registered_step_and_aggregate": (
        _registered,
        "SELECT 'span' AS aggregation_type, 'room-' || (user_id % 8) AS grouping_key, strftime(ts, '%Y-%m-%d') AS day, "
        "round(max(value * 2) - min(value * 2), 6) AS span FROM events WHERE event_type = 'view' GROUP BY 2, 3",
    ),
    "agg_context_unordered": (_unordered, _UNORDERED_SQL),
    "many_jobs": (_many, _MANY_SQL),
    "compiled_all_jobs": (_all_compiled, ALL_JOBS_SQL),
    "data_driven_all_jobs": (_all_data_driven, ALL_JOBS_SQL),
}
