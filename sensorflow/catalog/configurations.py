"""Config operators over registration logs derived from the activity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.operators import configs
from sensorflow.plans import data_driven
from sensorflow.schemas import EVENT_COLUMNS, STEPS
from sensorflow.session import use_utc
from sensorflow.sources.tables import activity_columns, instant_of


def _step(kind: Column, params: dict[str, Column], key_by: Column | None = None) -> Column:
    pairs = [x for n, v in params.items() for x in (F.lit(n), v.cast("string"))]
    return F.struct(
        kind.cast("string").alias("type"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("params"),
        (key_by if key_by is not None else F.lit(None)).cast("string").alias("keyBy"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")


def registrations(rows: DataFrame, jobs: int = 4) -> DataFrame:
    """Each activity row registers a threshold job for its own sensor."""
    steps = F.array(
        _step(F.lit("filter_greater"), {"sensor": F.col("event_type"), "threshold": F.col("value")})
    )
    return rows.select(
        F.concat(F.lit("job-"), (F.col("user_id") % jobs).cast("string")).alias("jobId"),
        steps.cast(STEPS).alias("transformations"),
        F.lit(None).cast("string").alias("outputTopic"),
        F.col("event_id").alias("seq"),
        instant_of(F.col("ts")).alias("registered_at"),
    )


def _faulty(rows: DataFrame) -> DataFrame:
    """Registrations of which some are unsound, each in its own way."""
    fault = F.col("event_id") % 9
    sensor = F.when(fault != 3, F.col("event_type"))
    threshold = (
        F.when(fault == 4, F.lit("abc"))
        .when(fault == 5, F.lit(None))
        .otherwise(F.col("value").cast("string"))
    )
    first = _step(
        F.when(fault == 2, F.lit("median")).otherwise(F.lit("filter_greater")),
        {"sensor": sensor, "threshold": threshold},
    )
    second = _step(
        F.lit("sum"),
        {
            "field": F.when(fault == 6, F.lit("location")).when(fault == 7, F.lit("datetime"))
            .otherwise(F.lit("measurement")),
            "sensor": sensor,
        },
        F.lit("location"),
    )
    return rows.select(
        F.when(fault == 0, F.lit(" \t"))
        .when(fault == 1, F.lit(None))
        .otherwise(F.concat(F.lit("job-"), F.col("user_id").cast("string")))
        .alias("jobId"),
        F.array(first, second).cast(STEPS).alias("transformations"),
        F.col("event_id").alias("seq"),
    )


def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = configs.with_rejection(_faulty(activity(spark, sf_dir)))
    return checked.select(F.col("seq").alias("event_id"), F.coalesce("reason", F.lit("accepted")).alias("reason"))


def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sensor in list order decides, wherever in the list it stands."""
    turn = F.col("event_id") % 3
    steps = F.array(
        _step(F.lit("normalize"), {"min": F.lit(0), "max": F.lit(1), "sensor": F.when(turn == 0, F.col("event_type"))}),
        _step(
            F.lit("filter_cross_field"),
            {"filter_sensor": F.lit("noise"), "target_sensor": F.lit("light"), "filter_threshold": F.lit(1)},
        ),
        _step(F.lit("max"), {"sensor": F.when(turn == 1, F.lit("humidity"))}),
    ).cast(STEPS)
    return activity(spark, sf_dir).select(
        "event_id",
        configs.routing_key(steps).alias("routing_sensor"),
        F.size(configs.routing_keys(steps)).cast("long").alias("routes"),
    )


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = configs.latest_configs(registrations(activity(spark, sf_dir), jobs=50))
    return last.select(
        "routing_sensor",
        "jobId",
        F.col("transformations")[0]["params"]["threshold"].try_cast("double").alias("threshold"),
        F.col("seq").alias("event_id"),
    )


def _acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.config_acks(registrations(activity(spark, sf_dir))).select(
        "job_id",
        "result_kind",
        "result_string",
        "grouping_field",
        "aggregation_type",
        F.col("seq").alias("event_id"),
    )


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.config_messages(registrations(activity(spark, sf_dir)).drop("outputTopic"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element and aggregation steps told apart; an unknown kind is in neither list."""
    kinds = ["sum", "trim_whitespace", "median", "max", "filter_less"]
    steps = F.array(
        *[_step(F.lit(k), {"field": F.col("event_type")}) for k in kinds],
        _step(F.col("event_type"), {"field": F.lit("x")}),
    ).cast(STEPS)

    def names(listed: Column) -> Column:
        return F.array_join(F.transform(listed, lambda t: t["type"]), ",")

    return activity(spark, sf_dir).select(
        "event_id",
        names(configs.element_steps(steps)).alias("elements"),
        names(configs.aggregation_steps(steps)).alias("aggregations"),
    )


def _as_of(slice_seconds: int, untimed: bool = False):
    """Each event under the registrations in force at its time; the log is the table itself.

    `untimed` blanks the time of every second event, which then meets the last ones.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = activity(spark, sf_dir)
        columns = activity_columns()
        e = rows.select(*[columns[c].alias(c) for c in EVENT_COLUMNS])
        if untimed:
            e = e.withColumn("event_ts", F.when(F.col("arrival_seq") % 2 == 0, F.col("event_ts")))
        joined = data_driven.join_configs_as_of(e, registrations(rows), slice_seconds=slice_seconds)
        return joined.select(
            F.col("arrival_seq").alias("event_id"),
            F.col("cfg_job_id").alias("job_id"),
            F.col("cfg_steps")[0]["params"]["threshold"].try_cast("double").alias("threshold"),
        )

    return query


_VERSIONS = [
    ("steady", "2023-12-01 00:00:00", 1, 50.0),
    ("moving", "2024-01-05 00:00:00", 2, 10.0),
    ("moving", "2024-01-12 12:00:00", 3, 60.0),
    ("moving", "2024-01-12 12:00:00", 4, 90.0),
    ("moving", "2024-01-25 00:00:00", 5, 120.0),
]


def _changing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two jobs, one of which is registered anew while events arrive."""
    columns = activity_columns()
    e = activity(spark, sf_dir).select(*[columns[c].alias(c) for c in EVENT_COLUMNS])
    rows = [(j, at, s, t) for j, at, s, t in _VERSIONS]
    steps = F.array(_step(F.lit("filter_greater"), {"sensor": F.lit("click"), "threshold": F.col("t")}))
    log = spark.createDataFrame(rows, "jobId string, at string, seq long, t double").select(
        "jobId",
        steps.cast(STEPS).alias("transformations"),
        "seq",
        F.to_timestamp(F.concat("at", F.lit("Z"))).alias("registered_at"),
    )
    return data_driven.run_as_of(e, log, 3600).select(
        "job_id", "result_kind", F.col("result_event.measurement").alias("measurement"), F.col("seq").alias("event_id")
    )


_AS_OF_SQL = (
    "SELECT e.event_id, l.job_id, l.threshold FROM "
    "(SELECT event_id, ts, event_type AS sensor, j.job_id FROM events CROSS JOIN "
    "(SELECT DISTINCT 'job-' || (user_id % 4) AS job_id FROM events) j) e "
    "ASOF JOIN (SELECT ts, event_type AS sensor, 'job-' || (user_id % 4) AS job_id, value AS threshold FROM events) l "
    "ON e.sensor = l.sensor AND e.job_id = l.job_id AND e.ts >= l.ts"
)
_VERSION_ROWS = ", ".join(
    f"('{j}', TIMESTAMP '{start}', TIMESTAMP '{end}', {t})"
    for j, start, end, t in [
        ("steady", "2023-12-01 00:00:00", "2999-01-01 00:00:00", 50.0),
        ("moving", "2024-01-05 00:00:00", "2024-01-12 12:00:00", 10.0),
        ("moving", "2024-01-12 12:00:00", "2024-01-25 00:00:00", 90.0),
        ("moving", "2024-01-25 00:00:00", "2999-01-01 00:00:00", 120.0),
    ]
)

QUERIES = {
    "config_validate": (
        _validate,
        "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'jobId is required' WHEN 1 THEN 'jobId is required' "
        "WHEN 2 THEN 'Unknown transformation type: median' WHEN 3 THEN 'no routing sensor' "
        "WHEN 4 THEN 'bad number in filter_greater' WHEN 5 THEN 'bad number in filter_greater' "
        "WHEN 6 THEN 'sum needs a numeric field: location' WHEN 7 THEN 'sum needs a numeric field: datetime' "
        "ELSE 'accepted' END AS reason FROM events",
    ),
    "config_routing": (
        _routing,
        "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'humidity' ELSE 'light' END AS routing_sensor, "
        "CASE event_id % 3 WHEN 2 THEN 2 ELSE 1 END::BIGINT AS routes FROM events",
    ),
    "config_latest": (
        _latest,
        'SELECT event_type AS routing_sensor, \'job-\' || (user_id % 50) AS "jobId", '
        "arg_max(value, event_id) AS threshold, max(event_id) AS event_id FROM events GROUP BY 1, 2",
    ),
    "config_ack": (
        _acks,
        "SELECT 'job-' || (user_id % 4) AS job_id, 'ack' AS result_kind, "
        "'Configuration registered successfully' AS result_string, CAST(NULL AS VARCHAR) AS grouping_field, "
        "CAST(NULL AS VARCHAR) AS aggregation_type, event_id FROM events",
    ),
    "config_messages": (
        _messages,
        """SELECT 'job-' || (user_id % 4) AS "key", '{"jobId":"job-' || (user_id % 4) || '","transformations":[{"type":"filter_greater","params":{"sensor":"' || event_type || '","threshold":"' || CAST(value AS VARCHAR) || '"},"keyBy":null}]}' AS "value" FROM events""",
    ),
    "config_split": (
        _split,
        "SELECT event_id, 'trim_whitespace,filter_less' AS elements, 'sum,max' AS aggregations FROM events",
    ),
    "config_asof": (_as_of(data_driven.SLICE_SECONDS), _AS_OF_SQL),
    "config_asof_bucketed": (_as_of(60), _AS_OF_SQL),
    "config_asof_untimed": (
        _as_of(data_driven.SLICE_SECONDS, untimed=True),
        _AS_OF_SQL.replace(
            "SELECT event_id, ts, event_type AS sensor, j.job_id",
            "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE TIMESTAMP '9999-01-01' END AS ts, "
            "event_type AS sensor, j.job_id",
        ),
    ),
    "config_asof_results": (
        _changing_results,
        "SELECT v.job_id, 'passthrough' AS result_kind, e.value AS measurement, e.event_id FROM events e "
        f"JOIN (VALUES {_VERSION_ROWS}) AS v(job_id, lo, hi, t) ON e.ts >= v.lo AND e.ts < v.hi "
        "WHERE e.event_type = 'click' AND e.value > v.t",
    ),
}
