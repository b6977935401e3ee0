"""The same work as streams over the activity table, driven to completion."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.catalog.aggregations import MAX_BY_LOCATION
from sensorflow.catalog.common import (
    HOUR,
    aggregation,
    element,
    job,
    source,
    window_start,
    windowed,
    windowed_sql,
)
from sensorflow.catalog.configurations import activity
from sensorflow.operators import configs
from sensorflow.plans import compiled
from sensorflow.plans.job import jobs_frame
from sensorflow.schemas import EVENT_COLUMNS
from sensorflow.session import STATE_STORE, stored, use_utc, work_dir
from sensorflow.sinks import publish, store
from sensorflow.sources import messages, streams
from sensorflow.sources.tables import activity_columns
from sensorflow.streaming import late, registry, start

_SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")


@contextmanager
def _stream_settings(spark: SparkSession):
    """State partitions sized to the cluster's cores and the RocksDB store, while a query starts."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    spark.conf.set(_SETTINGS[0], str(max(2, spark.sparkContext.defaultParallelism)))
    spark.conf.set(_SETTINGS[1], STATE_STORE)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def activity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity table as a stream, whether it is one file or a folder of part files."""
    path = f"{sf_dir}/events.parquet"
    schema = use_utc(spark).read.parquet(path).schema
    # As a pattern, for a plain path of a stream must be a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path[:-1] + "[t]")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = activity_columns()
    return activity_stream(spark, sf_dir).select(*[columns[c].alias(c) for c in EVENT_COLUMNS])


def _arrive(rows: DataFrame, output: str, number: int) -> DataFrame:
    """Writes rows as the next part of a folder of activity; the folder as a stream of events.

    A file or row group is read by one task, so however few the rows came in, they are dealt
    out to as many files as there are cores.
    """
    spark, columns = rows.sparkSession, activity_columns()
    rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{output}/activity/part={number}")
    arriving = spark.readStream.schema(rows.schema).parquet(f"{output}/activity")
    return arriving.select(*[columns[c].alias(c) for c in EVENT_COLUMNS])


def _event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over event time; updates of a window replace each other in the store."""
    output = work_dir(spark, "event-time")
    results = start.fixed_job_results(
        event_stream(spark, sf_dir), [MAX_BY_LOCATION], HOUR, event_time=True
    )
    with _stream_settings(spark):
        query = start.start(
            results, f"{output}/store", f"{output}/checkpoint", "update", availableNow=True
        )
    query.awaitTermination()
    written = store.history(spark, f"{output}/store")
    # The last update of a window holds all its rows.
    newest = written.groupBy("_id", "window").agg(
        F.max_by(F.struct(*[c for c in written.columns if c not in ("_id", "window")]), "batch_id").alias("r")
    )
    return windowed(newest.select("_id", "window", "r.*"))


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is stopped half-way: the state it left behind, and the results after its restart."""
    output = work_dir(spark, "recovery")
    rows = activity(spark, sf_dir)
    state = None
    for number in range(2):
        events_ = _arrive(rows.where(F.col("event_id") % 2 == number), output, number)
        results = start.fixed_job_results(events_, [MAX_BY_LOCATION], HOUR, event_time=True)
        with _stream_settings(spark):
            query = start.start(results, f"{output}/store", f"{output}/checkpoint", "update", availableNow=True)
        query.awaitTermination()
        if not number:
            # Stored, for the restart goes on to change it.
            with _stream_settings(spark):
                state = stored(start.open_windows(spark, f"{output}/checkpoint"), "open-windows")
    found = store.history(spark, f"{output}/store")
    newest = found.groupBy("_id", "window").agg(
        F.max_by(F.struct("grouping_key", "result_double"), "batch_id").alias("r")
    )
    open_ = state.select(F.lit("state").alias("seen"), window_start().alias("window_start"), "grouping_key", F.round("high", 6).alias("result"))
    done = newest.select(F.lit("result").alias("seen"), window_start().alias("window_start"), "r.grouping_key", F.round("r.result_double", 6).alias("result"))
    return open_.unionByName(done)


_PARTS = 3
_DELAY = 14 * 86_400


def _late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three parts, each of which reaches back: kept and late rows, and the closed windows."""
    output = work_dir(spark, "late")
    rows = activity(spark, sf_dir)
    columns = activity_columns()
    for number in range(_PARTS):
        events_ = _arrive(rows.where(F.col("event_id") % _PARTS == number), output, number)
        late.start_split(events_, output, f"{output}/checkpoint", _DELAY, HOUR, availableNow=True).awaitTermination()
    schema = rows.select(*[columns[c].alias(c) for c in EVENT_COLUMNS]).schema
    sides = [late.rows(spark, output, side, schema).withColumn("side", F.lit(side)) for side in late.SIDES]
    inputs, _ = compiled.job_outputs(sides[0].drop("side"), MAX_BY_LOCATION)
    windows = late.closed_windows(inputs, late.watermark(spark, output), HOUR)
    nothing = F.lit(None)
    return (
        sides[0]
        .unionByName(sides[1])
        .select(
            "side",
            F.col("arrival_seq").alias("event_id"),
            nothing.cast("string").alias("window_start"),
            nothing.cast("string").alias("grouping_key"),
            nothing.cast("double").alias("result"),
        )
        .unionByName(
            windows.select(
                F.lit("closed").alias("side"),
                F.col("seq").alias("event_id"),
                window_start().alias("window_start"),
                "grouping_key",
                F.round("result_double", 6).alias("result"),
            )
        )
    )


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the stream that don't parse, kept by reason."""
    output = work_dir(spark, "refused")
    rows = activity_stream(spark, sf_dir)
    value = F.when(F.col("event_id") % 3 == 0, "{broken").when(
        F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("sensor"), F.lit(None).cast("double").alias("measurement")), {"ignoreNullFields": "false"})
    ).otherwise(F.to_json(F.struct(F.col("event_type").alias("sensor"), F.col("value").alias("measurement"))))
    texts = rows.select(
        F.encode(value, "utf-8").alias("value"), F.col("event_id").alias("arrival_seq"), F.col("ts").cast("timestamp").alias("arrival_ts")
    )
    query = start.start_quarantine(messages.parse_events(texts), output, f"{output}/checkpoint", availableNow=True)
    query.awaitTermination()
    kept = spark.read.schema("raw string, arrival_seq long, reason string").parquet(f"{output}/quarantine")
    return kept.select(F.col("arrival_seq").alias("event_id"), "reason")


_GIVEN = job("live-high", element("filter_greater", sensor="view", threshold=75))


def _late(threshold: int):
    return job(
        "late-sum",
        element("filter_greater", sensor="click", threshold=threshold),
        aggregation("sum", sensor="click", field="measurement"),
    )


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that is there at start, and one that is registered, and registered anew, meanwhile.

    The events come in three parts. Before the second the late job arrives on the config
    stream, before the third it arrives with another threshold. The event stream goes on
    from its checkpoint each time, open windows included.
    """
    output = work_dir(spark, "live")
    settings = streams.Settings(output=f"{output}/store", checkpoint=f"{output}/checkpoint", config_path=f"{output}/configs")
    rows = activity(spark, sf_dir)
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    # The least id of each part, in whole numbers: as bounds of a range they reach the scan.
    low, size = low or 0, (high or 0) - (low or 0) + 1
    least = [low + (number * size + _PARTS - 1) // _PARTS for number in range(_PARTS + 1)]
    registry.register(jobs_frame(spark, [_GIVEN]), settings.registry)
    for number in range(_PARTS):
        if number:
            late = jobs_frame(spark, [_late(50 if number == 1 else 20)])
            publish.publish_configs(configs.config_messages(late), settings)
            start.start_registrations(spark, settings, availableNow=True).awaitTermination()
        mine = (F.col("event_id") >= least[number]) & (F.col("event_id") < least[number + 1])
        events_ = _arrive(rows.where(mine), output, number)
        results = start.live_job_results(events_, settings.registry, HOUR, event_time=True)
        with _stream_settings(spark):
            query = start.start(results, settings.output, f"{settings.checkpoint}/events", "update", availableNow=True)
        query.awaitTermination()
    written = store.history(spark, settings.output)
    newest = written.groupBy("_id", "window", "seq").agg(
        F.max_by(F.struct(*[c for c in written.columns if c not in ("_id", "window", "seq")]), "batch_id").alias("r")
    )
    shown = newest.select("window", "seq", "r.*").unionByName(
        start.acknowledgements(spark, settings.output).withColumn("seq", F.lit(None).cast("long")), allowMissingColumns=True
    )
    return shown.select(
        "job_id",
        "result_kind",
        window_start().alias("window_start"),
        "grouping_key",
        F.round("result_double", 6).alias("result_double"),
        F.round("result_event.measurement", 6).alias("measurement"),
        F.col("transformations")[0]["params"]["threshold"].alias("threshold"),
        F.col("seq").alias("event_id"),
    )


_CLOCK = job(
    "clock-max",
    element("filter_greater", sensor="click", threshold=5.0),
    aggregation("max", sensor="click", field="measurement"),
    aggregation("sum", sensor="click", field="measurement"),
)
CLOCK_SECONDS = 2


def _clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the clock. Where they cut depends on the run; their maximum and their sum do not.

    The sum over all windows shows that every row is in one of them, and in one only.
    """
    output = work_dir(spark, "clock")
    results = start.fixed_job_results(
        event_stream(spark, sf_dir), [_CLOCK], CLOCK_SECONDS
    )
    with _stream_settings(spark):
        query = start.start(
            results, f"{output}/store", f"{output}/checkpoint", processingTime="1 second"
        )
    start.drain(query, CLOCK_SECONDS)
    written = store.history(spark, f"{output}/store")
    total = F.when(F.col("aggregation_type") == "sum", F.round(F.sum("result_double"), 4))
    return written.groupBy("job_id", "grouping_key", "aggregation_type").agg(
        total.otherwise(F.max("result_double")).alias("result_double"), F.min("seq").alias("first_event_id")
    )


QUERIES = {
    "stream_quarantine": (
        _refused,
        "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'corrupt' ELSE 'null_measurement' END AS reason "
        "FROM events WHERE event_id % 3 < 2",
    ),
    "stream_event_time": (
        _event_time,
        windowed_sql("hourly-max", "max", "sensor = 'click' AND measurement > 5"),
    ),
    "stream_late_rows": (
        _late_rows,
        f"""
WITH e AS (
  SELECT *, event_id % 3 AS part, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS ending FROM {source()}),
marks AS (SELECT part, max(ts) - INTERVAL '14 days' AS mark FROM e GROUP BY part),
sided AS (
  SELECT *, CASE WHEN ending <= (SELECT max(mark) FROM marks WHERE marks.part < e.part) THEN 'late' ELSE 'on_time' END AS side FROM e)
SELECT side, event_id, CAST(NULL AS VARCHAR) AS window_start, CAST(NULL AS VARCHAR) AS grouping_key, CAST(NULL AS DOUBLE) AS result FROM sided
UNION ALL SELECT 'closed', min(event_id), strftime(ending - INTERVAL '1 hour', '%Y-%m-%dT%H:%M:%SZ'), location, round(max(measurement), 6)
FROM sided WHERE side = 'on_time' AND sensor = 'click' AND measurement > 5 AND ending <= (SELECT max(mark) FROM marks)
GROUP BY ending, location
""",
    ),
    "stream_recovery": (
        _recovered,
        "SELECT seen, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS window_start, "
        f"location AS grouping_key, round(max(measurement), 6) AS result FROM {source()}, (VALUES ('state', 1), ('result', 2)) AS p(seen, parts) "
        "WHERE sensor = 'click' AND measurement > 5 AND event_id % 2 < parts GROUP BY 1, 2, 3",
    ),
    "stream_live_config": (
        _live,
        f"""
WITH p AS (
  SELECT e.*, 3 * (event_id - lo) // (hi - lo + 1) AS part FROM {source()} AS e,
    (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)),
met AS (
  SELECT *, CASE part WHEN 1 THEN '50' ELSE '20' END AS threshold, time_bucket(INTERVAL '1 hour', ts) AS start
  FROM p WHERE sensor = 'click' AND (part = 1 AND measurement > 50 OR part = 2 AND measurement > 20))
SELECT 'late-sum' AS job_id, 'aggregate' AS result_kind, strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS window_start,
  location AS grouping_key, round(sum(measurement), 6) AS result_double, CAST(NULL AS DOUBLE) AS measurement,
  arg_min(threshold, event_id) AS threshold, min(event_id) AS event_id FROM met GROUP BY start, location
UNION ALL SELECT 'live-high', 'passthrough', NULL, sensor, NULL, round(measurement, 6), '75', event_id
  FROM p WHERE sensor = 'view' AND measurement > 75
UNION ALL SELECT 'late-sum', 'ack', NULL, NULL, NULL, NULL, threshold, NULL FROM (VALUES ('50'), ('20')) AS a(threshold)
""",
    ),
    "stream_processing_time": (
        _clock,
        "SELECT 'clock-max' AS job_id, location AS grouping_key, kind AS aggregation_type, "
        "CASE kind WHEN 'sum' THEN round(sum(measurement), 4) ELSE max(measurement) END AS result_double, "
        "min(event_id) AS first_event_id FROM "
        "(SELECT 'room-' || (user_id % 8) AS location, value AS measurement, event_id FROM events "
        "WHERE event_type = 'click' AND value > 5), (VALUES ('max'), ('sum')) AS k(kind) GROUP BY location, kind",
    ),
}
