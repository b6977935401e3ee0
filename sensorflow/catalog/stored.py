"""Identity, collections, documents, and the newest row per id."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.catalog.aggregations import MAX_BY_LOCATION
from sensorflow.catalog.common import HOUR, element, events, job, source, windowed_sql
from sensorflow.operators import configs
from sensorflow.plans import compiled
from sensorflow.schemas import STEPS
from sensorflow.session import use_utc, work_dir
from sensorflow.sinks import committed, document_store, documents, store

_WATCH = job("view watch!", element("filter_greater", sensor="view", threshold=100))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled.run_jobs(events(spark, sf_dir), [MAX_BY_LOCATION, _WATCH], HOUR)


def _identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without the digest of the step list, and how often each occurs."""
    rows = documents.identified(_results(spark, sf_dir))
    short = F.regexp_replace("_id", "[|]h:[0-9a-f]{64}$", "")
    return rows.groupBy(short.alias("short_id"), "collection").agg(F.count("*").alias("n"))


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("user_id") % 5 == 0, F.lit(" \n ")).otherwise(
        F.concat("event_type", F.lit("/ü "), F.col("user_id").cast("string"), F.lit("-x_1"))
    )
    return rows.select("event_id", documents.collection_name(name).alias("collection"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, the first compacted, the second replayed, the third replayed as empty."""
    output = work_dir(spark, "latest-results")
    results = _results(spark, sf_dir)
    store.write_batch(results.where("result_kind = 'passthrough'"), 0, output)
    store.compact(spark, output, 0)
    store.write_batch(results, 1, output)
    store.write_batch(results, 1, output)
    store.write_batch(results, 2, output)
    store.write_batch(results.where("false"), 2, output)
    return store.latest(spark, output).select(
        "collection",
        "job_id",
        "grouping_key",
        "result_double",
        F.col("result_event.measurement").alias("measurement"),
        F.col("seq").alias("event_id"),
        "batch_id",
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = work_dir(spark, "history")
    results = _results(spark, sf_dir)
    for batch in (0, 1, 1):
        store.write_batch(results, batch, output)
    return store.history(spark, output).groupBy("collection", "batch_id", "result_kind").agg(
        F.count("*").alias("n")
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back as columns; absent and null members differ."""
    doc = documents.result_document(F.current_timestamp())
    rows = documents.identified(_results(spark, sf_dir)).select(doc.alias("d"), F.col("seq"))

    def at(path: str, kind: str = "string"):
        return F.get_json_object("d", f"$.{path}").cast(kind)

    members = F.json_object_keys("d")
    return rows.select(
        F.col("seq").alias("event_id"),
        at("jobId").alias("job_id"),
        at("groupingField").alias("grouping_field"),
        at("groupingKey").alias("grouping_key"),
        at("aggregationType").alias("aggregation_type"),
        F.when(at("aggregationType").isNotNull(), at("result", "double")).alias("result"),
        at("result.sensor").alias("event_sensor"),
        at("result.measurement", "double").alias("event_measurement"),
        at("result.measurementUnit").alias("event_unit"),
        at("result.location").alias("event_location"),
        at("sensorType").alias("sensor_type"),
        at("transformations[0].params.threshold").alias("threshold"),
        F.array_contains(members, "field").alias("has_field"),
        F.array_contains(members, "processedAt").alias("has_time"),
    )


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see of a batch before and after its replay, and while the replay is under way."""
    output = work_dir(spark, "replayed")
    results = _results(spark, sf_dir)
    store.write_batch(results.where("result_kind = 'passthrough'"), 0, output)
    before = store.history(spark, output)
    table = f"{output}/history"
    again = store.stamped(results, 0)
    folder = committed.write(again, table, 0, ["collection"])
    meanwhile = store.history(spark, output)
    committed.commit(spark, table, {0: folder})
    seen = {"before": before, "meanwhile": meanwhile, "after": store.history(spark, output)}
    parts = [rows.withColumn("reader", F.lit(name)) for name, rows in seen.items()]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("reader", "collection").agg(F.count("*").alias("n"), F.sum("seq").alias("event_ids"))


def _document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in two batches, the second of them twice, and read back by id."""
    output = work_dir(spark, "document-store")
    results = _results(spark, sf_dir)
    document_store.write_batch(results.where("result_kind = 'passthrough'"), 0, output)
    document_store.write_batch(results.where("seq % 2 = 0"), 1, output)
    document_store.write_batch(results, 1, output)
    found = document_store.read(spark, output)

    def at(path: str, kind: str = "string"):
        return F.get_json_object("document", f"$.{path}").cast(kind)

    return found.select(
        "collection",
        F.regexp_replace("_id", "[|]h:[0-9a-f]{64}$", "").alias("short_id"),
        (F.col("_id") == at("_id")).alias("same_id"),
        at("groupingKey").alias("grouping_key"),
        F.when(at("aggregationType").isNotNull(), at("result", "double")).alias("result"),
        at("result.measurement", "double").alias("measurement"),
        at("result.datetime").alias("datetime"),
        at("location").alias("location"),
        F.col("batch").alias("batch_id"),
    )


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of writing: one per batch, not before the batch was begun, later in a later batch."""
    output = work_dir(spark, "stamps")
    results = _results(spark, sf_dir)
    begun = []
    for batch in (0, 1):
        begun.append(datetime.now(UTC))
        store.write_batch(results, batch, output)
    rows = store.history(spark, output)
    start = F.when(F.col("batch_id") == 0, F.lit(begun[0])).otherwise(F.lit(begun[1]))
    latest = store.latest(spark, output).agg(F.min("processed_at").alias("low"), F.max("processed_at").alias("high"))
    return (
        rows.groupBy("batch_id")
        .agg(
            F.count("*").alias("n"),
            F.countDistinct("processed_at").alias("stamps"),
            F.min(F.col("processed_at") >= start).alias("after_start"),
            F.max("processed_at").alias("at"),
        )
        .crossJoin(latest)
        .select("batch_id", "n", "stamps", "after_start", ((F.col("at") == F.col("low")) & (F.col("at") == F.col("high"))).alias("is_latest"))
    )


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest in an id, of lists that differ in the order of their parameters and in a value."""
    rows = use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    threshold = F.col("value").cast("string")
    pairs = [(F.lit("sensor"), F.col("event_type")), (F.lit("threshold"), threshold)]
    turned = F.col("event_id") % 2 == 0
    there, back = (F.create_map(*[x for p in order for x in p]) for order in (pairs, pairs[::-1]))
    one = F.struct(F.lit("filter_greater").alias("type"), F.when(turned, there).otherwise(back).alias("params"), F.lit(None).cast("string").alias("keyBy"))
    hashed = rows.withColumn("transformations", F.array(one).cast(STEPS)).select(
        "event_id",
        F.lit("a job").alias("job_id"),
        F.lit("sensor").alias("grouping_field"),
        F.col("event_type").alias("grouping_key"),
        F.lit(None).cast("string").alias("aggregation_type"),
        F.lit(None).cast("string").alias("field"),
        configs.steps_hash(F.col("transformations")).alias("steps_hash"),
    )
    return hashed.select("event_id", documents.result_id().alias("_id"))


_WINDOWS = windowed_sql("hourly-max", "max", "sensor = 'click' AND measurement > 5")
_LAST_WINDOW = (
    f"SELECT * FROM ({_WINDOWS}) QUALIFY row_number() OVER (PARTITION BY grouping_key ORDER BY window_start DESC) = 1"
)

_LAST_DOCUMENTS = (
    "SELECT 'hourly_max' AS collection, 'job:hourly-max|g:location:' || grouping_key || '|agg:max|f:measurement' AS short_id, "
    "TRUE AS same_id, grouping_key, result_double AS result, CAST(NULL AS DOUBLE) AS measurement, CAST(NULL AS VARCHAR) AS datetime, "
    f"location, 1::BIGINT AS batch_id FROM ({_LAST_WINDOW}) "
    "UNION ALL SELECT 'view_watch_', 'job:view watch!|g:sensor:view|agg:none|f:default', TRUE, 'view', NULL, "
    "arg_max(measurement, event_id), arg_max(datetime, event_id), arg_max(location, event_id), 1 "
    f"FROM {source()} WHERE sensor = 'view' AND measurement > 100 HAVING count(*) > 0"
)
_SEEN = (
    "SELECT 'view_watch_' AS collection, event_id AS seq FROM events WHERE event_type = 'view' AND value > 100 "
    f"UNION ALL SELECT 'hourly_max', first_event_id FROM ({_WINDOWS})"
)

QUERIES = {
    "store_replay": (
        _replayed,
        "SELECT reader, collection, count(*) AS n, sum(seq)::BIGINT AS event_ids FROM "
        f"({_SEEN}), (VALUES ('before'), ('meanwhile'), ('after')) AS r(reader) "
        "WHERE reader = 'after' OR collection = 'view_watch_' GROUP BY reader, collection",
    ),
    "document_store": (_document_store, _LAST_DOCUMENTS),
    "write_time": (
        _stamps,
        f"SELECT batch_id, n, 1::BIGINT AS stamps, TRUE AS after_start, batch_id = 1 AS is_latest FROM (SELECT count(*) AS n FROM ({_SEEN})) "
        "CROSS JOIN (VALUES (0::BIGINT), (1)) AS b(batch_id) WHERE n > 0",
    ),
    "identity_digest": (
        _digests,
        """SELECT event_id, 'job:a job|g:sensor:' || event_type || '|agg:none|f:default|h:' || sha256('[{"type":"filter_greater","params":[{"key":"sensor","value":"' || event_type || '"},{"key":"threshold","value":"' || CAST(value AS VARCHAR) || '"}],"keyBy":null}]') AS _id FROM events""",
    ),
    "result_identity": (
        _identity,
        "SELECT 'job:hourly-max|g:location:' || grouping_key || '|agg:max|f:measurement' AS short_id, "
        f"'hourly_max' AS collection, count(*) AS n FROM ({_WINDOWS}) GROUP BY grouping_key "
        "UNION ALL SELECT 'job:view watch!|g:sensor:view|agg:none|f:default', 'view_watch_', count(*) "
        "FROM events WHERE event_type = 'view' AND value > 100 HAVING count(*) > 0",
    ),
    "collection_name": (
        _collections,
        "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'unknown_job' ELSE "
        "regexp_replace(event_type || '/ü ' || user_id || '-x_1', '[^a-zA-Z0-9_]', '_', 'g') END AS collection FROM events",
    ),
    "latest_results": (
        _latest,
        "SELECT 'hourly_max' AS collection, job_id, grouping_key, result_double, CAST(NULL AS DOUBLE) AS measurement, "
        f"first_event_id AS event_id, 1::BIGINT AS batch_id FROM ({_LAST_WINDOW}) "
        "UNION ALL SELECT 'view_watch_', 'view watch!', 'view', NULL, arg_max(value, event_id), max(event_id), 1 "
        "FROM events WHERE event_type = 'view' AND value > 100 HAVING count(*) > 0",
    ),
    "result_history": (
        _history,
        "SELECT * FROM (SELECT 'hourly_max' AS collection, 'aggregate' AS result_kind, count(*) AS n "
        f"FROM ({_WINDOWS}) UNION ALL SELECT 'view_watch_', 'passthrough', count(*) FROM events "
        "WHERE event_type = 'view' AND value > 100) CROSS JOIN (VALUES (0::BIGINT), (1)) AS b(batch_id)",
    ),
    "result_document": (
        _documents,
        "SELECT first_event_id AS event_id, job_id, grouping_field, grouping_key, aggregation_type, "
        "result_double AS result, CAST(NULL AS VARCHAR) AS event_sensor, CAST(NULL AS DOUBLE) AS event_measurement, "
        "CAST(NULL AS VARCHAR) AS event_unit, CAST(NULL AS VARCHAR) AS event_location, sensor_type, "
        f"'5.0' AS threshold, TRUE AS has_field, TRUE AS has_time FROM ({_WINDOWS}) "
        "UNION ALL SELECT event_id, 'view watch!', 'sensor', sensor, NULL, NULL, sensor, measurement, unit, location, "
        f"sensor, '100', TRUE, TRUE FROM {source()} WHERE sensor = 'view' AND measurement > 100",
    ),
}
