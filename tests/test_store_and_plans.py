"""The result store, and the shape of the plans."""

import json

from pyspark.sql import functions as F
from support import collected, event, frame, job, step

from sensorflow.operators import configs
from sensorflow.plans import compiled, data_driven
from sensorflow.plans.job import jobs_frame
from sensorflow.session import work_dir
from sensorflow.sinks import documents, publish, store
from sensorflow.sources import messages
from sensorflow.sources.streams import Settings
from sensorflow.sources.tables import activity_columns
from sensorflow.schemas import EVENT_COLUMNS

MAX_T = job("max t!", step("filter_greater", sensor="t", threshold=1), step("max", "location", sensor="t"))
PASS_U = job("pass-u", step("filter_less", sensor="u", threshold=100))


def results(spark):
    rows = [event("t", v, at=a, location="x") for v, a in ((5.0, 1), (9.0, 2), (4.0, 12))]
    rows += [event("u", 1.0, seq=50), event("u", 2.0, seq=51)]
    return compiled.run_jobs(frame(spark, rows), [MAX_T, PASS_U])


def test_replaying_a_batch_changes_nothing(spark):
    out = work_dir(spark, "store")
    store.write_batch(results(spark), 0, out)
    store.write_batch(results(spark), 1, out)
    before = (store.history(spark, out).count(), collected(store.latest(spark, out)))
    store.write_batch(results(spark), 1, out)
    assert (store.history(spark, out).count(), collected(store.latest(spark, out))) == before
    assert before[0] == 2 * 4


def test_latest_keeps_the_newest_row_per_id(spark):
    out = work_dir(spark, "store")
    store.write_batch(results(spark), 0, out)
    rows = {r["collection"]: r for r in store.latest(spark, out).collect()}
    assert set(rows) == {"max_t_", "pass_u"}
    assert rows["max_t_"]["result_double"] == 4.0  # the later window, not the larger value
    assert rows["pass_u"]["result_event"]["measurement"] == 2.0


def test_documents(spark):
    acks = configs.config_acks(jobs_frame(spark, [MAX_T]))
    made = documents.identified(results(spark).unionByName(acks)).select(
        documents.result_document(F.timestamp_seconds(F.lit(0))).alias("d"), "result_kind", "seq"
    )
    docs = {(r["result_kind"], r["seq"]): json.loads(r["d"]) for r in made.collect()}
    ack = docs[("ack", 0)]
    assert ack["result"] == configs.ACK_MESSAGE and ack["groupingKey"] is None and "location" not in ack
    assert ack["_id"].startswith("job:max t!|g:default:default|agg:none|f:default|h:")
    window = docs[("aggregate", 0)]
    assert window["result"] == 9.0 and window["location"] == "x" and window["processedAt"] == "1970-01-01T00:00:00Z"
    assert window["transformations"][0]["keyBy"] is None
    passed = docs[("passthrough", 51)]
    assert passed["result"] == {
        "sensor": "u", "measurement": 2.0, "measurementUnit": None,
        "datetime": "2026-01-01T00:00:00.000000Z", "location": None, "dataQuality": None,
    }


def test_collection_names(spark):
    df = spark.createDataFrame([("a-b c/é",), (" \t",), (None,)], "j string")
    got = [r[0] for r in df.select(documents.collection_name(F.col("j"))).collect()]
    assert got == ["a_b_c__", "unknown_job", "unknown_job"]


def test_published_messages_are_read_back(spark, tmp_path):
    settings = Settings(config_path=str(tmp_path / "c"), event_path=str(tmp_path / "e"))
    publish.publish_configs(configs.config_messages(jobs_frame(spark, [MAX_T])), settings)
    publish.publish_events(documents.event_messages(frame(spark, [event("t", 1.5)])), settings)
    read = messages.parse_configs(spark.read.text(settings.config_path)).first()
    assert (read["jobId"], len(read["transformations"]), read["reason"]) == ("max t!", 2, None)
    back = messages.parse_events(spark.read.text(settings.event_path)).first()
    assert (back["sensor"], back["measurement"], back["reason"]) == ("t", 1.5, None)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored_events(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    spark.range(100).select(
        F.col("id").alias("event_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("user_id"),
        F.lit("t").alias("event_type"),
        F.col("id").cast("double").alias("value"),
    ).write.parquet(path)
    columns = activity_columns()
    return spark.read.parquet(path).select(*[columns[c].alias(c) for c in EVENT_COLUMNS])


def test_filters_reach_the_scan_and_hashing_precedes_the_shuffle(spark, tmp_path):
    text = plan(compiled.run_job(stored_events(spark, tmp_path), MAX_T))
    assert "EqualTo(event_type,t)" in text and "GreaterThan(value,1.0)" in text
    assert "Cartesian" not in text and "NestedLoop" not in text and "Union" not in text
    lines = text.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x)
    first_exchange = max(i for i, x in enumerate(lines[:scan]) if "Exchange" in x)
    between = "\n".join(lines[first_exchange:scan])
    assert "HashAggregate" in between and "SortAggregate" not in between


def test_config_join_is_broadcast_only_below_the_bound(spark, tmp_path):
    events = stored_events(spark, tmp_path)
    ready = configs.prepared(jobs_frame(spark, [MAX_T]))
    small = plan(data_driven.join_configs(events, ready))
    assert "BroadcastHashJoin" in small
    text = plan(data_driven.join_configs(events, ready, broadcast_bytes=0))
    assert "salt" in text and "NestedLoop" not in text


def test_one_busy_sensor_gives_whole_results(spark):
    busy = spark.range(20_000).select(
        F.lit(None).cast("string").alias("job_id"),
        F.lit("t").alias("sensor"),
        (F.col("id") % 100).cast("double").alias("measurement"),
        F.lit(None).cast("string").alias("measurement_unit"),
        F.lit(None).cast("string").alias("datetime"),
        F.lit("x").alias("location"),
        F.lit(None).cast("string").alias("data_quality"),
        F.timestamp_seconds(F.lit(0)).alias("event_ts"),
        F.col("id").alias("arrival_seq"),
    )
    j = job("j", step("sum", sensor="t"))
    for limit in (1 << 20, 0):
        row = data_driven.run(busy, jobs_frame(spark, [j]), broadcast_bytes=limit).first()
        assert (row["result_double"], row["seq"]) == (990_000.0, 0)
    joined = data_driven.spread(busy, 32).groupBy("salt").count()
    assert joined.count() == 32 and joined.agg(F.max("count")).first()[0] < 20_000 / 32 * 1.5
