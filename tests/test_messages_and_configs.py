"""Parsing, quarantine, config checks, routing and registration logs."""

import bisect
import json

import pytest
from pyspark.sql import functions as F
from support import event, frame, job, step

from sensorflow.operators import configs, quality
from sensorflow.plans import data_driven
from sensorflow.plans.job import jobs_frame
from sensorflow.sources import messages, streams

MESSAGES = {
    '{"sensor":"humidity","measurement":71.3,"extra":{"a":[1]},"location":"room-a"}': None,
    '{"sensor":"noise","datetime":"not-a-time","location":null}': None,
    '{"sensor":7,"measurement":2}': None,
    '{"sensor":"a","sensor":"b","measurement":1}': None,
    '{"sensor":"a","measurement":3} and more': None,
    '{"sensor":"a","location":{"x":1}}': None,
    '{"sensor":"a","extra":{"measurement":null}}': None,
    '{"sensor":"humidity"': "corrupt",
    '{"sensor":"humidity","measurement":"12"}': "corrupt",
    '{"sensor":"humidity","measurement":true}': "corrupt",
    '{"sensor":"humidity","measurement":NaN}': "corrupt",
    '{"sensor":"humidity","measurement":"NaN"}': "corrupt",
    "[]": "corrupt",
    "5": "corrupt",
    "null": "corrupt",
    '{"sensor":"humidity","measurement":null}': "null_measurement",
    '{"sensor":"humidity","measurement":5,"measurement":null}': "null_measurement",
    '{"error":"Failed"}': "missing_sensor",
    '{"sensor":null}': "missing_sensor",
}


def test_every_message_is_kept_or_labelled(spark):
    texts = [*MESSAGES, "", None]
    rows = [(None if t is None else bytearray(t.encode()), i) for i, t in enumerate(texts)]
    raw = spark.createDataFrame(rows, "value binary, arrival_seq long")
    parsed = messages.parse_events(raw)
    got = {r["raw"]: r["reason"] for r in parsed.select("raw", "reason").collect()}
    assert got == MESSAGES
    good = {r["arrival_seq"]: r for r in messages.good_events(parsed).collect()}
    assert (good[2]["sensor"], good[3]["sensor"], good[4]["measurement"]) == ("7", "b", 3.0)
    assert (good[5]["location"], good[1]["location"], good[1]["event_ts"]) == ('{"x":1}', None, None)
    assert messages.quarantined(parsed).count() == sum(v is not None for v in MESSAGES.values())


def test_bad_bytes_become_replacement_characters(spark):
    raw = spark.createDataFrame([(bytearray(b"a\xffb"),)], "value binary")
    assert raw.select(messages.decode_utf8(F.col("value"))).first()[0] == "a�b"


@pytest.mark.parametrize("builder", ["good", "bad"])
def test_config_messages_parse_or_are_labelled(spark, builder):
    text = {"good": '{"jobId":"a","source":"s","transformations":[{"type":"max","params":{"n":1.5}}]}', "bad": '{"jobId":'}
    raw = spark.createDataFrame([(text[builder],)], "value string")
    row = messages.parse_configs(raw).first()
    if builder == "good":
        assert row["reason"] is None and row["transformations"][0]["params"] == {"n": "1.5"}
    else:
        assert row["reason"] == "corrupt"


def test_job_files_are_read_as_a_table(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jobId": "a", "source": "x", "transformations": []}, indent=2))
    assert [r["jobId"] for r in messages.read_job_files(spark, str(tmp_path)).collect()] == ["a"]


GREATER = step("filter_greater", sensor="t", threshold="25.0")


@pytest.mark.parametrize(
    ("job_id", "steps", "reason"),
    [
        ("ok", [GREATER, step("max", "location", sensor="t")], None),
        ("ok", [step("filter_cross_field", filter_sensor="a", filter_threshold=1)], None),
        ("ok", [GREATER, step("max", field="datetime")], None),
        ("ok", [GREATER, step("sum", field="unheard")], None),
        (" \t", [GREATER], "jobId is required"),
        (None, [GREATER], "jobId is required"),
        ("j", [step("median", sensor="t"), step("mode")], "Unknown transformation type: median"),
        ("j", [{"type": None, "params": {}}], "Unknown transformation type: null"),
        ("j", [step("max")], "no routing sensor"),
        ("j", None, "no routing sensor"),
        ("j", [step("filter_less", sensor="t", threshold="abc")], "bad number in filter_less"),
        ("j", [step("filter_less", sensor="t")], "bad number in filter_less"),
        ("j", [step("normalize", sensor="t", min=0)], "bad number in normalize"),
        ("j", [step("sum", sensor="t", field="location")], "sum needs a numeric field: location"),
        ("j", [step("avg", sensor="t", field="datetime")], "avg needs a numeric field: datetime"),
    ],
)
def test_validation(spark, job_id, steps, reason):
    doc = json.dumps({"jobId": job_id, "transformations": steps})
    parsed = messages.parse_configs(spark.createDataFrame([(doc,)], "value string")).drop("reason", "raw")
    ok, refused = configs.validate_configs(parsed)
    assert [r["reason"] for r in refused.collect()] == ([] if reason is None else [reason])
    assert ok.count() == (reason is None)


def test_routing_and_latest(spark):
    jobs = [
        job("a", step("normalize", min=0, max=1), step("max", sensor="x"), step("min", sensor="y")),
        job("a", step("max", sensor="x", field="z")),
        job("a", step("max", sensor="y")),
        job("c", step("filter_cross_field", filter_sensor="f", target_sensor="g", filter_threshold=1)),
    ]
    log = jobs_frame(spark, jobs)
    last = configs.latest_configs(log).select("routing_sensor", "jobId", "seq").collect()
    assert sorted(map(tuple, last)) == [("f", "c", 3), ("g", "c", 3), ("x", "a", 1), ("y", "a", 2)]
    for j, row in zip(jobs, log.select(configs.routing_keys(F.col("transformations"))).collect(), strict=True):
        assert j.routes == row[0]


def test_hash_ignores_parameter_order(spark):
    a = job("a", {"type": "max", "params": {"field": "f", "sensor": "s"}})
    b = job("a", {"type": "max", "params": {"sensor": "s", "field": "f"}})
    hashes = jobs_frame(spark, [a, b]).select(configs.steps_hash(F.col("transformations")).alias("h"))
    assert hashes.distinct().count() == 1
    assert hashes.first()["h"] == spark.range(1).select(a.hash_column()).first()[0]


def registered(spark, rows):
    """(job, seconds, seq, threshold) registrations for sensor t."""
    df = spark.createDataFrame(rows, "jobId string, at double, seq long, t double")
    steps = F.from_json(
        F.concat(F.lit('[{"type":"filter_greater","params":{"sensor":"t","threshold":"'), F.col("t"), F.lit('"}}]')),
        configs.STEPS,
    )
    at = F.timestamp_micros((F.lit(1767225600e6) + F.col("at") * 1e6).cast("long"))
    return df.select("jobId", steps.alias("transformations"), "seq", at.alias("registered_at"))


def test_as_of_join_in_any_slices(spark):
    log = registered(spark, [("a", 10.0, 1, 1.0), ("a", 20.0, 2, 2.0), ("a", 20.0, 3, 3.0), ("b", 5.0, 4, 4.0), ("a", 90000.0, 5, 5.0)])
    times = [0, 5, 10, 19.5, 20, 89999, 90000, 200000]
    rows = [event("t", 9.0, at=s) for s in times] + [event("u", 9.0, at=50)]
    # Two events without a time meet the last registrations.
    rows += [event("t", 9.0, text="no time"), event("t", 9.0, text="none")]
    events = frame(spark, rows)
    expected = {
        9: {("a", 5.0), ("b", 4.0)},
        10: {("a", 5.0), ("b", 4.0)},
        1: {("b", 4.0)},
        2: {("a", 1.0), ("b", 4.0)},
        3: {("a", 1.0), ("b", 4.0)},
        4: {("a", 3.0), ("b", 4.0)},
        5: {("a", 3.0), ("b", 4.0)},
        6: {("a", 5.0), ("b", 4.0)},
        7: {("a", 5.0), ("b", 4.0)},
    }
    broadcast, cut = {}, {"broadcast_bytes": 0, "part_rows": 2}
    for seconds, how in ((1, broadcast), (15, cut), (3600, {**cut, "dense": 2}), (10**7, {**broadcast, "dense": 1}), (10**7, cut)):
        pairs = data_driven.join_configs_as_of(events, log, slice_seconds=seconds, **how)
        got = {}
        for r in pairs.select("arrival_seq", "cfg_job_id", "cfg_steps").collect():
            got.setdefault(r[0], set()).add((r[1], float(r[2][0]["params"]["threshold"])))
        assert got == expected


def test_as_of_join_of_one_crowded_moment(spark):
    """Nine events in ten have one hour or no time; without a broadcast they fall into even tasks."""
    n = 4000
    moment = F.when(F.col("id") % 10 == 0, F.col("id") * 900).when(F.col("id") % 10 < 5, F.lit(1_800_000) + F.col("id") % 3600)
    events = frame(spark, [event("t", 1.0)]).drop("event_ts", "arrival_seq", "datetime").crossJoin(
        spark.range(n).select(
            F.col("id").alias("arrival_seq"), F.col("id").cast("string").alias("datetime"),
            F.timestamp_micros(F.lit(1767225600 * 10**6) + moment * 10**6).alias("event_ts"),
        )
    )
    log = registered(spark, [("a", float(at), at, float(at)) for at in (*range(0, 3_600_000, 90_000), *range(1_800_000, 1_803_600, 3))])
    joins = [data_driven.join_configs_as_of(events, log, broadcast_bytes=b, part_rows=200, dense=16) for b in (0, 1 << 26)]
    cut, broadcast = [sorted((r[0], r[1]) for r in j.select("arrival_seq", F.col("cfg_steps")[0]["params"]["threshold"]).collect()) for j in joins]
    assert cut == broadcast and len(cut) == n
    by_time = sorted((float(t), t) for t in {*range(0, 3_600_000, 90_000), *range(1_800_000, 1_803_600, 3)})
    places = [t for t, _ in by_time]
    for i, threshold in cut:
        at = i * 900 if i % 10 == 0 else 1_800_000 + i % 3600 if i % 10 < 5 else 10**9
        assert float(threshold) == places[bisect.bisect_right(places, at) - 1]


def test_settings_and_topic_options():
    s = streams.Settings.from_mapping({"INPUT_TOPIC": "in"})
    assert (s.config_topic, s.input_topic) == ("etl.config.v1", "in")
    assert streams.config_options(s)["startingOffsets"] == "earliest"
    assert streams.event_options(s)["startingOffsets"] == "latest"
    assert streams.event_options(s)["subscribe"] == "in"


def test_quality_rounding_and_ranges(spark):
    cases = [
        ("temperature", 22.25, "excellent", 22.3, 22.25),
        ("temperature", 30.5, "good", 30.5, 30.5),
        ("temperature", -40.0, "poor", -40.0, -30.0),
        ("humidity", 19.9, "fair", 19.9, 20.0),
        ("air_quality", 100.5, "fair", 100.5, 100.5),
        ("air_quality", 151.0, "poor", 151.0, 151.0),
        ("noise", 70.1, "poor", 70.1, 70.1),
        ("other", -22.25, "excellent", -22.2, -22.25),
        ("noise", None, "excellent", None, None),
    ]
    events = frame(spark, [event(s, v) for s, v, *_ in cases])
    label = quality.quality_label(F.col("sensor"), F.col("measurement"))
    rounded = quality.round_measurement(F.col("measurement"))
    got = events.select(label, rounded, "arrival_seq").orderBy("arrival_seq").collect()
    assert [(r[0], r[1]) for r in got] == [(c[2], c[3]) for c in cases]
    bounded = quality.clamp_range(events).orderBy("arrival_seq").collect()
    assert [r["measurement"] for r in bounded] == [c[4] for c in cases]
    units = quality.with_unit(events).orderBy("arrival_seq").collect()
    assert [units[i]["measurement_unit"] for i in (0, 3, 7)] == ["Celsius", "percent", "units"]
