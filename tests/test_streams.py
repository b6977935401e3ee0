"""Streams: event-time windows, windows over the clock, live jobs, restarts."""

import json
import os
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from support import INF, collected, event, frame, job, numbered, step

from sensorflow.catalog import streamed
from sensorflow.operators.aggregates import GROUP
from sensorflow.plans import compiled
from sensorflow.plans.job import jobs_frame
from sensorflow.sinks import committed, publish, store
from sensorflow.sources import messages, streams
from sensorflow.streaming import registry, start
from sensorflow.streaming.processors import ClockWindows, batch_fold

JOBS = [
    job("hot", step("filter_greater", sensor="t", threshold=1), step("sum", "location", sensor="t")),
    job("all-h", step("trim_whitespace", sensor="h")),
]


class Folder:
    """Message folders of a stream; a file appears at once, complete."""

    def __init__(self, base):
        self.base, self.count, self.opened = base, 0, time.time() - 1000
        for name in ("configs", "events", "staging"):
            (base / name).mkdir()

    def put(self, kind, documents):
        self.count += 1
        staged = self.base / "staging" / f"{self.count}.json"
        staged.write_text("\n".join(json.dumps(d) for d in documents) + "\n")
        os.utime(staged, (self.opened + self.count,) * 2)  # streams read files in this order
        os.replace(staged, self.base / kind / staged.name)

    def events(self, rows):
        names = ("sensor", "measurement", "measurement_unit", "datetime", "location", "data_quality")
        self.put("events", [{k: v for k, v in zip(names, r) if v is not None} for r in numbered(rows)])

    def configs(self, *jobs):
        self.put("configs", [{"jobId": j.job_id, "transformations": json.loads(j.document)} for j in jobs])

    def settings(self):
        return streams.Settings(
            output=str(self.base / "out"),
            checkpoint=str(self.base / "checkpoint"),
            config_path=str(self.base / "configs"),
            event_path=str(self.base / "events"),
            options={"maxFilesPerTrigger": "1"},
        )

    def history(self, spark):
        try:
            return store.history(spark, str(self.base / "out")).collect()
        except Exception:
            return []


def until(spark, folder, condition, query=None, timeout=90):
    deadline = time.monotonic() + timeout
    while time.monotonic() < deadline:
        if query is not None and query.exception() is not None:
            raise query.exception()
        rows = folder.history(spark)
        if condition(rows):
            return rows
        time.sleep(1)
    raise AssertionError(f"not reached: {folder.history(spark)}")


def run_fixed(spark, folder, delay="0 seconds"):
    settings = folder.settings()
    parsed = messages.parse_events(streams.event_messages(spark, settings))
    results = start.fixed_job_results(messages.good_events(parsed), JOBS, delay=delay)
    query = start.start(results, settings.output, settings.checkpoint, availableNow=True)
    query.awaitTermination()


def test_event_time_stream_equals_batch_across_a_restart(spark, tmp_path):
    first = [event("t", v, at=a, location="x", seq=i) for i, (v, a) in enumerate([(2.0, 1), (3.0, 9), (9.0, 12)])]
    second = [event("t", 4.0, at=25, location="x", seq=3), event("h", 1.0, at=26, location=" y ", seq=4)]
    last = [event("t", 50.0, at=3, location="x", seq=5), event("t", 7.0, at=41, location="x", seq=6)]
    folder = Folder(tmp_path)
    folder.events(first)
    run_fixed(spark, folder)
    folder.events(second)
    run_fixed(spark, folder)
    folder.events(last)  # its first row is later than the watermark allows
    run_fixed(spark, folder)
    got = [
        (r["job_id"], r["result_double"], r["window"] and r["window"]["start"].second)
        for r in folder.history(spark)
    ]
    on_time = frame(spark, [*first, *second])
    expected = [
        (r["job_id"], r["double"], r["start"] and r["start"] % 60)
        for r in collected(compiled.run_jobs(on_time, JOBS))
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_live_jobs_see_later_events_only_and_windows_close_while_idle(spark, tmp_path):
    folder = Folder(tmp_path)
    settings = folder.settings()
    early, late = JOBS[0], job("late", step("max", "location", sensor="t"))

    def run():
        return start.start_live_jobs(spark, settings, seconds=3, processingTime="1 second")

    def meets(service):
        """Waits until the event stream runs with all that is registered."""
        version, deadline = committed.version(spark, settings.registry), time.monotonic() + 60
        while service.running_version() != version and time.monotonic() < deadline:
            assert service.exception() is None
            time.sleep(0.2)

    folder.events([event("t", 100.0, location="x")])
    service = run()
    try:
        time.sleep(4)  # no job is there yet: the first event is lost
        folder.configs(early, job("refused", step("max")))
        until(spark, folder, lambda rows: committed.version(spark, settings.registry) > 0, service)
        meets(service)
        folder.events([event("t", v, location="x", seq=i) for i, v in enumerate((5.0, 6.0))])
        rows = until(spark, folder, lambda rows: any(r["result_double"] == 11.0 for r in rows), service)
        assert {r["job_id"] for r in rows} == {"hot"}
        # A job that is registered while the stream runs meets what comes after it.
        folder.configs(late)
        before = committed.version(spark, settings.registry)
        until(spark, folder, lambda rows: committed.version(spark, settings.registry) > before, service)
        meets(service)
        folder.events([event("t", 8.0, location="x")])
        rows = until(spark, folder, lambda rows: sum(r["result_double"] == 8.0 for r in rows) == 2, service)
    finally:
        service.stop()
    assert service.exception() is None and not service.isActive
    # Both outlive a restart.
    service = run()
    try:
        folder.events([event("t", 9.0, location="x")])
        rows = until(spark, folder, lambda rows: sum(r["result_double"] == 9.0 for r in rows) == 2, service)
    finally:
        service.stop()
    late_rows = [r["result_double"] for r in rows if r["job_id"] == "late" and r["result_kind"] == "aggregate"]
    assert late_rows == [8.0, 9.0]
    acks = [r["job_id"] for r in start.acknowledgements(spark, settings.output).collect()]
    assert sorted(acks) == ["hot", "late"]
    assert all(r["transformations"] for r in rows)


def test_live_jobs_with_event_time_windows_survive_late_events(spark, tmp_path):
    folder = Folder(tmp_path)
    settings = folder.settings()
    registry.register(jobs_frame(spark, JOBS), settings.registry)
    folder.events([event("t", 2.0, at=1, location="x"), event("t", 3.0, at=22, location="x")])
    folder.events([event("h", 7.0, at=23)])  # Spark drops late rows one batch after the watermark moved
    folder.events([event("t", 90.0, at=2, location="x"), event("t", 4.0, at=45, location="x"), event("h", None, at=46)])
    start.start_events(spark, settings, 10, delay="0 seconds", availableNow=True).awaitTermination()
    rows = folder.history(spark)
    sums = sorted(r["result_double"] for r in rows if r["job_id"] == "hot")
    assert sums == [2.0, 3.0]
    passed = [r["result_event"]["measurement"] for r in rows if r["job_id"] == "all-h"]
    assert sorted(passed, key=repr) == [7.0, None]


def test_the_last_registration_counts_by_its_place(spark, tmp_path):
    folder = Folder(tmp_path)
    settings = folder.settings()

    def limit(n):
        return job("hot", step("filter_greater", sensor="t", threshold=n))

    def thresholds():
        rows = registry.registered(spark, settings.registry).select("routing_sensor", "cfg_steps").collect()
        return [(r.routing_sensor, r.cfg_steps[0].params["threshold"]) for r in rows]

    folder.configs(limit(1), limit(2), limit(3))
    start.start_registrations(spark, settings, availableNow=True).awaitTermination()
    assert thresholds() == [("t", "3")]
    folder.configs(limit(9))
    folder.configs(limit(5), limit(4))
    start.start_registrations(spark, settings, availableNow=True).awaitTermination()
    assert thresholds() == [("t", "4")]
    # A batch that is replayed replaces what it wrote.
    registry.register(jobs_frame(spark, [limit(7)]), settings.registry, 50)
    registry.register(jobs_frame(spark, [limit(8)]), settings.registry, 50)
    assert thresholds() == [("t", "8")]
    assert registry.registrations(spark, settings.registry).where("batch = 50").count() == 1


def test_messages_of_partitions_come_by_time(spark):
    rows = [("2026-01-01 00:00:00.002", 0, 5, "late"), ("2026-01-01 00:00:00.001", 3, 900, "early"), ("2026-01-01 00:00:00.002", 0, 4, "between")]
    sent = spark.createDataFrame(rows, "timestamp string, partition int, offset long, value string")
    kept = sent.withColumn("timestamp", F.to_timestamp("timestamp")).select(*streams.topic_columns())
    for order in ("arrival", "arrival_seq"):
        assert [r["value"] for r in kept.orderBy(order).collect()] == ["early", "between", "late"]


def test_folder_messages_keep_the_key(spark, tmp_path):
    settings = streams.Settings(config_path=str(tmp_path / "c"))
    messages_ = spark.createDataFrame([("a/b", "1"), ("a/b", "2"), ("c", "3"), (None, "4")], "key string, value string").coalesce(1)
    publish.publish_configs(messages_, settings)
    back = spark.read.text(settings.config_path)
    assert sorted((r["key"] or "", r["value"]) for r in back.collect()) == [("", "4"), ("a/b", "1"), ("a/b", "2"), ("c", "3")]
    placed = streams.read_folder(spark, settings.config_path).orderBy("arrival").collect()
    assert [r["value"] for r in placed if r["value"] in "12"] == ["1", "2"]


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0]])
def test_fold_keeps_the_context_of_the_earliest_row(order):
    base = dict.fromkeys(GROUP, "g")
    rows = [
        {**base, "total": 1.0, "nans": 0, "n": 1, "low": 1.0, "high": 1.0, "low_us": 5, "high_us": 5, "seq": 7, "sensor": "late"},
        {**base, "total": 2.0, "nans": 1, "n": 1, "low": 2.0, "high": 2.0, "low_us": 3, "high_us": 3, "seq": 2, "sensor": None},
        {**base, "field": None, "total": 0.0, "nans": 0, "n": 0, "low": INF, "high": -INF, "low_us": 1, "high_us": 1, "seq": 4, "sensor": "x"},
    ]
    pdf = pd.DataFrame([rows[i] for i in order])
    (out,) = batch_fold(GROUP)(iter([pdf.iloc[:0], pdf]))
    by_field = {None if pd.isna(r["field"]) else r["field"]: r for r in out.to_dict("records")}
    one = by_field["g"]
    assert (one["total"], one["nans"], one["n"], one["low"], one["high"], one["low_us"], one["seq"]) == (3.0, 1, 2, 1.0, 2.0, 3, 2)
    assert pd.isna(one["sensor"]) and by_field[None]["sensor"] == "x"
    assert list(out.columns) == list(pdf.columns)


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]])
def test_fold_of_rows_that_arrived_together(order):
    base = dict.fromkeys(GROUP, "g") | {"total": 1.0, "nans": 0, "n": 1, "low": 1.0, "high": 1.0, "low_us": 5, "high_us": 5}
    last = (1 << 63) - 1
    rows = [{**base, "seq": s, "sensor": w} for s, w in ((4, "b"), (4, "a"), (4, None), (last, None))]
    (out,) = batch_fold(GROUP)(iter([pd.DataFrame([rows[i] for i in order])]))
    assert pd.isna(out["sensor"][0]) and out["seq"][0] == 4 and out["n"][0] == 4
    (out,) = batch_fold(GROUP)(iter([pd.DataFrame([rows[i] for i in order if i != 2])]))
    assert out["sensor"][0] == "a"
    windows = ClockWindows(1, GROUP, ["sensor"])
    acc = None
    for i in order:
        acc = windows._fold(acc, pd.DataFrame([rows[i]]))
    assert acc[-1] is None and acc[-2] == 4


def test_parts_of_a_stream_are_work_for_all_cores(spark, tmp_path):
    """Whatever files the activity comes in: here one file of one row group."""
    rows = spark.range(90).selectExpr(
        "id + 7 AS event_id", "timestamp_ntz'2026-01-01 00:00:00' AS ts", "id AS user_id",
        "if(id % 2 = 0, 'view', 'click') AS event_type", "double(id) AS value",
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    work = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*work.glob("live-*")}
    got = streamed.QUERIES["stream_live_config"][0](spark, str(tmp_path)).collect()
    folder = ({*work.glob("live-*")} - before).pop() / "activity"
    parts = {n: spark.read.parquet(f"{folder}/part={n}") for n in range(3)}
    ids = [sorted(r.event_id for r in parts[n].select("event_id").collect()) for n in range(3)]
    assert ids == [[*range(7, 37)], [*range(37, 67)], [*range(67, 97)]]
    assert all(len([*(folder / f"part={n}").glob("*.parquet")]) == spark.sparkContext.defaultParallelism for n in range(3))
    assert sum(r.result_double for r in got if r.result_kind == "aggregate") == sum(v for v in range(90) if v % 2 and (30 <= v < 60 and v > 50 or v >= 60))
