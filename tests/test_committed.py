"""Tables committed by manifest, the stores built on them, and late rows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from support import collected, event, frame, job, step

from sensorflow.plans import compiled
from sensorflow.schemas import EVENT_COLUMNS
from sensorflow.session import work_dir
from sensorflow.sinks import committed, document_store, store
from sensorflow.streaming import late

NUMBERS = T.StructType([T.StructField("n", T.LongType())])
MAX_T = job("max t!", step("filter_greater", sensor="t", threshold=1), step("max", "location", sensor="t"))


def put(spark, table, batch, low, high):
    committed.commit(spark, table, {batch: committed.write(spark.range(low, high).toDF("n"), table, batch)})


def numbers(rows):
    return sorted(r["n"] for r in rows.collect())


def test_readers_see_whole_batches(spark):
    table = work_dir(spark, "numbers")
    assert committed.version(spark, table) == 0 and numbers(committed.read(spark, table, NUMBERS)) == []
    put(spark, table, 0, 0, 3)
    put(spark, table, -1, 7, 8)
    before = committed.read(spark, table, NUMBERS)
    folder = committed.write(spark.range(10, 12).toDF("n"), table, 0)
    assert numbers(committed.read(spark, table, NUMBERS)) == [0, 1, 2, 7]
    committed.commit(spark, table, {0: folder})
    assert numbers(before) == [0, 1, 2, 7]  # a reader that started earlier goes on with what it saw
    assert numbers(committed.read(spark, table, NUMBERS)) == [7, 10, 11]
    assert numbers(committed.read(spark, table, NUMBERS, lambda b: b >= 0)) == [10, 11]
    assert committed.clean(spark, table, 3_600_000) == 0
    assert committed.clean(spark, table, -1) == 1
    assert numbers(committed.read(spark, table, NUMBERS)) == [7, 10, 11]
    committed.commit(spark, table, {}, drop=[-1])
    assert numbers(committed.read(spark, table, NUMBERS)) == [10, 11]
    put(spark, table, 1, 0, 0)
    assert committed.version(spark, table) == 5 and numbers(committed.read(spark, table, NUMBERS)) == [10, 11]


def results(spark, *values):
    rows = [event("t", v, at=i, location="xy"[i % 2]) for i, v in enumerate(values)]
    return compiled.run_jobs(frame(spark, rows), [MAX_T])


def test_compaction_changes_no_answer(spark):
    out = work_dir(spark, "store")
    for batch, values in enumerate([(5.0, 2.0), (9.0,), (), (3.0, 4.0)]):
        store.write_batch(results(spark, *values), batch, out)
    views = [collected(store.latest(spark, out)), collected(store.history(spark, out))]
    for upto in (1, 2, 2, 3):
        store.compact(spark, out, upto)
        assert [collected(store.latest(spark, out)), collected(store.history(spark, out))] == views
    assert len(committed.batches(spark, f"{out}/history")) < 4
    assert store.clean(spark, out, -1) > 0
    store.write_batch(results(spark, 1.5), 4, out)
    assert {r["double"] for r in collected(store.latest(spark, out))} == {1.5, 4.0}


def held(spark, out):
    return sorted((r["_id"], json.loads(r["document"])["result"], r["batch"]) for r in document_store.read(spark, out).collect())


def test_documents_are_replaced_by_id(spark):
    out = work_dir(spark, "documents")
    assert held(spark, out) == []
    document_store.write_batch(results(spark, 5.0, 2.0), 0, out)
    first = held(spark, out)
    assert [(r, b) for _, r, b in first] == [(5.0, 0), (2.0, 0)]
    document_store.write_batch(results(spark, 9.0), 1, out)
    document_store.write_batch(results(spark, 8.0), 1, out)
    assert [(r, b) for _, r, b in held(spark, out)] == [(8.0, 1), (2.0, 0)]
    assert [i for i, _, _ in held(spark, out)] == [i for i, _, _ in first]
    document_store.compact(spark, out, 1)
    assert [(r, b) for _, r, b in held(spark, out)] == [(8.0, 1), (2.0, 1)]
    found = document_store.read(spark, out).where("collection = 'max_t_'").first()
    document = json.loads(found["document"])
    assert document["_id"] == found["_id"] and document["jobId"] == "max t!" and "processedAt" in document


def test_a_stream_writes_documents(spark, tmp_path):
    out = work_dir(spark, "documents")
    source = str(tmp_path / "in")
    results(spark, 5.0, 2.0).write.parquet(f"{source}/1")
    stream = spark.readStream.schema(results(spark).schema).parquet(f"{source}/*")
    query = stream.writeStream.foreachBatch(document_store.document_writer(out)).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert [r for _, r, _ in held(spark, out)] == [5.0, 2.0]


@pytest.mark.parametrize("again", [(), (1,), (1, 1)])
def test_kept_and_late_rows_are_the_input(spark, again):
    out = work_dir(spark, "split")
    times = [[1, 25, 40], [2, 39, 55], [3, 41, 60]]
    batches = [frame(spark, [event("t", float(t), at=t, seq=10 * b + i) for i, t in enumerate(ts)] + [event("t", -1.0, text="none", seq=10 * b + 9)]) for b, ts in enumerate(times)]
    for b in (0, 1, *again, 2):
        late.split_batch(batches[b], b, out, 10, 5)
    schema = batches[0].schema
    sides = {side: sorted(r["measurement"] for r in late.rows(spark, out, side, schema).collect()) for side in late.SIDES}
    # Closed up to 35 s after the first batch, up to 50 s after the second.
    assert sides["late"] == [2.0, 3.0, 41.0]
    assert sides["on_time"] == [-1.0, -1.0, -1.0, 1.0, 25.0, 39.0, 40.0, 55.0, 60.0]
    assert set(late.rows(spark, out, "late", schema).columns) == {*EVENT_COLUMNS}
    assert late.watermark(spark, out).second == 55 % 60 and late.watermark(spark, out, 0) is None
    inputs, _ = compiled.job_outputs(late.rows(spark, out, "on_time", schema).where(F.col("event_ts").isNotNull()), MAX_T)
    closed = late.closed_windows(inputs, late.watermark(spark, out), 10)
    assert sorted(r["result_double"] for r in closed.collect()) == [25.0, 39.0, 40.0]
