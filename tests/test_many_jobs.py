"""The index of many jobs gives what folding every pair gives."""

import bisect
import random

from pyspark.sql import functions as F
from support import INF, NAN, collected, event, frame, job, step

from sensorflow.plans import compiled, data_driven, indexed
from sensorflow.plans.job import jobs_frame

SENSORS = ("t", "h", "n")


def drawn_jobs(n):
    rng = random.Random(4)

    def threshold():
        return rng.choice([*range(-3, 4), 0.5, "1e400", "NaN", "x", None, 1_767_225_600_500])

    def one():
        kind = rng.randrange(7)
        sensor = rng.choice(SENSORS)
        if kind < 4:
            params = {"sensor": sensor, "threshold": threshold(), "field": rng.choice([None, "measurement", "datetime", "location"])}
            if rng.random() < 0.2:
                params["sensor"] = None
            return step(rng.choice(["filter_greater", "filter_less"]), **{k: v for k, v in params.items() if v is not None})
        if kind == 4:
            return step("filter_cross_field", filter_sensor=sensor, target_sensor=rng.choice(SENSORS), filter_threshold=threshold())
        if kind == 5:
            return step("normalize", min=0, max=rng.choice([0, 4]), sensor=sensor)
        return step(rng.choice(["sum", "max"]), "location", sensor=sensor)

    return [job(f"j{i}", *[one() for _ in range(rng.randint(1, 3))]) for i in range(n)]


def test_the_index_equals_the_fold(spark):
    rng = random.Random(5)
    values = [*map(float, range(-4, 5)), 0.5, -0.0, NAN, INF, -INF, None]
    rows = [event(rng.choice(SENSORS), rng.choice(values), at=rng.choice([0, 0.5, 1, 30]), location=rng.choice("xy")) for _ in range(60)]
    rows.append(event("t", 9.0, text="no time"))
    events, jobs = frame(spark, rows), drawn_jobs(120)
    table = jobs_frame(spark, jobs)
    expected = collected(data_driven.run(events, table))
    assert len(expected) > 500
    assert collected(indexed.run(events, table)) == expected
    assert collected(indexed.run(events, table, broadcast_bytes=0)) == expected
    assert collected(compiled.run_jobs(events, jobs)) == expected
    assert indexed.run(events.where("false"), table).count() == 0
    assert indexed.run(events, table.where("false")).count() == 0


def test_binary_search(spark):
    rng = random.Random(6)
    cases = []
    for n in (0, 1, 2, 3, 7, 8, 100):
        values = sorted(rng.choice(range(20)) / 2 for _ in range(n))
        cases += [(values, b / 4) for b in range(-2, 42)]
    rows = spark.createDataFrame(cases, "v array<double>, b double")
    found = rows.select("v", "b", indexed.below(F.col("v"), F.col("b")).alias("n")).collect()
    assert all(r.n == bisect.bisect_left(r.v, r.b) for r in found)


def test_a_thousand_jobs_make_a_small_plan(spark):
    jobs = [job(f"j{i}", step("filter_greater", sensor="t", threshold=i)) for i in range(1000)]
    rows = compiled.run_jobs(frame(spark, [event("t", 3.5), event("t", 999.0)]), jobs)
    assert rows.count() == 4 + 999
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_jobs_of_one_list_share_its_work(spark):
    rng = random.Random(7)
    lists = [
        [step("filter_greater", sensor="t", threshold=2.5)],
        [step("filter_less", sensor="t", threshold=2.5), step("sum", "location", sensor="t")],
        [step("filter_greater", sensor="t", threshold=1), step("max", "location", sensor="t")],
        [step("sum", "location", sensor="h")],
        [step("filter_cross_field", filter_sensor="t", target_sensor="h", filter_threshold=1)],
    ]
    # Some names come twice, under one list or under two; those count twice, as in the fold.
    jobs = [job(f"j{rng.randrange(30)}", *rng.choice(lists)) for _ in range(60)]
    rows = [event(rng.choice(SENSORS), float(rng.randrange(6)), at=rng.choice([0, 30]), location=rng.choice("xy")) for _ in range(40)]
    events, table = frame(spark, rows), jobs_frame(spark, jobs)
    table = table.withColumn("jobId", F.when(F.col("jobId") != "j3", F.col("jobId")))
    expected = collected(data_driven.run(events, table))
    assert len(expected) > 300
    assert collected(indexed.run(events, table)) == expected
    assert collected(indexed.run(events, table, lot=2, block=2)) == expected
    assert indexed.lots(table).count() == len(lists)


def test_tables_beyond_the_bound_are_not_sent_through_the_driver(spark):
    """Rows that resemble each other make small files, by which Spark itself would broadcast them."""
    over = [step("filter_greater", sensor="t", threshold=i) for i in range(100)]
    jobs = [job(f"j{i}", s, *[step("max", sensor="t")] * (i % 2)) for i, s in enumerate(over)]
    events, table = frame(spark, [event("t", 3.5), event("t", 50.5)]), jobs_frame(spark, jobs)
    for run in (indexed.run, data_driven.run):
        rows = run(events, table, broadcast_bytes=0)
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_rows_move_by_the_lot_and_not_by_the_job(spark):
    """Names come after the last shuffle, and step lists with them."""
    jobs = [job(f"j{i}", step("filter_greater", sensor="t", threshold=2), *[step("max", sensor="t")] * (i % 2)) for i in range(100)]
    events = frame(spark, [event("t", 3.5), event("t", 50.5)])
    rows = indexed.run(events, jobs_frame(spark, jobs))
    above, named = [], 0
    for line in rows._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, node) for d, node in above if d < depth] + [(depth, line[depth:])]
        if "Generate explode(names" in line:
            named += 1
            assert not [node for _, node in above if node.startswith("Exchange")]
    assert named == 2
    assert rows.count() == 50 * 2 + 50
    assert rows.select("job_id").distinct().count() == 100 and rows.where("transformations[0].type is null").count() == 0
