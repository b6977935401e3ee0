"""What a job emits and how windows aggregate it; every case runs both ways."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from support import INF, NAN, Cases, collected, event, frame, job, step

from sensorflow.operators import aggregates, configs
from sensorflow.plans import compiled, data_driven
from sensorflow.plans.job import jobs_frame, load_jobs

JOBS = Path(__file__).resolve().parents[1] / "jobs"
CASES = Cases()
PARAMETERS = []


def case(name, rows, steps, columns, expected):
    """Expected rows of the named result columns, in any order."""
    PARAMETERS.append(pytest.param(CASES.add(rows, *steps), columns.split(), expected, id=name))


ROWS = [event("t", 50.0, location="a"), event("t", 10.0, location="b"), event("h", 99.0)]
ABOVE_20, ABOVE_90 = (step("filter_greater", sensor="t", threshold=x) for x in (20, 90))
PASSED = "passthrough"

# The output rule, row by row.
case("no usable step", ROWS, [[step("unheard_of", sensor="t")]], "kind seq", [(PASSED, 0), (PASSED, 1)])
case("elements only", ROWS, [[ABOVE_20]], "kind seq", [(PASSED, 0)])
case(
    "each matching aggregation",
    ROWS,
    [[step("max", "location", sensor="t"), step("sum", "sensor", sensor="t"), step("min", sensor="h")]],
    "agg key double",
    [("max", "a", 50.0), ("max", "b", 10.0), ("sum", "t", 60.0)],
)
case("fallback", ROWS, [[ABOVE_20, step("max", sensor="h")]], "kind seq", [(PASSED, 0)])
case("dropped", ROWS, [[ABOVE_90, step("max", sensor="h")]], "kind seq", [])
case("aggregation listed first", ROWS, [[step("max", sensor="t"), ABOVE_20]], "key double", [("t", 50.0)])
case(
    "fallback after renaming",
    ROWS,
    [[step("to_uppercase", sensor="t", field="sensor"), step("max", sensor="t")]],
    "kind key",
    [(PASSED, "T")] * 2,
)
case(
    "aggregation after renaming",
    ROWS,
    [[step("to_uppercase", sensor="t", field="sensor"), step("max", sensor="T")]],
    "kind key",
    [("aggregate", "T")],
)
case(
    "null field ends in an error",
    ROWS[:1],
    [[step("max", sensor="t"), step("sum", field=None), step("min", sensor="t")]],
    "kind agg double",
    [("aggregate", "max", 50.0), ("error", None, None)],
)
case(
    "null field of another sensor",
    ROWS[:1],
    [[step("max", sensor="t"), step("sum", sensor="h", field=None)]],
    "kind",
    [("aggregate",)],
)
case(
    "unusable parameter",
    ROWS,
    [[step("filter_greater", sensor="t", threshold="abc"), step("max", sensor="t")]],
    "kind seq sensor",
    [("error", 0, None), ("error", 1, None)],
)
CROSS = step("filter_cross_field", filter_sensor="t", filter_threshold=20, target_sensor="h")
case("cross filter routes both", ROWS, [[CROSS, step("max", "sensor")]], "key double", [("h", 99.0), ("t", 50.0)])
case(
    "jobs see the original event",
    ROWS[:1],
    [[step("normalize", sensor="t", min=0, max=100)], [ABOVE_20]],
    "job_id measurement",
    [("0", 0.5), ("1", 50.0)],
)

# Aggregates of edge values.
for numbers, expected in [
    ([None], (0.0, 0.0, 0.0, 0.0)),
    ([1.5, None, 2.5], (4.0, 2.5, 1.5, 2.0)),
    ([NAN, 3.0], ("nan", 3.0, 3.0, "nan")),
    ([NAN], ("nan", 0.0, 0.0, "nan")),
    ([-INF], (-INF, 0.0, -INF, -INF)),
    ([INF], (INF, INF, 0.0, INF)),
    ([-3.0, -1.0], (-4.0, -1.0, -3.0, -2.0)),
]:
    kinds = ("sum", "max", "min", "avg")
    case(
        f"aggregates of {numbers}",
        [event("t", v) for v in numbers],
        [[step(k, sensor="t") for k in kinds]],
        "agg double",
        list(zip(kinds, expected, strict=True)),
    )

ONE_SUM = [[step("sum", sensor="t")]]
case(
    "windows are aligned and half open",
    [event("t", 1.0, at=9.999), event("t", 2.0, at=10.0), event("t", 4.0, at=19.5)],
    ONE_SUM,
    "start double",
    [(1767225600, 1.0), (1767225610, 6.0)],
)
case(
    "events without a time are kept",
    [event("t", 1.0), event("t", 2.0, text="junk")],
    ONE_SUM,
    "start double",
    [(1767225600, 1.0), (None, 2.0)],
)
case(
    "latest datetime",
    [event("t", 1.0, at=1), event("t", 1.0, at=8.5)],
    [[step("max", sensor="t", field="datetime"), step("min", sensor="t", field="datetime")]],
    "agg string double",
    [("max", "2026-01-01T00:00:08.500Z", None), ("min", "2026-01-01T00:00:01Z", None)],
)
case(
    "context of the earliest arrival",
    [event("t", 1.0, location="late", seq=5), event("t", 2.0, location="early", unit="u", seq=3)],
    ONE_SUM,
    "place unit seq double",
    [("early", "u", 3, 3.0)],
)
case(
    "fields and group fields do not merge",
    [event("t", 1.0, location="t")],
    [[step("max", "sensor", sensor="t"), step("max", "location", sensor="t"), step("max", "sensor", sensor="t", field="x")]],
    "by field double",
    [("location", "measurement", 1.0), ("sensor", "measurement", 1.0), ("sensor", "x", 0.0)],
)
KEYS = {
    "sensor": "t",
    "measurement": "1.0E10",
    "measurement_unit": "U",
    "datetime": "2026-01-01T00:00:00.000000Z",
    "location": "L",
    "data_quality": "Q",
    "jobId": "unknown",
    "altitude": "unknown",
}
case(
    "every group field",
    [event("t", 1e10, location="L", unit="U", quality="Q")],
    [[step("max", k, sensor="t") for k in KEYS]],
    "by key",
    list(KEYS.items()),
)


@pytest.mark.parametrize(("n", "columns", "expected"), PARAMETERS)
def test_output(spark, n, columns, expected):
    got = [tuple(r[c] for c in columns) for r in CASES.results(spark, n)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_user_aggregate(spark):
    aggregates.register_aggregate("range", lambda: F.col("high") - F.col("low"))
    try:
        cases = Cases()
        n = cases.add(ROWS, [step("range", sensor="t")])
        assert [r["double"] for r in cases.results(spark, n)] == [40.0]
    finally:
        del aggregates.AGGREGATES["range"]


OUTCOMES = {
    "stale-air-peaks": {("aggregate", "max")},
    "damp-corners": {("aggregate", "avg")},
    "bright-spots": {("aggregate", "min")},
    "dry-spell-start": {("aggregate", "min")},
    "loudest-moments": {("aggregate", "max")},
    "humidity-share": {("aggregate", "max")},
    "pressure-floor": {("aggregate", "min")},
    "tidy-light-average": {("aggregate", "avg")},
    "warm-readings": {("passthrough", None)},
    "dim-readings": {("passthrough", None)},
    "noise-share": {("passthrough", None)},
    "tidy-pressure-places": {("passthrough", None)},
    "noise-without-light": {("passthrough", None)},
}


PLACES = ("attic", "cellar", "front-yard", "hall")


def sample_rows(n, seed):
    rng = random.Random(seed)
    spans = dict(temperature=60, pressure=2100, humidity=100, air_quality=200, light=1000, noise=80)
    rows = []
    for i in range(n):
        sensor = rng.choice([*spans])
        value = rng.choice([None, NAN, *[round(rng.random() * spans[sensor], 1)] * 12])
        place = rng.choice([None, *[p.title() + " " for p in PLACES]])
        rows.append(event(sensor, value, at=rng.random() * 60, location=place, unit="u", seq=i))
    return rows


def test_the_thirteen_jobs(spark):
    jobs = load_jobs(JOBS)
    assert {j.job_id for j in jobs} == set(OUTCOMES)
    _, rejected = configs.validate_configs(jobs_frame(spark, jobs))
    assert rejected.count() == 0
    events = frame(spark, sample_rows(400, 1))
    out = collected(compiled.run_jobs(events, jobs))
    seen = {}
    for r in out:
        seen.setdefault(r["job_id"], set()).add((r["kind"], r["agg"]))
    assert seen == OUTCOMES
    one = next(j for j in jobs if j.job_id == "tidy-light-average")
    assert collected(compiled.run_job(events, one)) == [r for r in out if r["job_id"] == one.job_id]


def random_job(rng, n):
    home = rng.choice(["temperature", "pressure", "humidity"])

    def sensor():
        return rng.choice([home, home, home, home, None, home.upper(), "pressure"])

    def params(**kw):
        s = sensor()
        return {**kw, **({"sensor": s} if s is not None or rng.random() < 0.3 else {})}

    makers = [
        lambda: step("filter_greater", **params(threshold=rng.choice([10, "20.5", 5, 1, 0, "bad"]))),
        lambda: step("filter_less", **params(threshold=600, field=rng.choice(["measurement", "measurement", None]))),
        lambda: step("normalize", **params(min=0, max=rng.choice([0, 50]))),
        lambda: step("to_uppercase", **params(field=rng.choice(["sensor", "location", "x"]))),
        lambda: step("trim_whitespace", **params(field="location")),
        lambda: step(
            "filter_cross_field",
            filter_sensor=sensor(),
            target_sensor=sensor(),
            filter_operator=rng.choice([">", "<=", "=", None, "?"]),
            filter_threshold=rng.choice([30, 5.5]),
        ),
        lambda: step("median", **params()),
        *[
            lambda: step(
                rng.choice(["sum", "max", "min", "avg"]),
                rng.choice([None, "location", "sensor", "measurement_unit", "depth"]),
                **params(field=rng.choice(["measurement"] * 4 + ["datetime", "none", None])),
            )
        ]
        * 3,
    ]
    steps = [rng.choice(makers)() for _ in range(rng.randint(1, 4))]
    return job(f"job-{n}", step("to_lowercase", sensor=home, field="location"), *steps)


def test_all_plans_agree_on_random_jobs(spark):
    rng = random.Random(7)
    jobs = [random_job(rng, n) for n in range(16)]
    jobs.append(job("bad", step("filter_less", sensor="humidity", threshold="much")))
    events = frame(spark, sample_rows(150, 2))
    expected = collected(compiled.run_jobs(events, jobs))
    assert {r["kind"] for r in expected} == {"aggregate", "passthrough", "error"}
    assert collected(data_driven.run(events, jobs_frame(spark, jobs))) == expected
    shuffled = data_driven.run(events, jobs_frame(spark, jobs), broadcast_bytes=0)
    assert collected(shuffled) == expected
