"""Element steps on edge values; every case runs compiled and data-driven."""

import pytest
from support import INF, NAN, Cases, event, step

CASES = Cases()
PARAMETERS = []


def case(name, rows, steps, expected, column="measurement"):
    PARAMETERS.append(pytest.param(CASES.add(rows, steps), expected, column, id=name))


def values(*numbers, sensor="t"):
    return [event(sensor, v) for v in numbers]


EDGES = values(10.0, 10.1, 9.9, None, NAN, INF, -INF)

case("greater", EDGES, [step("filter_greater", sensor="t", threshold=10)], {1: 10.1, 5: INF})
case("less", EDGES, [step("filter_less", sensor="t", threshold=10)], {2: 9.9, 6: -INF})
case("threshold as text", EDGES, [step("filter_greater", sensor="t", threshold="10.0")], {1: 10.1, 5: INF})
case("threshold NaN", EDGES, [step("filter_less", sensor="t", threshold="NaN")], {})
TIMED = [event("t", 1.0, at=s) for s in (0, 1, 2)] + [event("t", 1.0, text="not-a-time")]
case("datetime", TIMED, [step("filter_greater", sensor="t", field="datetime", threshold=1767225601000)], {2: 1.0})
case("unknown field", TIMED, [step("filter_greater", sensor="t", field="location", threshold=0)], {})
case(
    "other sensor",
    values(5.0),
    [step("filter_greater", sensor="t", threshold=1), step("filter_less", sensor="u", threshold=9)],
    {},
)

CROSSED = [event("f", v) for v in (20.0, 21.0, 19.0, 20.0005, 20.0015, NAN)] + [
    event("target", None),
    event("other", 20.0),
]
for op, kept in {
    ">": {1, 3, 4},
    "<": {2},
    ">=": {0, 1, 3, 4},
    "<=": {0, 2},
    "=": {0, 3},
    "==": {0, 3},
    "!=": set(),
    None: {1, 3, 4},
}.items():
    s = step("filter_cross_field", filter_sensor="f", filter_threshold=20, target_sensor="target", filter_operator=op)
    case(f"cross {op}", CROSSED, [s], {**{i: CROSSED[i][1] for i in kept}, 6: None})

case(
    "normalize",
    values(0.0, 25.0, 100.0, 150.0, -5.0, None, NAN, INF, -INF),
    [step("normalize", sensor="t", min=0, max="100")],
    {0: 0.0, 1: 0.25, 2: 1.0, 3: 1.0, 4: 0.0, 5: None, 6: "nan", 7: 1.0, 8: 0.0},
)
case("normalize flat", values(4.0, 5.0, 6.0, NAN), [step("normalize", sensor="t", min=5, max=5)], {0: 0.0, 1: "nan", 2: 1.0, 3: "nan"})
case("normalize elsewhere", values(50.0), [step("normalize", sensor="t", field="location", min=0, max=1)], {0: 50.0})

TEXTS = [event("t", 1.0, location=x) for x in ("  Lobby \t", "\x00\x1fA b\n", None, "", " x ")]
case("trim", TEXTS, [step("trim_whitespace", sensor="t")], {0: "Lobby", 1: "A b", 2: None, 3: "", 4: "x"}, "location")
case("lower", TEXTS, [step("to_lowercase", sensor="t")], {0: "  lobby \t", 1: "\x00\x1fa b\n", 2: None, 3: "", 4: " x "}, "location")
case("upper", TEXTS, [step("to_uppercase", sensor="t")], {0: "  LOBBY \t", 1: "\x00\x1fA B\n", 2: None, 3: "", 4: " X "}, "location")
WORDS = [event("Te", 1.0, location="L", unit="U", quality="Q")]
for field in ("sensor", "measurement_unit", "data_quality", "location", "nothing"):
    s = [step("to_lowercase", sensor="Te", field=field)]
    for column, word, name in (
        ("sensor", "Te", "sensor"),
        ("event_unit", "U", "measurement_unit"),
        ("quality", "Q", "data_quality"),
        ("location", "L", "location"),
    ):
        case(f"lower {field}: {name}", WORDS, s, {0: word.lower() if name == field else word}, column)

SCALE, ABOVE_ONE = step("normalize", min=0, max=100), step("filter_greater", sensor="t", threshold=1)
case("scale then filter", values(50.0), [SCALE, ABOVE_ONE], {})
case("filter then scale", values(50.0), [ABOVE_ONE, SCALE], {0: 0.5})
UP = step("to_uppercase", field="sensor")
case("renamed sensor misses", values(5.0), [UP, ABOVE_ONE], {})
case(
    "renamed sensor is met",
    values(5.0),
    [step("normalize", sensor="t", min=0, max=10), UP, step("filter_greater", sensor="T", threshold=0)],
    {0: 0.5},
)


@pytest.mark.parametrize(("n", "expected", "column"), PARAMETERS)
def test_step(spark, n, expected, column):
    assert {r["seq"]: r[column] for r in CASES.results(spark, n)} == expected


def test_user_step(spark):
    from sensorflow.operators.steps import STEP_BUILDERS, register_step

    register_step("multiply", lambda row, p: row.having(measurement=row.fields["measurement"] * p.number("by")))
    try:
        cases = Cases()
        n = cases.add(values(4.0), [step("multiply", sensor="t", by=2.5)])
        assert [r["measurement"] for r in cases.results(spark, n)] == [10.0]
    finally:
        del STEP_BUILDERS["multiply"]


def test_unknown_step_type_is_an_error():
    from sensorflow.operators.steps import step as lookup

    with pytest.raises(ValueError, match="Unknown transformation type: median"):
        lookup("median")
