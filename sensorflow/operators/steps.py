"""Element steps as Column rewrites.

A step takes the state of a row (is it still kept, what are its fields) and its
parameters, and returns the new state. Parameters are literals when the job is known while
the plan is built, and map lookups when the job arrives as data. One builder serves both:
choices on a literal are made at once and leave a plain predicate, choices on a map
become CASE expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sensorflow.functions import scalars
from sensorflow.schemas import CLEANABLE_FIELDS

_PLAIN_NUMBER = re.compile(r"[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?")

# Numeric parameters a step cannot do without.
REQUIRED_NUMBERS = {
    "filter_greater": ("threshold",),
    "filter_less": ("threshold",),
    "filter_cross_field": ("filter_threshold",),
    "normalize": ("min", "max"),
}

# Steps that change a text field.
CLEANERS = ("to_lowercase", "to_uppercase", "trim_whitespace")


@lru_cache(maxsize=4096)
def as_double(text: str | None) -> float | None:
    """Text as a number by Spark's own cast, so that literals and map lookups agree."""
    if text is None:
        return None
    if _PLAIN_NUMBER.fullmatch(text):
        return float(text)
    one_row = SparkSession.active().sql("SELECT 1")
    return one_row.select(F.lit(text).try_cast("double")).first()[0]


class Params:
    """Parameters of one step."""

    def equals(
        self,
        name: str,
        value: str,
        then: Callable[[], Column],
        otherwise: Callable[[], Column],
        default: str | None = None,
    ) -> Column:
        """`then` where the parameter (or its default) is `value`."""
        raise NotImplementedError

    def matches(self, name: str, column: Column) -> Column:
        """Null where the parameter is absent, else whether the column equals it."""
        raise NotImplementedError

    def absent_or_matches(self, name: str, column: Column) -> Column:
        raise NotImplementedError

    def number(self, name: str) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class LiteralParams(Params):
    values: Mapping[str, str | None]

    def equals(self, name, value, then, otherwise, default=None):
        given = self.values.get(name)
        return then() if (default if given is None else given) == value else otherwise()

    def matches(self, name, column):
        given = self.values.get(name)
        return F.lit(None).cast("boolean") if given is None else column == given

    def absent_or_matches(self, name, column):
        return F.lit(True) if self.values.get(name) is None else self.matches(name, column)

    def number(self, name):
        return F.lit(as_double(self.values.get(name))).cast("double")


@dataclass(frozen=True)
class ColumnParams(Params):
    column: Column

    def text(self, name: str, default: str | None = None) -> Column:
        value = F.try_element_at(self.column, F.lit(name))
        return value if default is None else F.coalesce(value, F.lit(default))

    def equals(self, name, value, then, otherwise, default=None):
        return F.when(self.text(name, default) == value, then()).otherwise(otherwise())

    def matches(self, name, column):
        return column == self.text(name)

    def absent_or_matches(self, name, column):
        return self.text(name).isNull() | self.matches(name, column)

    def number(self, name):
        return self.text(name).try_cast("double")


@dataclass(frozen=True)
class StructParams(ColumnParams):
    """Parameters already taken out of the map and cast (see configs.prepared)."""

    resolved: tuple[str, ...] = ()

    def text(self, name: str, default: str | None = None) -> Column:
        if name not in self.resolved:
            return ColumnParams(self.column["params"]).text(name, default)
        value = self.column[name]
        return value if default is None else F.coalesce(value, F.lit(default))

    def number(self, name):
        return self.column[name] if name in self.resolved else super().number(name)


@dataclass(frozen=True)
class RowState:
    fields: Mapping[str, Column]
    conditions: tuple[Column, ...] = field(default=())

    @property
    def keep(self) -> Column:
        kept = F.lit(True)
        for n, c in enumerate(self.conditions):
            kept = kept & c if n else c
        return kept

    def where(self, condition: Column) -> RowState:
        return replace(self, conditions=(*self.conditions, condition))

    def having(self, **changed: Column) -> RowState:
        return replace(self, fields={**self.fields, **changed})

    def number_of(self, name: str, p: Params) -> Column:
        """The field a parameter names, as a number: measurement, or datetime in epoch ms."""
        return p.equals(
            name,
            "measurement",
            lambda: self.fields["measurement"],
            lambda: p.equals(
                name,
                "datetime",
                lambda: scalars.epoch_millis(self.fields["event_ts"]),
                lambda: F.lit(None).cast("double"),
            ),
            default="measurement",
        )


StepBuilder = Callable[[RowState, Params], RowState]


def _threshold_filter(compare: Callable[[Column, Column], Column]) -> StepBuilder:
    def build(row: RowState, p: Params) -> RowState:
        value, limit = row.number_of("field", p), p.number("threshold")
        right_sensor = p.absent_or_matches("sensor", row.fields["sensor"])
        return row.where(right_sensor & compare(value, limit) & scalars.ordered(value, limit))

    return build


def _cross_filter(row: RowState, p: Params) -> RowState:
    value, limit = row.number_of("filter_field", p), p.number("filter_threshold")
    tests = {
        ">": lambda: value > limit,
        "<": lambda: value < limit,
        ">=": lambda: value >= limit,
        "<=": lambda: value <= limit,
        "=": lambda: F.abs(value - limit) < F.lit(0.001),
        "==": lambda: F.abs(value - limit) < F.lit(0.001),
    }

    def chosen(left: list[str]) -> Column:
        if not left:
            return F.lit(False)
        op, *rest = left
        return p.equals("filter_operator", op, tests[op], lambda: chosen(rest), default=">")

    sensor = row.fields["sensor"]
    is_target = F.coalesce(p.matches("target_sensor", sensor), F.lit(False))
    tested = p.matches("filter_sensor", sensor) & chosen([*tests]) & scalars.ordered(value, limit)
    return row.where(is_target | tested)


def _normalize(row: RowState, p: Params) -> RowState:
    v = row.fields["measurement"]
    scaled = p.equals(
        "field",
        "measurement",
        lambda: scalars.min_max_scale(v, p.number("min"), p.number("max")),
        lambda: v,
        default="measurement",
    )
    return row.having(measurement=scaled)


def _text_step(clean: Callable[[Column], Column]) -> StepBuilder:
    def build(row: RowState, p: Params) -> RowState:
        def cleaned(f: str) -> Column:
            now = row.fields[f]
            return p.equals("field", f, lambda: clean(now), lambda: now, default="location")

        return row.having(**{f: cleaned(f) for f in CLEANABLE_FIELDS})

    return build


STEP_BUILDERS: dict[str, StepBuilder] = {
    "filter_greater": _threshold_filter(lambda v, t: v > t),
    "filter_less": _threshold_filter(lambda v, t: v < t),
    "filter_cross_field": _cross_filter,
    "normalize": _normalize,
    "to_lowercase": _text_step(F.lower),
    "to_uppercase": _text_step(F.upper),
    "trim_whitespace": _text_step(scalars.strip_control),
}


def register_step(name: str, builder: StepBuilder) -> None:
    """Add a user-defined element step; jobs may name it in their step list."""
    STEP_BUILDERS[name] = builder


def step(type_name: str) -> StepBuilder:
    try:
        return STEP_BUILDERS[type_name]
    except KeyError:
        raise ValueError(f"Unknown transformation type: {type_name}") from None


def usable(type_name: Column, p: Params) -> Column:
    """False where a numeric parameter the step needs is missing or not a number."""
    out = F.lit(True)
    for name, numbers in REQUIRED_NUMBERS.items():
        for n in numbers:
            out = out & ((type_name != name) | p.number(n).isNotNull())
    return F.coalesce(out, F.lit(True))
