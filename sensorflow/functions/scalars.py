"""Column functions whose null, NaN and rounding rules differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An instant needs a date, a time with seconds and a zone; bare dates do not count.
INSTANT_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?"
    r"([Zz]|[+-][0-9]{2}:[0-9]{2})$"
)
NAN = float("nan")


def instant(text: Column) -> Column:
    """ISO instant text to TIMESTAMP; anything else is null."""
    return F.when(text.rlike(INSTANT_PATTERN), F.try_to_timestamp(F.upper(text)))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts).cast("double")


def instant_text(ts: Column) -> Column:
    """UTC instant as text, with as many fraction digits (0, 3 or 6) as it needs."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return (
        F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.pmod(micros, F.lit(1000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )


def strip_control(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends (Spark's trim strips blanks only)."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def quotient(n: Column, d: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN instead of an error."""
    by_zero = (
        F.when(F.isnan(n) | (n == 0), F.lit(NAN))
        .when(n > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(d == 0, by_zero).otherwise(n / d)


def clamp(v: Column, low: Column, high: Column) -> Column:
    """Bound v to [low, high]; NaN stays NaN and null stays null."""
    return F.when(v.isNull() | F.isnan(v), v).otherwise(F.greatest(low, F.least(high, v)))


def min_max_scale(v: Column, low: Column, high: Column) -> Column:
    return clamp(quotient(v - low, high - low), F.lit(0.0), F.lit(1.0))


def round_half_up(v: Column, digits: int = 1) -> Column:
    """Round with ties towards positive infinity (Spark's round sends them away from zero)."""
    scale = F.lit(float(10**digits))
    return F.when(
        v.isNull() | F.isnan(v) | (F.abs(v) >= F.lit(1e15)), v
    ).otherwise(F.floor(v * scale + F.lit(0.5)).cast("double") / scale)


def ordered(*numbers: Column) -> Column:
    """True where no operand is NaN: only then does Spark order numbers as IEEE does."""
    check = ~F.isnan(numbers[0])
    for n in numbers[1:]:
        check = check & ~F.isnan(n)
    return check


def window_of(ts: Column, seconds: int) -> Column:
    """Epoch-aligned tumbling window as STRUCT<start, end>; a null time keeps a null window."""
    width = seconds * 1_000_000
    micros = F.unix_micros(ts)
    start = micros - F.pmod(micros, F.lit(width))
    return F.when(
        ts.isNotNull(),
        F.struct(
            F.timestamp_micros(start).alias("start"),
            F.timestamp_micros(start + F.lit(width)).alias("end"),
        ),
    )
