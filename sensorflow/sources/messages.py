"""Raw messages to events and configs, with everything unusable set aside and labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorflow.functions import scalars
from sensorflow.functions.once import computed_once
from sensorflow.schemas import EVENT_FIELDS, EVENT_JSON, JOB_CONFIG

_CORRUPT = "_corrupt_record"
_JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": _CORRUPT,
    "allowNonNumericNumbers": "false",
}


def decode_utf8(value: Column) -> Column:
    """Bytes as text; malformed sequences become U+FFFD and do not fail."""
    return F.make_valid_utf8(value.cast("string"))


def non_empty(messages: DataFrame) -> DataFrame:
    return messages.where(F.length("value") > 0)


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])


def parse_events(messages: DataFrame) -> DataFrame:
    """One row per non-empty message: event columns and `reason`, null for a good event.

    `messages` has `value` (text or bytes) and may have `arrival_seq` and `arrival_ts`. An
    event without a usable `datetime` takes its arrival time where there is one. The raw
    text stays in `raw`; Spark leaves it out of any plan that does not use it.
    """
    has = {*messages.columns}
    decoded = non_empty(messages).select(
        decode_utf8(F.col("value")).alias("raw"),
        (F.col("arrival_seq") if "arrival_seq" in has else F.lit(None)).cast("long").alias("arrival_seq"),
        (F.col("arrival_ts") if "arrival_ts" in has else F.lit(None)).cast("timestamp").alias("arrival_ts"),
    )
    document = F.from_json("raw", _with_corrupt(EVENT_JSON), _JSON_OPTIONS)
    parsed = computed_once(decoded, "e", document)
    e = F.col("e")
    # An explicit null is no measurement, unlike an absent one. Only rows whose parsed
    # measurement is null pay for the second look at the text.
    named = F.array_contains(F.json_object_keys("raw"), "measurement")
    explicit_null = e["measurement"].isNull() & F.coalesce(named, F.lit(False))
    reason = (
        F.when(e.isNull() | e[_CORRUPT].isNotNull(), F.lit("corrupt"))
        .when(explicit_null, F.lit("null_measurement"))
        .when(e["sensor"].isNull(), F.lit("missing_sensor"))
    )
    return parsed.select(
        *[e[name].alias(column) for name, column in EVENT_FIELDS.items()],
        F.coalesce(scalars.instant(e["datetime"]), F.col("arrival_ts")).alias("event_ts"),
        "arrival_seq",
        reason.alias("reason"),
        "raw",
    )


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").drop("reason", "raw")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NOT NULL").select("raw", "reason", "arrival_seq")


def parse_configs(messages: DataFrame) -> DataFrame:
    """One row per non-empty message: config columns and `reason`, null where it parsed."""
    parsed = non_empty(messages).withColumn("raw", decode_utf8(F.col("value")))
    options = {**_JSON_OPTIONS, "allowNonNumericNumbers": "true"}
    parsed = computed_once(
        parsed, "c", F.from_json("raw", _with_corrupt(JOB_CONFIG), options)
    )
    c = F.col("c")
    others = [n for n in messages.columns if n != "value"]
    return parsed.select(
        *[c[f.name].alias(f.name) for f in JOB_CONFIG],
        *others,
        F.when(c.isNull() | c[_CORRUPT].isNotNull(), F.lit("corrupt")).alias("reason"),
        "raw",
    )


def read_job_files(spark: SparkSession, directory: str) -> DataFrame:
    """A folder of config documents, one object per file; fields we do not know are ignored."""
    return spark.read.schema(JOB_CONFIG).option("multiLine", True).json(directory)
