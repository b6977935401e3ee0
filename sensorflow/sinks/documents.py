"""Results as documents: identity, collection and JSON shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.functions import scalars

# The id format and what stands for a missing part -------------
ID_FORMAT = "job:%s|g:%s:%s|agg:%s|f:%s|h:%s"
ID_DEFAULTS = {
    "job_id": "unknown",
    "grouping_field": "default",
    "grouping_key": "default",
    "aggregation_type": "none",
    "field": "default",
    "steps_hash": "0",
}


def result_id() -> Column:
    parts = [F.coalesce(F.col(c), F.lit(d)) for c, d in ID_DEFAULTS.items()]
    return F.format_string(ID_FORMAT, *parts)


def collection_name(job_id: Column) -> Column:
    blank = job_id.isNull() | (scalars.strip_control(job_id) == "")
    return F.when(blank, F.lit("unknown_job")).otherwise(
        F.regexp_replace(job_id, "[^a-zA-Z0-9_]", "_")
    )


def identified(results: DataFrame) -> DataFrame:
    return results.select(
        result_id().alias("_id"), collection_name(F.col("job_id")).alias("collection"), "*"
    )


def _member(name: str, value: Column) -> Column:
    """`"name":value` as JSON text; a null value is written out as null."""
    whole = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def result_document(processed_at: Column) -> Column:
    """JSON document of an identified result row.

    Identity, grouping, result and time are always present; the step list and the sensor
    context only where they have a value.
    """
    kind = F.col("result_kind")
    result = (
        F.when(kind == "passthrough", _member("result", F.col("result_event")))
        .when(F.col("result_string").isNotNull(), _member("result", F.col("result_string")))
        .otherwise(_member("result", F.col("result_double")))
    )
    always = {
        "_id": "_id",
        "jobId": "job_id",
        "groupingField": "grouping_field",
        "groupingKey": "grouping_key",
        "aggregationType": "aggregation_type",
        "field": "field",
    }
    optional = {
        "transformations": "transformations",
        "sensorType": "sensor_type",
        "measurementUnit": "measurement_unit",
        "location": "location",
    }
    members = [
        *[_member(name, F.col(c)) for name, c in always.items()],
        result,
        _member("processedAt", scalars.instant_text(processed_at)),
        *[F.when(F.col(c).isNotNull(), _member(name, F.col(c))) for name, c in optional.items()],
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def event_messages(events: DataFrame) -> DataFrame:
    """(key, value) rows for a keyed event log: key is the sensor, value the event as JSON."""
    from sensorflow.schemas import EVENT_FIELDS

    body = F.struct(*[F.col(c).alias(n) for n, c in EVENT_FIELDS.items()])
    return events.select(
        F.coalesce("sensor", F.lit("unknown")).alias("key"), F.to_json(body).alias("value")
    )
