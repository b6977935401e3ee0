"""What a job emits for one event: aggregation inputs, a passthrough row or an error row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.operators.steps import Params, RowState
from sensorflow.schemas import EVENT_DOCUMENT, EVENT_FIELDS, RESULT

AGGREGATE, PASSTHROUGH, ERROR = "aggregate", "passthrough", "error"

# A job's own id replaces the event's in the output, so the event part is six fields.
DOCUMENT_FIELDS = tuple(c for c in EVENT_FIELDS.values() if c != "job_id")
OUTPUT_FIELDS = (*DOCUMENT_FIELDS, "event_ts", "arrival_seq")


def grouping_value(fields: Mapping[str, Column], key_by: Params) -> Column:
    """The event field that `keyBy` names (sensor if absent), as text; 'unknown' for none."""

    def chosen(left: list[str]) -> Column:
        if not left:
            return F.lit("unknown")
        name, *rest = left
        value = fields[EVENT_FIELDS[name]]
        return key_by.equals(
            "keyBy",
            name,
            lambda: F.coalesce(value.cast("string"), F.lit("unknown")),
            lambda: chosen(rest),
            default="sensor",
        )

    return chosen([*EVENT_FIELDS])


def aggregation_input(
    row: RowState, type_name: Column, key_by: Column, field: Column, p: Params
) -> Column:
    """The columns an aggregation step adds to the event.

    `p` holds the field as "field" and the grouping field as "keyBy".
    """
    f = row.fields
    nothing = F.lit(None)
    return F.struct(
        F.lit(AGGREGATE).alias("result_kind"),
        key_by.alias("grouping_field"),
        grouping_value(f, p).alias("grouping_key"),
        type_name.alias("aggregation_type"),
        field.alias("field"),
        p.equals("field", "measurement", lambda: f["measurement"], lambda: nothing.cast("double")).alias("value"),
        p.equals("field", "datetime", lambda: f["event_ts"], lambda: nothing.cast("timestamp")).alias("value_ts"),
    )


def whole_event(row: RowState, kind: str) -> Column:
    """The same columns for a row that carries the event itself, or an error about it."""
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("result_kind"),
        F.lit("sensor").alias("grouping_field"),
        row.fields["sensor"].alias("grouping_key"),
        none.cast("string").alias("aggregation_type"),
        none.cast("string").alias("field"),
        none.cast("double").alias("value"),
        none.cast("timestamp").alias("value_ts"),
    )


def wants(row: RowState, p: Params) -> Column:
    """Does an aggregation step take this event? It must name the event's present sensor, or none."""
    return F.coalesce(p.absent_or_matches("sensor", row.fields["sensor"]), F.lit(False))


def event_document(fields: Mapping[str, Column]) -> Column:
    return F.struct(
        *[fields[n].alias(f.name) for n, f in zip(DOCUMENT_FIELDS, EVENT_DOCUMENT, strict=True)]
    )


def direct_results(rows: DataFrame) -> DataFrame:
    """Passthrough and error rows to result rows."""
    values = {
        "result_event": F.when(
            F.col("result_kind") == PASSTHROUGH, event_document({c: F.col(c) for c in DOCUMENT_FIELDS})
        ),
        "sensor_type": F.col("sensor"),
        "seq": F.col("arrival_seq"),
    }
    ready = {*rows.columns}
    return rows.select(
        *[
            values.get(f.name, F.col(f.name) if f.name in ready else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in RESULT
        ]
    )
