"""Row types shared by every stage: events, job configs and results."""

from __future__ import annotations

from pyspark.sql import types as T

# Event fields as they are named in JSON messages.
EVENT_JSON = T.StructType(
    [
        T.StructField("jobId", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("measurement", T.DoubleType()),
        T.StructField("measurement_unit", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("data_quality", T.StringType()),
    ]
)

# The same seven fields as columns: config-facing name -> column name.
EVENT_FIELDS = {
    "jobId": "job_id",
    "sensor": "sensor",
    "measurement": "measurement",
    "measurement_unit": "measurement_unit",
    "datetime": "datetime",
    "location": "location",
    "data_quality": "data_quality",
}

# Fields the text-cleaning steps may change.
CLEANABLE_FIELDS = ("location", "sensor", "measurement_unit", "data_quality")

# Columns every event DataFrame carries: the seven fields, the parsed instant and a
# number that orders arrivals.
EVENT_COLUMNS = (*EVENT_FIELDS.values(), "event_ts", "arrival_seq")

STEP = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("keyBy", T.StringType()),
    ]
)
STEPS = T.ArrayType(STEP)

JOB_CONFIG = T.StructType(
    [
        T.StructField("jobId", T.StringType()),
        T.StructField("transformations", STEPS),
        T.StructField("outputTopic", T.StringType()),
    ]
)

EVENT_DOCUMENT = T.StructType(
    [
        T.StructField("sensor", T.StringType()),
        T.StructField("measurement", T.DoubleType()),
        T.StructField("measurementUnit", T.StringType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("dataQuality", T.StringType()),
    ]
)

WINDOW = T.StructType(
    [T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType())]
)

RESULT = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("result_kind", T.StringType()),
        T.StructField("grouping_field", T.StringType()),
        T.StructField("grouping_key", T.StringType()),
        T.StructField("aggregation_type", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("result_double", T.DoubleType()),
        T.StructField("result_string", T.StringType()),
        T.StructField("result_event", EVENT_DOCUMENT),
        T.StructField("sensor_type", T.StringType()),
        T.StructField("measurement_unit", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("transformations", STEPS),
        T.StructField("steps_hash", T.StringType()),
        T.StructField("window", WINDOW),
        T.StructField("seq", T.LongType()),
    ]
)
RESULT_COLUMNS = tuple(RESULT.fieldNames())
