"""Raw messages derived from the activity table: decoding, parsing, quarantine, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.catalog.common import events, source
from sensorflow.catalog.configurations import activity, registrations
from sensorflow.functions import scalars
from sensorflow.operators import configs
from sensorflow.session import use_utc, work_dir
from sensorflow.sinks import documents
from sensorflow.sources import messages, streams


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per activity row; each kind of fault hits every tenth row."""
    e = events(spark, sf_dir)
    body = F.to_json(F.struct("sensor", "measurement", "measurement_unit", "datetime", "location"))
    fault = F.col("arrival_seq") % 10
    text = (
        F.when(fault == 0, F.substring(body, 1, 20))
        .when(fault == 1, F.regexp_replace(body, r'"measurement":([0-9.]+)', '"measurement":"$1"'))
        .when(fault == 2, F.regexp_replace(body, r'"measurement":[0-9.]+', '"measurement":null'))
        .when(fault == 3, F.regexp_replace(body, '"sensor"', '"probe"'))
        .when(fault == 4, F.concat(F.lit("["), body, F.lit("]")))
        .when(fault == 5, F.lit(""))
        .when(fault == 6, F.regexp_replace(body, r'"measurement":[0-9.]+', '"measurement":NaN'))
        .when(fault == 7, F.regexp_replace(body, r'"measurement":[0-9.]+,', ""))
        .when(fault == 8, F.concat(body, F.lit(" and more")))
        .otherwise(F.concat(F.lit('{"extra":[1,{"sensor":"x"}],'), F.substring(body, 2, 1000)))
    )
    return e.select(F.encode(text, "utf-8").alias("value"), "arrival_seq")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = messages.good_events(messages.parse_events(raw_messages(spark, sf_dir)))
    return good.select(
        F.col("arrival_seq").alias("event_id"),
        "sensor",
        "measurement",
        "measurement_unit",
        "datetime",
        "location",
        F.unix_micros("event_ts").alias("epoch_us"),
    )


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = messages.quarantined(messages.parse_events(raw_messages(spark, sf_dir)))
    return bad.select(F.col("arrival_seq").alias("event_id"), "reason")


def _config_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One config document per activity row; every fifth is cut short."""
    rows = registrations(activity(spark, sf_dir))
    text = F.to_json(F.struct("jobId", "transformations"))
    return rows.select(
        F.when(F.col("seq") % 5 == 0, F.substring(text, 1, 30)).otherwise(text).alias("text"), "seq"
    )


def _parsed_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _config_texts(spark, sf_dir)
    read = messages.parse_configs(texts.select(F.encode("text", "utf-8").alias("value"), "seq"))
    return read.select(
        F.col("seq").alias("event_id"),
        F.when(F.col("reason").isNull(), F.col("jobId")).alias("job_id"),
        F.when(F.col("reason").isNull(), F.col("transformations")[0]["params"]["threshold"].try_cast("double")).alias("threshold"),
        "reason",
    )


def _job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last registration of every job and sensor, written as a file of its own and read back."""
    rows = registrations(activity(spark, sf_dir), jobs=50)
    last = configs.latest_configs(rows).select(
        F.struct("jobId", "transformations").alias("c"), F.concat_ws("-", "routing_sensor", "jobId").alias("file")
    )
    folder = work_dir(spark, "job-files")
    last.select(F.to_json("c").alias("value"), "file").write.partitionBy("file").text(folder)
    return messages.read_job_files(spark, folder).select(
        F.col("jobId").alias("job_id"),
        F.col("transformations")[0]["params"]["sensor"].alias("sensor"),
        F.col("transformations")[0]["params"]["threshold"].try_cast("double").alias("threshold"),
    )


FILES = 8


def _by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations as lines of some files: of a job's lines in a file the last one counts."""
    rows = registrations(activity(spark, sf_dir)).withColumn("file", F.col("seq") % FILES)
    folder = work_dir(spark, "config-lines")
    (
        rows.select(F.to_json(F.struct("jobId", "transformations")).alias("value"), "file", "seq")
        .repartition(FILES, "file")
        .sortWithinPartitions("file", "seq")
        .select("value", "file")
        .write.partitionBy("file")
        .text(folder)
    )
    read = messages.parse_configs(streams.read_folder(spark, folder))
    last = read.withColumn("sensor", configs.routing_key(F.col("transformations"))).groupBy("arrival.source", "sensor", "jobId").agg(
        F.max_by("transformations", "arrival").alias("last"), F.count("*").alias("n")
    )
    return last.select(
        F.regexp_extract("source", "file=([0-9]+)", 1).cast("long").alias("file"),
        "sensor",
        F.col("jobId").alias("job_id"),
        F.col("last")[0]["params"]["threshold"].try_cast("double").alias("threshold"),
        "n",
    )


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    dirty = F.concat(F.encode("event_type", "utf-8"), F.unhex(F.lit("FF")), F.encode("props", "utf-8"))
    return rows.select("event_id", messages.decode_utf8(dirty).alias("decoded"))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    lossy = events(spark, sf_dir).withColumn(
        "sensor", F.when(F.col("arrival_seq") % 4 != 0, F.col("sensor"))
    )
    return documents.event_messages(lossy)


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text to an instant; dates, zone-less times and junk have none."""
    e = events(spark, sf_dir)
    form = F.col("arrival_seq") % 4
    text = (
        F.when(form == 0, F.substring("datetime", 1, 10))
        .when(form == 1, F.regexp_replace("datetime", "Z$", ""))
        .when(form == 2, F.regexp_replace("datetime", "Z$", "+02:00"))
        .otherwise(F.col("datetime"))
    )
    return e.select(
        F.col("arrival_seq").alias("event_id"),
        F.unix_millis(scalars.instant(text)).alias("epoch_ms"),
    )


_KEPT = "event_id % 10 IN (7, 8, 9)"

QUERIES = {
    "parse_events": (
        _parsed,
        "SELECT event_id, sensor, CASE WHEN event_id % 10 <> 7 THEN measurement END AS measurement, "
        "unit AS measurement_unit, datetime, location, epoch_us(ts) AS epoch_us "
        f"FROM {source()} WHERE {_KEPT}",
    ),
    "parse_quarantine": (
        _quarantined,
        "SELECT event_id, CASE event_id % 10 WHEN 2 THEN 'null_measurement' WHEN 3 THEN 'missing_sensor' "
        "ELSE 'corrupt' END AS reason FROM events WHERE event_id % 10 IN (0, 1, 2, 3, 4, 6)",
    ),
    "parse_configs": (
        _parsed_configs,
        "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'job-' || (user_id % 4) END AS job_id, "
        "CASE WHEN event_id % 5 <> 0 THEN value END AS threshold, "
        "CASE WHEN event_id % 5 = 0 THEN 'corrupt' END AS reason FROM events",
    ),
    "job_files": (
        _job_files,
        "SELECT 'job-' || (user_id % 50) AS job_id, event_type AS sensor, arg_max(value, event_id) AS threshold "
        "FROM events GROUP BY 1, 2",
    ),
    "config_by_place": (
        _by_place,
        "SELECT event_id % 8 AS file, event_type AS sensor, 'job-' || (user_id % 4) AS job_id, "
        "arg_max(value, event_id) AS threshold, count(*) AS n FROM events GROUP BY 1, 2, 3",
    ),
    "decode_utf8": (
        _decoded,
        "SELECT event_id, event_type || chr(65533) || props AS decoded FROM events",
    ),
    "event_messages": (
        _published,
        """SELECT CASE WHEN event_id % 4 <> 0 THEN sensor ELSE 'unknown' END AS "key", '{' || CASE WHEN event_id % 4 <> 0 THEN '"sensor":"' || sensor || '",' ELSE '' END || '"measurement":' || CAST(measurement AS VARCHAR) || ',"measurement_unit":"units","datetime":"' || datetime || '","location":"' || location || '"}' AS "value" FROM """
        + source(),
    ),
    "instant_of_text": (
        _instants,
        "SELECT event_id, CASE event_id % 4 WHEN 2 THEN epoch_us(ts) // 1000 - 7200000 WHEN 3 THEN epoch_us(ts) // 1000 END AS epoch_ms FROM events",
    ),
}
