"""Where messages come from: Kafka topics, or folders of JSON lines or Parquet."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorflow.streaming.processors import numbered

# Setting names and their defaults -----------------------------
DEFAULTS = {
    "KAFKA_BOOTSTRAP_SERVERS": "kafka:9092",
    "CONFIG_TOPIC": "etl.config.v1",
    "INPUT_TOPIC": "etl.input.v1",
}
CONFIG_GROUP = "etl-config-consumer"
EVENT_GROUP = "etl-data-consumer-v4"


@dataclass(frozen=True)
class Settings:
    """Where a job reads and writes; built from environment-like settings or given outright.

    `config_path` and `event_path` name folders of JSON lines and replace the topics.
    """

    servers: str = DEFAULTS["KAFKA_BOOTSTRAP_SERVERS"]
    config_topic: str = DEFAULTS["CONFIG_TOPIC"]
    input_topic: str = DEFAULTS["INPUT_TOPIC"]
    output: str = ""
    checkpoint: str = ""
    config_path: str | None = None
    event_path: str | None = None
    registry_path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    @property
    def registry(self) -> str:
        """The table of registered jobs."""
        return self.registry_path or f"{self.output}/registry"

    @staticmethod
    def from_mapping(env: Mapping[str, str], **given) -> Settings:
        def of(name: str) -> str:
            return env.get(name, DEFAULTS[name])

        return Settings(
            servers=of("KAFKA_BOOTSTRAP_SERVERS"),
            config_topic=of("CONFIG_TOPIC"),
            input_topic=of("INPUT_TOPIC"),
            output=env.get("OUTPUT_PATH", ""),
            checkpoint=env.get("CHECKPOINT_PATH", ""),
            **given,
        )


def config_options(s: Settings) -> dict[str, str]:
    """Kafka options of the config topic: every registration ever made counts."""
    return {
        "kafka.bootstrap.servers": s.servers,
        "subscribe": s.config_topic,
        "startingOffsets": "earliest",
        "groupIdPrefix": CONFIG_GROUP,
        **s.options,
    }


def event_options(s: Settings) -> dict[str, str]:
    """Kafka options of the event topic: a new job starts with what arrives from now on."""
    return {
        "kafka.bootstrap.servers": s.servers,
        "subscribe": s.input_topic,
        "startingOffsets": "latest",
        "groupIdPrefix": EVENT_GROUP,
        **s.options,
    }


# A total order of messages: when, then where. Offsets say nothing across partitions, so the
# broker's time comes first; lines of a folder come by the time of their file, then its
# path, block and line.
ARRIVAL = T.StructType(
    [
        T.StructField("at", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("place", T.LongType()),
        T.StructField("line", T.LongType()),
    ]
)


def _arrived(at: Column, source: Column, place: Column, line: Column) -> Column:
    values = (at, source, place, line)
    ordered = [v.cast(f.dataType).alias(f.name) for v, f in zip(values, ARRIVAL, strict=True)]
    return F.struct(*ordered).alias("arrival")


def topic_columns() -> list[Column]:
    """What is kept of a message of a topic."""
    at, offset = F.col("timestamp"), F.col("offset")
    # The same order as one number, as far as one holds it.
    number = F.unix_micros(at) + F.pmod(offset, F.lit(1000))
    return [
        F.col("value"),
        _arrived(at, F.col("partition"), offset, F.lit(0)),
        number.alias("arrival_seq"),
        at.alias("arrival_ts"),
    ]


def _lines(files: DataFrame) -> DataFrame:
    """The lines of text files; those of a block are read, and numbered, in their order."""
    file = F.col("_metadata")
    placed = files.select(
        "value",
        file["file_modification_time"].alias("at"),
        file["file_path"].alias("source"),
        file["file_block_start"].alias("place"),
    )
    schema = T.StructType([*placed.schema.fields, T.StructField("line", T.LongType())])
    at = F.col("at")
    return placed.mapInArrow(numbered, schema).select(
        "value",
        _arrived(at, F.col("source"), F.col("place"), F.col("line")),
        (F.unix_micros(at) + F.col("line")).alias("arrival_seq"),
        at.alias("arrival_ts"),
    )


def _topic(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load().select(*topic_columns())


def _folder(spark: SparkSession, path: str, options: Mapping[str, str]) -> DataFrame:
    return _lines(spark.readStream.format("text").options(**options).load(path))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The messages of a folder as a table."""
    return _lines(spark.read.format("text").load(path))


def config_messages(spark: SparkSession, s: Settings) -> DataFrame:
    if s.config_path:
        return _folder(spark, s.config_path, s.options)
    return _topic(spark, config_options(s))


def event_messages(spark: SparkSession, s: Settings) -> DataFrame:
    if s.event_path:
        return _folder(spark, s.event_path, s.options)
    return _topic(spark, event_options(s))
