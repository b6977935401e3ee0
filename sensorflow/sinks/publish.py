"""Append keyed messages to a topic, or to a folder that stands in for one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sensorflow.sources.streams import Settings

# Producer settings of the two topics --------------------------
CONFIG_PRODUCER = {
    "kafka.acks": "all",
    "kafka.retries": "3",
    "kafka.enable.idempotence": "true",
}
EVENT_PRODUCER = {
    "kafka.acks": "1",
    "kafka.retries": "3",
    "kafka.batch.size": "16384",
    "kafka.linger.ms": "100",
}


def _append(messages: DataFrame, s: Settings, topic: str, path: str | None, producer: dict) -> None:
    if path:
        # The key is the name of the folder a message lies in.
        messages.select("key", "value").write.mode("append").partitionBy("key").text(path)
        return
    options = {"kafka.bootstrap.servers": s.servers, "topic": topic, **producer}
    messages.select("key", "value").write.format("kafka").options(**options).save()


def publish_configs(messages: DataFrame, settings: Settings) -> None:
    """Send what `configs.config_messages` makes; a job's configs share a key and keep their order."""
    _append(messages, settings, settings.config_topic, settings.config_path, CONFIG_PRODUCER)


def publish_events(messages: DataFrame, settings: Settings) -> None:
    """Send what `documents.event_messages` makes."""
    _append(messages, settings, settings.input_topic, settings.event_path, EVENT_PRODUCER)
