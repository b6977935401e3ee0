"""Whole streams: sources to result store."""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorflow.functions.vocabulary import DEFAULT_WINDOW_SECONDS
from sensorflow.operators import aggregates, configs
from sensorflow.plans import compiled
from sensorflow.plans.job import Job
from sensorflow.schemas import RESULT_COLUMNS
from sensorflow.session import STATE_STORE, use_utc
from sensorflow.sinks import committed, store
from sensorflow.sinks.store import upsert_writer
from sensorflow.sources import messages, streams
from sensorflow.streaming import registry
from sensorflow.streaming.event_time import event_time_windows
from sensorflow.streaming.live import LiveService, live_job_results, timed
from sensorflow.streaming.processing_time import clock_windows

# Fixed value: seconds between checkpoints of the set-up whose results are matched.
CHECKPOINT_INTERVAL = "30 seconds"


def fixed_job_results(
    events: DataFrame,
    jobs: Sequence[Job],
    seconds: int = DEFAULT_WINDOW_SECONDS,
    event_time: bool = False,
    delay: str | None = None,
) -> DataFrame:
    """Result stream of jobs known at start.

    Windows are over the clock and closed by timers, or with `event_time` over the time of
    the events. Then no row is ever late: a window stays open, and each batch writes its
    new state, in update mode. Only a `delay` closes windows, and rows that come later than
    it are left out.
    """
    event_time = event_time or delay is not None
    if event_time:
        events = timed(events)
    if delay is not None:
        events = events.withWatermark("event_ts", delay)
    inputs, direct = compiled.jobs_outputs(events, jobs)
    if event_time:
        acc = event_time_windows(inputs, seconds)
    else:
        acc = clock_windows(inputs, seconds)
    windowed = aggregates.finish(acc).withColumn("transformations", compiled.steps_of(jobs))
    return windowed.unionByName(direct)


def start(
    results: DataFrame, output: str, checkpoint: str, mode: str = "append", **trigger
) -> StreamingQuery:
    """Write a result stream to the store; a restart with the same checkpoint goes on from it."""
    return (
        results.select(*RESULT_COLUMNS)
        .writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": CHECKPOINT_INTERVAL}))
        .foreachBatch(upsert_writer(output))
        .start()
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream of event-time windows keeps in its state after its last batch.

    Read from the checkpoint of a stream that has stopped, crashed or is running: group,
    window, and what its values come to so far.
    """
    state = spark.read.format("statestore").load(checkpoint)
    keys = {f.name: F.col(f"key.`{f.name}`") for f in state.schema["key"].dataType}
    # The buffers stand in the order of the accumulators; several have one name.
    first = ("total", "n", "low", "high")
    buffers = T.StructType(
        [T.StructField(first[i] if i < 4 else f"other{i}", f.dataType) for i, f in enumerate(state.schema["value"].dataType)]
    )
    window = next(c for n, c in keys.items() if n.startswith("window"))
    named = [keys[n].alias(n) for n in aggregates.GROUP]
    held = state.select(window.alias("window"), *named, F.col("value").cast(buffers).alias("b"))
    return held.select("window", *aggregates.GROUP, *[F.col("b")[n].alias(n) for n in first])


def start_quarantine(parsed: DataFrame, output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep refused messages, by reason."""
    return (
        messages.quarantined(parsed)
        .writeStream.format("parquet")
        .partitionBy("reason")
        .option("path", f"{output}/quarantine")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": CHECKPOINT_INTERVAL}))
        .start()
    )


def start_refused(
    spark: SparkSession, settings: streams.Settings, **trigger
) -> tuple[StreamingQuery, StreamingQuery]:
    """Keep what `start_live_jobs` leaves out: refused events, and refused configs, by reason."""
    parsed = messages.parse_events(streams.event_messages(use_utc(spark), settings))
    events = start_quarantine(parsed, settings.output, f"{settings.checkpoint}/refused-events", **trigger)
    read = messages.parse_configs(streams.config_messages(spark, settings))
    reason = F.coalesce("reason", configs.rejection(F.col("jobId"), F.col("transformations")))
    refused = read.withColumn("reason", reason).where("reason IS NOT NULL")
    rejected = (
        refused.select("raw", "reason", "arrival_seq")
        .writeStream.format("parquet")
        .option("path", f"{settings.output}/refused_configs")
        .option("checkpointLocation", f"{settings.checkpoint}/refused-configs")
        .trigger(**(trigger or {"processingTime": CHECKPOINT_INTERVAL}))
        .start()
    )
    return events, rejected


def acknowledgements(spark: SparkSession, output: str) -> DataFrame:
    """One result row per accepted config."""
    return store.history(spark, f"{output}/acks")


def start_registrations(spark: SparkSession, settings: streams.Settings, **trigger) -> StreamingQuery:
    """Takes configs from their topic or folder: accepted ones are registered, then acknowledged."""
    registry.create(use_utc(spark), settings.registry)
    read = messages.parse_configs(streams.config_messages(spark, settings))
    accepted, _ = configs.validate_configs(read.where("reason IS NULL").drop("reason"))

    def register(batch: DataFrame, number: int) -> None:
        registry.register(batch, settings.registry, number)
        store.write_batch(configs.config_acks(batch), number, f"{settings.output}/acks")

    return (
        accepted.writeStream.option("checkpointLocation", f"{settings.checkpoint}/configs")
        .trigger(**(trigger or {"processingTime": CHECKPOINT_INTERVAL}))
        .foreachBatch(register)
        .start()
    )


def start_events(
    spark: SparkSession,
    settings: streams.Settings,
    seconds: int = DEFAULT_WINDOW_SECONDS,
    event_time: bool = False,
    delay: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Takes events through the jobs registered now, from where an earlier run has stopped."""
    use_utc(spark).conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    registry.create(spark, settings.registry)
    parsed = messages.parse_events(streams.event_messages(spark, settings))
    results = live_job_results(messages.good_events(parsed), settings.registry, seconds, event_time, delay)
    mode = "update" if event_time and delay is None else "append"
    return start(results, settings.output, f"{settings.checkpoint}/events", mode, **trigger)


def start_live_jobs(
    spark: SparkSession,
    settings: streams.Settings,
    seconds: int = DEFAULT_WINDOW_SECONDS,
    event_time: bool = False,
    delay: str | None = None,
    pause: float = 1.0,
    **trigger,
) -> LiveService:
    """The full service: configs and events from their topics or folders, results to the store.

    Refused messages are kept by `start_refused`.
    """
    return LiveService(
        lambda: committed.version(spark, settings.registry),
        lambda: start_registrations(spark, settings, **trigger),
        lambda: start_events(spark, settings, seconds, event_time, delay, **trigger),
        stop_between_batches,
        pause,
    )


def drain(query: StreamingQuery, seconds: int) -> None:
    """Let a stream with clock windows take its present input and close its windows, then stop it.

    Windows close while nothing arrives, so the query is left running until a batch without
    input has started later than the last window can end, however long the input takes.
    """
    last_input = None
    try:
        while True:
            if query.exception() is not None:
                raise query.exception()
            for p in query.recentProgress:
                at = datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")).timestamp()
                if p["numInputRows"] > 0:
                    last_input = at if last_input is None else max(at, last_input)
                elif last_input is not None and at > last_input + 2 * seconds + 1:
                    return
            time.sleep(0.5)
    finally:
        stop_between_batches(query)


def stop_between_batches(query: StreamingQuery, timeout: float = 3.0) -> None:
    """Stop a stream while no batch is running, if such a moment comes soon."""
    deadline = time.monotonic() + timeout
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < deadline:
        time.sleep(0.05)
    query.stop()
