"""Jobs that are registered while the stream runs.

Two streams. One takes configs: it checks them, adds them to the registry in resolved form
and acknowledges them. The other takes events and joins them, in the JVM, with the
registry as it was when the stream was started; an event without a job is lost. When the
registry has grown, the event stream is stopped between two batches and started again
from its checkpoint with the new jobs. Offsets, open windows and timers go on where they
were, so nothing is lost or counted twice, and an event meets the jobs in force in its
micro-batch. A small registry, by its measured size, is broadcast and events do not move;
beyond that both sides are salted.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorflow.functions.vocabulary import DEFAULT_WINDOW_SECONDS
from sensorflow.operators import aggregates
from sensorflow.plans import data_driven
from sensorflow.streaming import registry
from sensorflow.streaming.event_time import event_time_windows
from sensorflow.streaming.processing_time import clock_windows


def timed(events: DataFrame) -> DataFrame:
    """An event without a usable time of its own counts at the time it is processed."""
    return events.withColumn("event_ts", F.coalesce("event_ts", F.current_timestamp()))


def live_job_results(
    events: DataFrame,
    table: str,
    seconds: int = DEFAULT_WINDOW_SECONDS,
    event_time: bool = False,
    delay: str | None = None,
) -> DataFrame:
    """Result stream of the jobs that the registry `table` holds now.

    Windows as in `start.fixed_job_results`.
    """
    spark = events.sparkSession
    event_time = event_time or delay is not None
    if event_time:
        events = timed(events)
    if delay is not None:
        events = events.withWatermark("event_ts", delay)
    ready = registry.registered(spark, table)
    inputs, direct = data_driven.outputs_of(data_driven.join_configs(events, ready))
    acc = (event_time_windows if event_time else clock_windows)(inputs, seconds)
    # A window that was opened under an earlier registration names that one's steps.
    every = registry.registrations(spark, table)
    return data_driven.with_steps(aggregates.finish(acc), every).unionByName(direct)


class LiveService:
    """Runs the config stream, and the event stream anew whenever jobs were registered."""

    def __init__(
        self,
        version: Callable[[], int],
        start_configs: Callable[[], StreamingQuery],
        start_events: Callable[[], StreamingQuery],
        stop_query: Callable[[StreamingQuery], None],
        pause: float = 1.0,
    ):
        self._version, self._start_events, self._stop_query = version, start_events, stop_query
        self._pause, self._ended, self._failure = pause, threading.Event(), None
        self._running: int | None = None
        self.configs = start_configs()
        self.events: StreamingQuery | None = None
        self._thread = threading.Thread(target=self._run, name="live-jobs", daemon=True)
        self._thread.start()

    def _run(self) -> None:
        try:
            while not self._ended.is_set():
                version = self._version()
                self.events = self._start_events()
                self._running = version
                while not self._ended.wait(self._pause):
                    for query in (self.configs, self.events):
                        if query.exception() is not None:
                            raise query.exception()
                    if self._version() != version:
                        break
                self._running = None
                self._stop_query(self.events)
        except Exception as failure:  # told by exception(), as a query tells its own
            self._failure = failure
        finally:
            for query in (self.configs, self.events):
                if query is not None and query.isActive:
                    self._stop_query(query)

    def exception(self) -> Exception | None:
        return self._failure

    def running_version(self) -> int | None:
        """The version of the registry that the event stream runs with; null between two runs."""
        return self._running

    @property
    def isActive(self) -> bool:
        return self._thread.is_alive()

    def stop(self, timeout: float = 60.0) -> None:
        self._ended.set()
        self._thread.join(timeout)
