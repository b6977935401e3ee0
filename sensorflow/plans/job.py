"""A job known to the driver: its id and step list, as read from a config document."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.operators import configs
from sensorflow.operators.aggregates import AGGREGATES
from sensorflow.operators.steps import STEP_BUILDERS, LiteralParams
from sensorflow.schemas import STEPS


def _as_text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


@dataclass(frozen=True)
class Step:
    type: str
    params: Mapping[str, str | None]
    key_by: str | None = None

    @property
    def literals(self) -> LiteralParams:
        return LiteralParams(self.params)


@dataclass(frozen=True)
class Job:
    job_id: str
    steps: tuple[Step, ...]
    document: str  # the step list as JSON text, as registered

    @staticmethod
    def from_dict(doc: Mapping[str, Any]) -> Job:
        listed = doc.get("transformations")
        steps = tuple(
            Step(
                t["type"],
                {k: _as_text(v) for k, v in (t.get("params") or {}).items()},
                t.get("keyBy"),
            )
            for t in listed or ()
        )
        return Job(doc["jobId"], steps, json.dumps(listed))

    @property
    def elements(self) -> list[Step]:
        return [s for s in self.steps if s.type in STEP_BUILDERS]

    @property
    def aggregations(self) -> list[Step]:
        return [s for s in self.steps if s.type in AGGREGATES]

    @property
    def routes(self) -> list[str]:
        """Sensors whose events the job receives (see configs.routing_keys)."""
        own = [s.params["sensor"] for s in self.steps if s.params.get("sensor") is not None]
        if own:
            return own[:1]
        crossed = [s.params.get(n) for n in ("target_sensor", "filter_sensor") for s in self.steps]
        return list(dict.fromkeys(c for c in crossed if c is not None))

    def steps_column(self) -> Column:
        return F.from_json(F.lit(self.document), STEPS)

    def hash_column(self) -> Column:
        return F.lit(_digest(self.document))


@lru_cache(maxsize=None)
def _digest(document: str) -> str:
    """The digest configs.steps_hash gives, as a constant (a one-row select, no cluster job)."""
    one_row = SparkSession.active().sql("SELECT 1")
    return one_row.select(configs.steps_hash(F.from_json(F.lit(document), STEPS))).first()[0]


def load_jobs(directory: str | Path) -> list[Job]:
    """Job documents of a small directory, for plans compiled on the driver."""
    return [
        Job.from_dict(json.loads(p.read_text())) for p in sorted(Path(directory).glob("*.json"))
    ]


def jobs_frame(spark: SparkSession, jobs: Iterable[Job]) -> DataFrame:
    """The jobs as config rows, numbered in the order given."""
    listed = list(jobs)
    table = pa.table(
        {
            "jobId": pa.array([j.job_id for j in listed], pa.string()),
            "document": pa.array([j.document for j in listed], pa.string()),
            "seq": pa.array(range(len(listed)), pa.int64()),
        }
    )
    return spark.createDataFrame(table).select(
        "jobId",
        F.from_json("document", STEPS).alias("transformations"),
        F.lit(None).cast("string").alias("outputTopic"),
        "seq",
    )
