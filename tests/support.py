"""Small event tables, and many test cases run through one plan each way."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.functions import scalars
from sensorflow.plans import compiled, data_driven
from sensorflow.plans.job import Job, jobs_frame
from sensorflow.schemas import EVENT_COLUMNS

FIELDS = (
    "sensor string, measurement double, measurement_unit string, datetime string, "
    "location string, data_quality string, arrival_seq long"
)
START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
NAN, INF = float("nan"), float("inf")


def event(sensor, measurement=None, at=0.0, location=None, unit=None, quality=None, seq=None, text=None):
    moment = START + dt.timedelta(seconds=at)
    text = text or moment.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return (sensor, measurement, unit, text, location, quality, seq)


def numbered(rows):
    return [r if r[6] is not None else (*r[:6], i) for i, r in enumerate(rows)]


def frame(spark: SparkSession, rows) -> DataFrame:
    df = spark.createDataFrame(numbered(rows), FIELDS)
    return df.withColumns(
        {"job_id": F.lit(None).cast("string"), "event_ts": scalars.instant(F.col("datetime"))}
    ).select(*EVENT_COLUMNS)


def job(job_id, *steps) -> Job:
    return Job.from_dict({"jobId": job_id, "transformations": list(steps)})


def step(kind, key_by=None, **params) -> dict:
    out = {"type": kind, "params": params}
    return out if key_by is None else {**out, "keyBy": key_by}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def collected(results: DataFrame) -> list[dict]:
    flat = results.select(
        "job_id",
        "result_kind",
        "grouping_field",
        "grouping_key",
        "aggregation_type",
        "field",
        "result_double",
        "result_string",
        "sensor_type",
        "measurement_unit",
        "location",
        "steps_hash",
        "seq",
        F.unix_seconds("window.start").alias("start"),
        "result_event.*",
        F.to_json("transformations").alias("steps"),
    ).toDF(
        "job_id", "kind", "by", "key", "agg", "field", "double", "string", "sensor_type", "unit",
        "place", "hash", "seq", "start", "sensor", "measurement", "event_unit", "datetime",
        "location", "quality", "steps",
    )
    rows = [{k: plain(v) for k, v in r.asDict().items()} for r in flat.collect()]
    return sorted(rows, key=repr)


class Cases:
    """Independent cases share one event table: each has its own copy of every sensor name."""

    def __init__(self):
        self.rows, self.jobs, self._done = [], [], None

    def add(self, rows, *step_lists) -> int:
        n = len({j.job_id.split(":")[0] for j in self.jobs})

        def own(sensor):
            return None if sensor is None else f"{n}:{sensor}"

        self.rows += [(own(r[0]), *r[1:]) for r in numbered(rows)]
        for i, steps in enumerate(step_lists):
            renamed = [
                {
                    **s,
                    "params": {
                        k: own(v) if k in ("sensor", "filter_sensor", "target_sensor") else v
                        for k, v in s["params"].items()
                    },
                }
                for s in steps
            ]
            self.jobs.append(job(f"{n}:{i}", *renamed))
        return n

    def results(self, spark: SparkSession, n: int) -> list[dict]:
        if self._done is None:
            events = frame(spark, self.rows)
            fixed = collected(compiled.run_jobs(events, self.jobs))
            driven = collected(data_driven.run(events, jobs_frame(spark, self.jobs)))
            assert fixed == driven
            self._done = fixed

        def bare(v):
            return re.sub(r"^[0-9]+:", "", v) if isinstance(v, str) else v

        mine = [r for r in self._done if r["job_id"].startswith(f"{n}:")]
        return [{k: v if k in ("datetime", "string") else bare(v) for k, v in r.items()} for r in mine]
