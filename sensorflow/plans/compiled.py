"""Plans for jobs known when the plan is built.

Parameters are literals, so filters become plain predicates that Catalyst pushes to the
scan, and tests on a job's own sensor fold away. `run_job` gives one job its own pruned
scan; `run_jobs` feeds many jobs from a single scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.functions.vocabulary import DEFAULT_WINDOW_SECONDS
from sensorflow.operators import aggregates, outputs
from sensorflow.operators.steps import (
    CLEANERS,
    REQUIRED_NUMBERS,
    LiteralParams,
    RowState,
    as_double,
    step,
)
from sensorflow.plans import indexed
from sensorflow.plans.job import Job, jobs_frame
from sensorflow.schemas import EVENT_COLUMNS

MANY_JOBS = 64

OUTPUT_HEAD = (
    "result_kind",
    "grouping_field",
    "grouping_key",
    "aggregation_type",
    "field",
    "value",
    "value_ts",
)


def initial_state(sensor: str | None = None) -> RowState:
    """Every field as its column; a known sensor as a literal, so that tests on it fold."""
    fields = {c: F.col(c) for c in EVENT_COLUMNS}
    if sensor is not None:
        fields["sensor"] = F.lit(sensor)
    return RowState(fields)


def apply_steps(job: Job, row: RowState) -> RowState:
    """State after the element steps; an unsound job runs none of them."""
    for s in job.elements if _sound(job) else ():
        row = step(s.type)(row, s.literals)
    return row


def routed(events: DataFrame, job: Job) -> DataFrame:
    return events.where(F.col("sensor").isin(*job.routes)) if job.routes else events


def apply_elements(events: DataFrame, job: Job) -> DataFrame:
    """Only the element steps of a job: the events that survive, as changed."""
    row = apply_steps(job, initial_state(job.routes[0] if len(job.routes) == 1 else None))
    return (
        routed(events, job)
        .where(row.keep)
        .select(*[row.fields[c].alias(c) for c in EVENT_COLUMNS])
    )


def _sound(job: Job) -> bool:
    """Does every step have the numbers it needs?"""
    return all(
        as_double(s.params.get(n)) is not None
        for s in job.elements
        for n in REQUIRED_NUMBERS.get(s.type, ())
    )


def _keeps_sensor(job: Job) -> bool:
    """No step changes the sensor field, as far as the driver can tell."""
    return all(
        s.type in REQUIRED_NUMBERS or (s.type in CLEANERS and s.params.get("field") != "sensor")
        for s in job.elements
    )


def _emissions(
    job: Job, row: RowState, sensor: str | None
) -> tuple[list[Column], Column | None]:
    """(aggregation inputs, direct row) of one event that passed the element steps.

    Each is a struct, or null where the event does not emit it. Aggregations follow list
    order. One whose field is explicitly null cannot be evaluated: it ends the job's work
    on the event and leaves an error row. Where the sensor is known, what cannot be
    emitted is left out on the driver; the direct row is then None.
    """
    if not _sound(job):
        return [], outputs.whole_event(row, outputs.ERROR)
    never, always = F.lit(False), F.lit(True)
    fixed = sensor is not None and _keeps_sensor(job)
    any_taken, failed = never, never
    surely_taken = surely_failed = may_fail = False
    inputs: list[Column] = []
    for s in job.aggregations:
        wanted = s.params.get("sensor")
        if fixed and wanted not in (None, sensor):
            continue
        certain = wanted is None or fixed
        taken = always if certain else outputs.wants(row, s.literals)
        if "field" in s.params and s.params["field"] is None:
            failed, may_fail = failed | taken, True
            surely_failed = surely_failed or certain
        elif not surely_failed:
            named = {"field": s.params.get("field", "measurement"), "keyBy": s.key_by or "sensor"}
            made = outputs.aggregation_input(
                row, F.lit(s.type), F.lit(named["keyBy"]), F.lit(named["field"]), LiteralParams(named)
            )
            unless_failed = ~failed if may_fail else always
            inputs.append(made if certain and not may_fail else F.when(taken & unless_failed, made))
        any_taken = any_taken | taken
        surely_taken = surely_taken or certain
    if surely_taken and not may_fail:
        return inputs, None
    direct = F.when(failed, outputs.whole_event(row, outputs.ERROR)) if may_fail else None
    if not surely_taken:
        passed = outputs.whole_event(row, outputs.PASSTHROUGH)
        if direct is not None:
            direct = direct.when(~any_taken, passed)
        else:
            direct = F.when(~any_taken, passed) if inputs else passed
    return inputs, direct


def _with_output(rows: DataFrame, many: bool) -> DataFrame:
    made = F.explode("emitted") if many else F.col("emitted")
    return (
        rows.withColumn("made", made)
        .where("made IS NOT NULL")
        .select(
            "job_id",
            "steps_hash",
            *[F.col("made")[c].alias(c) for c in OUTPUT_HEAD],
            *outputs.OUTPUT_FIELDS,
        )
    )


def _reached(job: Job, row: RowState) -> Column:
    """Events a job emits anything for; an unsound job emits an error for each of its events."""
    return row.keep if _sound(job) else F.lit(True)


def job_outputs(events: DataFrame, job: Job) -> tuple[DataFrame, DataFrame]:
    """(aggregation inputs, direct results) of one job, each over its own pruned scan."""
    known = job.routes[0] if len(job.routes) == 1 else None
    row = apply_steps(job, initial_state(known))
    # The predicates stand alone in a filter, where Catalyst pushes them to the scan.
    kept = routed(events, job).where(_reached(job, row))
    inputs, direct = _emissions(job, row, known)

    def shaped(branch: DataFrame, made: Column, many: bool = False) -> DataFrame:
        return _with_output(
            branch.select(
                F.lit(job.job_id).alias("job_id"),
                job.hash_column().alias("steps_hash"),
                made.alias("emitted"),
                *[row.fields[c].alias(c) for c in outputs.OUTPUT_FIELDS],
            ),
            many,
        )

    nothing = outputs.whole_event(row, outputs.PASSTHROUGH)
    none_kept = events.where(F.lit(False))
    if len(inputs) > 1:
        aggregated = shaped(kept, F.array(*inputs), many=True)
    else:
        aggregated = shaped(kept, inputs[0]) if inputs else shaped(none_kept, nothing)
    passed = shaped(none_kept, nothing) if direct is None else shaped(kept, direct)
    steps = job.steps_column()
    return aggregated, outputs.direct_results(passed.withColumn("transformations", steps))


def run_job(events: DataFrame, job: Job, seconds: int = DEFAULT_WINDOW_SECONDS) -> DataFrame:
    """All result rows of one job over a batch of events."""
    inputs, direct = job_outputs(events, job)
    windowed = aggregates.aggregate_windows(inputs, seconds).withColumn(
        "transformations", job.steps_column()
    )
    return windowed.unionByName(direct)


def jobs_outputs(events: DataFrame, jobs: Sequence[Job]) -> tuple[DataFrame, DataFrame]:
    """(aggregation inputs, direct results) of many jobs, one scan of the events per branch.

    Per sensor, an array holds what each of its jobs emits; exploding it replaces the
    join with the configs. Only jobs that can reach a branch take part in it.
    """

    def branch(aggregated: bool) -> DataFrame:
        emitted: dict[str, list[Column]] = {}
        relevant: dict[str, Column] = {}
        for job in jobs:
            for route in job.routes:
                row = apply_steps(job, initial_state(route))
                inputs, direct = _emissions(job, row, route)
                made = inputs if aggregated else [direct] if direct is not None else []
                if not made:
                    continue
                reached = _reached(job, row)
                emitted.setdefault(route, []).extend(
                    F.when(reached & o.isNotNull(), _whole_output(job, row, o)) for o in made
                )
                before = relevant.get(route)
                relevant[route] = reached if before is None else before | reached
        if not emitted:
            return events.where(F.lit(False)).select(_empty_output().alias("o")).select("o.*")
        per_sensor, wanted = F.lit(None), F.lit(False)
        for route, made in emitted.items():
            here = F.col("sensor") == route
            per_sensor = F.when(here, F.array(*made)).otherwise(per_sensor)
            wanted = wanted | (here & relevant[route])
        exploded = events.where(wanted).select(F.explode(per_sensor).alias("o"))
        return exploded.where("o IS NOT NULL").select("o.*")

    direct = branch(False).withColumn("transformations", steps_of(jobs))
    return branch(True), outputs.direct_results(direct)


def steps_of(jobs: Sequence[Job]) -> Column:
    """Step list of the row's job."""
    steps = F.lit(None)
    for job in jobs:
        steps = F.when(F.col("job_id") == job.job_id, job.steps_column()).otherwise(steps)
    return steps


def _whole_output(job: Job, row: RowState, head: Column) -> Column:
    return F.struct(
        F.lit(job.job_id).alias("job_id"),
        job.hash_column().alias("steps_hash"),
        *[head[c].alias(c) for c in OUTPUT_HEAD],
        *[row.fields[c].alias(c) for c in outputs.OUTPUT_FIELDS],
    )


def _empty_output() -> Column:
    row = initial_state()
    return _whole_output(Job("", (), "null"), row, outputs.whole_event(row, outputs.PASSTHROUGH))


def run_jobs(
    events: DataFrame, jobs: Sequence[Job], seconds: int = DEFAULT_WINDOW_SECONDS
) -> DataFrame:
    """All result rows of many jobs over a batch of events.

    A plan grows with its jobs, so more than MANY_JOBS become rows of an index.
    """
    if len(jobs) > MANY_JOBS:
        return indexed.run(events, jobs_frame(events.sparkSession, jobs), seconds)
    inputs, direct = jobs_outputs(events, jobs)
    windowed = aggregates.aggregate_windows(inputs, seconds)
    return windowed.withColumn("transformations", steps_of(jobs)).unionByName(direct)
