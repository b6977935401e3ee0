"""One plan for jobs that arrive as data.

Events meet the configs of their sensor in a join; the step list is folded over the event
with the same builders the compiled plans use, its parameters read from the config row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.functions.once import computed_once
from sensorflow.functions.vocabulary import DEFAULT_WINDOW_SECONDS
from sensorflow.operators import aggregates, configs, outputs
from sensorflow.operators.steps import STEP_BUILDERS, RowState, StructParams
from sensorflow.schemas import CLEANABLE_FIELDS, EVENT_COLUMNS
from sensorflow.session import stored

# A config table up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
SALTS = 32
SLICE_SECONDS = 3600
# Registrations of a sensor in one cell of time, and events of a cell in one task.
DENSE = 256
PART_ROWS = 1 << 20
AT_THE_END = (1 << 63) - 1


def serialized_bytes(df: DataFrame) -> int:
    """Size of a table as JSON text: one aggregate, one number to the driver."""
    row = df.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("n")).first()
    return int(row["n"] or 0)


def fitting(rows: DataFrame, broadcast_bytes: int) -> DataFrame:
    """The table, to be broadcast where its measured size allows, else to be joined by shuffle.

    Left to itself Spark goes by the size of files, of which rows that resemble each other
    take little, and would send a large table through the driver.
    """
    return F.broadcast(rows) if serialized_bytes(rows) <= broadcast_bytes else rows.hint("merge")


def spread(events: DataFrame, salts: int) -> DataFrame:
    """Number events evenly so that one sensor's rows fall into many join partitions."""
    salt = F.pmod(F.xxhash64("arrival_seq", "datetime", "location", "measurement"), F.lit(salts))
    return events.withColumn("salt", salt.cast("int"))


def replicated(prepared: DataFrame, salts: int) -> DataFrame:
    return prepared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def join_configs(
    events: DataFrame,
    prepared: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Pair each event with every job registered for its sensor; others drop out.

    A config table whose size is measured to be small is broadcast, and the events do not
    move. Beyond the bound both sides shuffle on (sensor, salt): a sensor that holds most
    events is cut into `salts` parts, each with its own copy of that sensor's configs.
    """
    if serialized_bytes(prepared) <= broadcast_bytes:
        return events.join(
            F.broadcast(prepared), events["sensor"] == prepared["routing_sensor"]
        )
    left, right = spread(events, salts), replicated(prepared, salts)
    on = (left["sensor"] == right["routing_sensor"]) & (left["salt"] == right["salt"])
    return left.join(right.hint("merge"), on).drop("salt")


def join_configs_as_of(
    events: DataFrame,
    log: DataFrame,
    at: str = "event_ts",
    slice_seconds: int = SLICE_SECONDS,
    broadcast_bytes: int = BROADCAST_BYTES,
    dense: int = DENSE,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Pair each event with the configs that were the latest ones at its time `at`.

    `log` holds every registration with `registered_at` and `seq`. Each is resolved once,
    into a table with a version number; time is compared on narrow rows (key, time, version).
    They become intervals inside time slices: the registrations of a slice, and what holds
    when it begins. A slice with more than `dense` registrations of a sensor is cut into
    pieces by their number. An event finds its slice by its key and the interval by its
    time, and moves once, whole, with no copy per job before it is known to have a config.

    Intervals that are measured to be small are broadcast and events don't move for them;
    else a cell with many events is cut into parts of about `part_rows`, each with its own
    copy of the intervals. An event without a time is later than all registrations: such
    events form a cell of their own at the end of time.
    """
    spark, width = events.sparkSession, slice_seconds * 1_000_000
    key = ["routing_sensor", "cfg_job_id"]

    # A log is small beside the events, but resolving it is work for all cores.
    spread_log = log.where(F.col("registered_at").isNotNull()).repartition(spark.sparkContext.defaultParallelism)
    resolved = configs.prepared(spread_log, carry=("registered_at", "seq"))
    columns = [c for c in resolved.columns if c not in ("registered_at", "seq")]
    # Stored, so that a version keeps its number and narrow reads leave the rest out.
    versions = stored(
        resolved.select(
            *columns,
            F.unix_micros("registered_at").alias("since"),
            F.col("seq").cast("long").alias("seq"),
            F.monotonically_increasing_id().alias("version"),
        ),
        "registrations",
    )
    order = F.struct("since", "seq", "version")

    def slice_of(micros: Column) -> Column:
        return F.floor(micros / F.lit(width)).cast("long").alias("slice")

    narrow = versions.select(*key, "since", "seq", "version").withColumn("slice", slice_of(F.col("since")))
    crowded = stored(
        narrow.groupBy("routing_sensor", "slice")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > dense)
        .select("routing_sensor", "slice", F.ceil(F.col("n") / dense).alias("pieces")),
        "crowded",
    )
    crowded = fitting(crowded, broadcast_bytes)

    def placed(rows: DataFrame, micros: Column) -> DataFrame:
        """Rows with the piece of their slice."""
        inside = micros - F.col("slice") * F.lit(width)
        piece = F.floor(F.col("pieces").cast("decimal(20,0)") * inside / F.lit(width))
        return (
            rows.join(crowded, ["routing_sensor", "slice"], "left")
            .withColumn("piece", F.coalesce(piece.cast("long"), F.lit(0).cast("long")))
            .drop("pieces")
        )

    cell = ["slice", "piece"]
    narrow = placed(narrow, F.col("since"))
    time = F.unix_micros(at)
    # No registration lies in the last slice a long can number.
    timed = events.withColumns(
        {"routing_sensor": F.col("sensor"), "slice": F.coalesce(slice_of(time), F.lit(AT_THE_END))}
    )
    timed = placed(timed, time)

    # What each cell with events finds when it begins: the last registration of the cells before.
    asked = timed.groupBy("routing_sensor", *cell).agg(F.count("*").alias("n_events"))
    ends = narrow.groupBy(*key, *cell).agg(F.max_by("version", order).alias("version"))
    jobs = narrow.select(*key).distinct()
    none = F.lit(None).cast("long")
    timeline = (
        ends.select(*key, *cell, "version", none.alias("n_events"))
        .unionByName(asked.join(jobs, "routing_sensor").select(*key, *cell, none.alias("version"), "n_events"))
        .groupBy(*key, *cell)
        .agg(F.max("version").alias("version"), F.max("n_events").alias("n_events"))
    )
    before = Window.partitionBy(*key).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        timeline.withColumn("version", F.last("version", ignorenulls=True).over(before))
        .where(F.col("n_events").isNotNull() & F.col("version").isNotNull())
        .select(*key, *cell, none.alias("since"), none.alias("seq"), "version")
    )
    # Of registrations at one time all but the last hold for no time at all.
    following = Window.partitionBy(*key, *cell).orderBy(F.asc_nulls_first("since"), "seq", "version")
    intervals = (
        carried.unionByName(narrow.select(carried.columns))
        .withColumn("until", F.lead("since").over(following))
        .where(F.col("until").isNull() | F.col("since").isNull() | (F.col("until") > F.col("since")))
        .select("routing_sensor", *cell, "since", "until", "version")
    )
    intervals, on = stored(intervals, "intervals"), ["routing_sensor", *cell]
    if serialized_bytes(intervals) <= broadcast_bytes:
        placed_intervals = F.broadcast(intervals)
    else:
        busy = asked.where(F.col("n_events") > part_rows).select(
            "routing_sensor", *cell, F.ceil(F.col("n_events") / part_rows).alias("parts")
        )
        busy = fitting(busy, broadcast_bytes)
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        drawn = F.pmod(F.xxhash64("arrival_seq", "datetime", "location", "measurement"), parts)
        timed = timed.join(busy, on, "left").withColumn("part", drawn).drop("parts")
        every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        placed_intervals = intervals.join(busy, on, "left").withColumn("part", every).drop("parts").hint("merge")
        on = [*on, "part"]
    met = timed.join(placed_intervals, on).where(
        (F.col("since").isNull() | (time >= F.col("since"))) & (F.col("until").isNull() | (time < F.col("until")))
    )
    pairs = met.select(*events.columns, "version")
    found = pairs.join(fitting(versions.select(*columns, "version"), broadcast_bytes), "version")
    return found.select(*events.columns, *columns)


def _params(t: Column) -> StructParams:
    return StructParams(t, (*configs.TEXT_PARAMS, *configs.NUMBER_PARAMS, "keyBy"))


def _advance(keep: Column, fields: dict[str, Column], t: Column) -> tuple[Column, dict[str, Column]]:
    """State after step `t`, whatever its type."""
    row = RowState(fields)
    kept, changed = keep, dict(fields)
    for name, build in STEP_BUILDERS.items():
        state, mine = build(row, _params(t)), t["type"] == name
        if state.conditions:
            kept = F.when(mine, F.coalesce(state.keep, F.lit(False))).otherwise(kept)
        for c in EVENT_COLUMNS:
            if state.fields[c] is not fields[c]:
                changed[c] = F.when(mine, state.fields[c]).otherwise(changed[c])
    return kept, changed


# What steps may change; the rest of the event passes by.
CHANGING = ("measurement", *CLEANABLE_FIELDS)


def apply_steps(paired: DataFrame) -> DataFrame:
    """Run each pair's element steps: adds `keep`, and changes the event columns."""
    others = [c for c in paired.columns if c not in CHANGING]
    fixed = {c: F.col(c) for c in EVENT_COLUMNS if c not in CHANGING}

    def advance(acc: Column, t: Column) -> Column:
        fields = {**fixed, **{c: acc[c] for c in CHANGING}}
        kept, changed = _advance(acc["keep"], fields, t)
        moved = F.struct(kept.alias("keep"), *[changed[c].alias(c) for c in CHANGING])
        return F.when(acc["keep"], moved).otherwise(acc)

    start = F.struct((~F.col("cfg_unusable")).alias("keep"), *CHANGING)
    done = F.aggregate(F.col("cfg_elements"), start, advance)
    return computed_once(paired, "s", done).select(*others, "s.*")


def _takes(every: Column, named: Column) -> Column:
    return every | F.coalesce(F.array_contains(named, F.col("sensor")), F.lit(False))


def outputs_of(
    paired: DataFrame, carry: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(aggregation inputs, direct results) of (event, config) pairs: the job's output rule."""
    # Conditions on the config alone reach its side of the join: a job is folded only for
    # the branches it can emit to.
    aggregating = apply_steps(paired.where(F.size("cfg_aggregations") > 0))
    emitting = apply_steps(paired.where(~F.col("cfg_settled")))
    row = RowState({c: F.col(c) for c in EVENT_COLUMNS})
    taken = _takes(F.col("cfg_takes_all"), F.col("cfg_takes"))
    broken = _takes(F.col("cfg_breaks_all"), F.col("cfg_breaks"))
    a = F.col("a")

    def shaped(df: DataFrame, made: Column) -> DataFrame:
        return df.withColumn("made", made).select(
            F.col("cfg_job_id").alias("job_id"),
            F.col("cfg_hash").alias("steps_hash"),
            F.col("cfg_steps").alias("transformations"),
            "made.*",
            *outputs.OUTPUT_FIELDS,
            *carry,
        )

    inputs = (
        aggregating.where(F.col("keep") & taken)
        .withColumn("a", F.explode("cfg_aggregations"))
        .where(a["sensor"].isNull() | (a["sensor"] == F.col("sensor")))
        .where(a["field"].isNotNull() & ~_takes(a["blocked_all"], a["blocked"]))
    )
    made = outputs.aggregation_input(row, a["type"], a["keyBy"], a["field"], _params(a))
    failed = F.col("cfg_unusable") | (F.col("keep") & broken)
    whole = F.when(failed, outputs.whole_event(row, outputs.ERROR)).otherwise(
        outputs.whole_event(row, outputs.PASSTHROUGH)
    )
    direct = shaped(emitting.where(failed | (F.col("keep") & ~taken)), whole)
    return shaped(inputs, made).drop("transformations"), outputs.direct_results(direct)


def with_steps(results: DataFrame, prepared: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Attach step lists to aggregate rows by job and digest."""
    lists = (
        prepared.select(
            F.col("cfg_job_id").alias("job_id"),
            F.col("cfg_hash").alias("steps_hash"),
            F.col("cfg_steps").alias("transformations"),
        )
        .groupBy("job_id", "steps_hash")
        .agg(F.any_value("transformations").alias("transformations"))
    )
    columns = results.columns
    lists = fitting(lists, broadcast_bytes)
    return results.drop("transformations").join(lists, ["job_id", "steps_hash"], "left").select(columns)


def run(
    events: DataFrame,
    job_configs: DataFrame,
    seconds: int = DEFAULT_WINDOW_SECONDS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All result rows of every config over a batch of events."""
    ready = configs.prepared(job_configs)
    inputs, direct = outputs_of(join_configs(events, ready, broadcast_bytes))
    windowed = aggregates.aggregate_windows(inputs, seconds)
    return with_steps(windowed, ready, broadcast_bytes).unionByName(direct)


def run_as_of(
    events: DataFrame,
    log: DataFrame,
    seconds: int = DEFAULT_WINDOW_SECONDS,
    at: str = "event_ts",
    broadcast_bytes: int = BROADCAST_BYTES,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """All result rows, each event under the configs in force at its time."""
    joined = join_configs_as_of(events, log, at, slice_seconds)
    inputs, direct = outputs_of(joined)
    windowed = aggregates.aggregate_windows(inputs, seconds)
    return with_steps(windowed, configs.prepared(log), broadcast_bytes).unionByName(direct)
