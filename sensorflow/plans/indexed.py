"""One plan for very many jobs.

Jobs with one step list give one result, but for their names. So jobs are put together by
their list, in lots of at most about LOT names, and lots take the place of jobs until names
are needed: direct results and windows are made once per lot and then take the names of its
jobs, after all shuffles. Only jobs that are registered more than once meet in windows of
one name, so their partial aggregates take the name before they are merged.

Most lists begin with a threshold filter on their own sensor. Per sensor, compared field
and direction these lots are put in order of their thresholds and cut into blocks. An event
finds by binary search the blocks it reaches, then in each of them the lots it passes, so
pairs that the first filter would drop are never made, and no row holds more than a block
and the first thresholds of all blocks of its sensor. Lots that begin otherwise stand in
blocks of their own, all of which an event meets. The rest of the steps is folded as in
`data_driven`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.functions import scalars
from sensorflow.functions.vocabulary import DEFAULT_WINDOW_SECONDS
from sensorflow.operators import aggregates, configs
from sensorflow.plans import data_driven
from sensorflow.session import shuffles_dropped, stored

# Direction of a filter -> sign under which it keeps values above its threshold.
SIGNS = {"filter_greater": 1.0, "filter_less": -1.0}
FIELDS = {
    "measurement": lambda: F.col("measurement"),
    "datetime": lambda: scalars.epoch_millis(F.col("event_ts")),
}
# Names in a lot, and lots in a block.
LOT = 1024
BLOCK = 128
# From so many names a lot on, rows are dealt out evenly before they are named.
MANY_NAMES = 8


def lots(job_configs: DataFrame, broadcast_bytes: int = data_driven.BROADCAST_BYTES, lot: int = LOT) -> DataFrame:
    """(number, names, and the columns of a config but its name): the jobs of one step list, stored.

    A list of more than `lot` jobs is cut into several lots by their names. A name is `alone`
    if no other row of `job_configs` has it.
    """
    keep = [c for c in configs.CARRIED if c in job_configs.columns]
    spread = job_configs.repartition(job_configs.sparkSession.sparkContext.defaultParallelism)
    digest = F.sha2(F.coalesce(F.to_json("transformations", {"ignoreNullFields": "false"}), F.lit("null")), 256)
    again = job_configs.groupBy(F.col("jobId").alias("again")).agg(F.count("*").alias("times")).where("times > 1")
    again = data_driven.fitting(stored(again, "job-names"), broadcast_bytes)
    marked = spread.join(again, F.col("jobId").eqNullSafe(F.col("again")), "left")
    named = marked.select(
        "jobId", F.col("times").isNull().alias("alone"), "transformations", *keep, digest.alias("list")
    )
    crowded = named.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > lot)
    with shuffles_dropped(job_configs.sparkSession):
        parts = data_driven.fitting(crowded.select("list", F.ceil(F.col("n") / lot).alias("parts")), broadcast_bytes)
    drawn = F.pmod(F.xxhash64("jobId"), F.coalesce("parts", F.lit(1).cast("long")))
    cut = named.join(parts, "list", "left").withColumn("lot", drawn)
    grouped = cut.groupBy("list", "lot", *keep).agg(
        F.collect_list(F.struct("jobId", "alone")).alias("names"), F.any_value("transformations").alias("transformations")
    )
    numbered = grouped.withColumn("number", F.monotonically_increasing_id())
    return stored(numbered.select("number", "names", "transformations", *keep), "job-lots")


def resolved(table: DataFrame) -> DataFrame:
    """The lots as resolved configs, each under its number."""
    return configs.prepared(table.drop("names").withColumnRenamed("number", "jobId")).withColumn(
        "cfg_job_id", F.col("cfg_job_id").cast("string")
    )


def named(rows: DataFrame, table: DataFrame, broadcast_bytes: int = data_driven.BROADCAST_BYTES) -> DataFrame:
    """Each row of a lot once for every job in it, under the job's name.

    Step lists and digests come with the names: rows that move don't carry them.
    """
    names = table.select(
        F.col("number").cast("string").alias("job_id"),
        F.col("names.jobId").alias("names"),
        "transformations",
        configs.steps_hash(F.col("transformations")).alias("steps_hash"),
    )
    moved = rows.drop("transformations", "steps_hash")
    if data_driven.serialized_bytes(names) <= broadcast_bytes:
        mean = table.agg(F.avg(F.size("names"))).first()[0]
        if (mean or 0) >= MANY_NAMES:
            moved = moved.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
        found = moved.join(F.broadcast(names), "job_id")
    else:
        found = moved.join(names.hint("merge"), "job_id")
    every = found.withColumn("name", F.explode("names"))
    return every.select(*[F.col("name").alias(c) if c == "job_id" else F.col(c) for c in rows.columns])


def with_names(table: DataFrame, alone: bool) -> DataFrame:
    """The lots with those names only that are `alone`, or that are not."""
    chosen = table.withColumn("names", F.filter("names", lambda n: n["alone"] == F.lit(alone)))
    return chosen.where(F.size("names") > 0)


def windows(
    inputs: DataFrame, table: DataFrame, seconds: int, broadcast_bytes: int = data_driven.BROADCAST_BYTES
) -> DataFrame:
    """Result rows of the windows of all jobs, from the aggregation inputs of their lots."""
    partial = aggregates.partial_windows(inputs, seconds)
    several = with_names(table, False)
    if several.isEmpty():
        return named(aggregates.merge_windows(partial), table, broadcast_bytes)
    partial = stored(partial, "partial-windows")
    once = named(aggregates.merge_windows(partial), with_names(table, True), broadcast_bytes)
    merged = aggregates.merge_windows(named(partial, several, broadcast_bytes))
    # Names first: a digest in one select with a generator loses the names of its fields.
    lists = several.withColumn("cfg_job_id", F.explode("names.jobId")).select(
        "cfg_job_id",
        configs.steps_hash(F.col("transformations")).alias("cfg_hash"),
        F.col("transformations").alias("cfg_steps"),
    )
    return once.unionByName(data_driven.with_steps(merged, lists, broadcast_bytes))


def threshold_blocks(ready: DataFrame, block: int = BLOCK) -> DataFrame:
    """(routing_sensor, kind, field, aggregating, emitting, block, thresholds, jobs), stored.

    The jobs of a block stand in order of their thresholds. `kind` is null for the jobs
    that no threshold decides on.
    """
    first = F.get("cfg_elements", F.lit(0))
    field = F.coalesce(first["field"], F.lit("measurement"))
    decides = (
        first["type"].isin(*SIGNS)
        & ~F.col("cfg_unusable")
        & first["threshold"].isNotNull()
        & ~F.isnan(first["threshold"])
        & field.isin(*FIELDS)
        & (first["sensor"].isNull() | (first["sensor"] == F.col("routing_sensor")))
    )
    decides = F.coalesce(decides, F.lit(False))
    sign = F.lit(None).cast("double")
    for kind, value in SIGNS.items():
        sign = F.when(first["type"] == kind, value).otherwise(sign)
    key = ("routing_sensor", "kind", "field", "aggregating", "emitting")
    entries = ready.select(
        "routing_sensor",
        F.when(decides, first["type"]).alias("kind"),
        F.when(decides, field).alias("field"),
        (F.size("cfg_aggregations") > 0).alias("aggregating"),
        (~F.col("cfg_settled")).alias("emitting"),
        F.when(decides, first["threshold"] * sign).otherwise(0.0).alias("threshold"),
        F.struct("*").alias("job"),
    )
    # Numbered in order, so that neighbours come into one block.
    ordered = entries.repartitionByRange(*key, "threshold").sortWithinPartitions(*key, "threshold")
    placed = ordered.withColumn("block", F.floor(F.monotonically_increasing_id() / block))

    def rising(a: Column, b: Column) -> Column:
        return F.when(a["threshold"] < b["threshold"], -1).when(a["threshold"] > b["threshold"], 1).otherwise(0)

    blocks = placed.groupBy(*key, "block").agg(
        F.array_sort(F.collect_list(F.struct("threshold", "job")), rising).alias("entries")
    )
    return stored(
        blocks.select(
            *key,
            F.monotonically_increasing_id().alias("block"),
            F.col("entries.threshold").alias("thresholds"),
            F.col("entries.job").alias("jobs"),
        ),
        "job-blocks",
    )


def below(values: Column, bound: Column) -> Column:
    """How many of some rising values are less than the bound, by binary search."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + F.lit(1.0))).cast("int") + 1)
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        less = F.get(values, middle) < bound
        low = F.when(less, middle + 1).otherwise(at["low"])
        high = F.when(less, at["high"]).otherwise(middle)
        return F.when(at["low"] < at["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(at)

    return F.aggregate(steps, start, halve)["low"]


def pairs(events: DataFrame, blocks: DataFrame, broadcast_bytes: int = data_driven.BROADCAST_BYTES) -> DataFrame:
    """Each event with every job of its sensor, but those whose first filter drops it."""
    low = F.struct(F.col("thresholds")[0].alias("threshold"), "block")
    bounds = (
        blocks.groupBy("routing_sensor", "kind", "field")
        .agg(F.array_sort(F.collect_list(low)).alias("lows"))
        .select("routing_sensor", "kind", "field", F.col("lows.threshold").alias("lows"), F.col("lows.block").alias("blocks"))
    )
    met = data_driven.join_configs(events, bounds, broadcast_bytes)
    value = F.lit(None).cast("double")
    for name, of in FIELDS.items():
        value = F.when(F.col("field") == name, of()).otherwise(value)
    for kind, sign in SIGNS.items():
        value = F.when(F.col("kind") == kind, value * sign).otherwise(value)
    usable = F.coalesce(~F.isnan(value), F.lit(False))
    reached = F.when(F.col("kind").isNull(), F.size("blocks")).when(usable, below(F.col("lows"), value)).otherwise(0)
    found = met.select(*events.columns, value.alias("cfg_value"), F.explode(F.slice("blocks", F.lit(1), reached)).alias("block"))
    whole = data_driven.fitting(blocks.select("block", "kind", "thresholds", "jobs"), broadcast_bytes)
    passed = F.when(F.col("kind").isNull(), F.size("jobs")).otherwise(below(F.col("thresholds"), F.col("cfg_value")))
    exploded = found.join(whole, "block").select(*events.columns, F.explode(F.slice("jobs", F.lit(1), passed)).alias("cfg"))
    return exploded.select(*events.columns, "cfg.*")


def run(
    events: DataFrame,
    job_configs: DataFrame,
    seconds: int = DEFAULT_WINDOW_SECONDS,
    broadcast_bytes: int = data_driven.BROADCAST_BYTES,
    lot: int = LOT,
    block: int = BLOCK,
) -> DataFrame:
    """All result rows of every config over a batch of events."""
    table = lots(job_configs, broadcast_bytes, lot)
    blocks = threshold_blocks(resolved(table), block)
    inputs, _ = data_driven.outputs_of(pairs(events, blocks.where("aggregating"), broadcast_bytes))
    _, direct = data_driven.outputs_of(pairs(events, blocks.where("emitting"), broadcast_bytes))
    windowed = windows(inputs, table, seconds, broadcast_bytes)
    return windowed.unionByName(named(direct, table, broadcast_bytes))
