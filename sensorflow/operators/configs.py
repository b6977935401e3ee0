"""Operators on job configs: validation, routing, step lists, latest version, ack rows.

Configs are rows (jobId, transformations, outputTopic) plus, where order matters, `seq`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.functions import scalars
from sensorflow.operators.aggregates import AGGREGATES
from sensorflow.operators.steps import (
    CLEANERS,
    REQUIRED_NUMBERS,
    STEP_BUILDERS,
    ColumnParams,
    usable,
)
from sensorflow.schemas import EVENT_FIELDS, RESULT, STEPS

# The texts that clients are answered with. Those of refusals stand in `rejection`.
ACK_MESSAGE = "Configuration registered successfully"


def _listed(steps: Column) -> Column:
    return F.coalesce(steps, F.array().cast(STEPS))


def element_steps(steps: Column) -> Column:
    return F.filter(_listed(steps), lambda t: t["type"].isin(*STEP_BUILDERS))


def aggregation_steps(steps: Column) -> Column:
    return F.filter(_listed(steps), lambda t: t["type"].isin(*AGGREGATES))


def routing_keys(steps: Column) -> Column:
    """Sensors whose events the job receives.

    The first `sensor` parameter in list order decides. Only where no step has one do
    the two sensors of a cross filter route.
    """

    def named(name: str) -> Column:
        found = F.transform(_listed(steps), lambda t: ColumnParams(t["params"]).text(name))
        return F.filter(found, lambda s: s.isNotNull())

    own = F.slice(named("sensor"), 1, 1)
    crossed = F.array_distinct(F.concat(named("target_sensor"), named("filter_sensor")))
    return F.when(F.size(own) > 0, own).otherwise(crossed)


def routing_key(steps: Column) -> Column:
    return F.get(routing_keys(steps), F.lit(0))


def steps_hash(steps: Column) -> Column:
    """Digest of a step list that does not depend on the order of its parameters."""
    canonical = F.transform(
        steps,
        lambda t: F.struct(
            t["type"].alias("type"),
            F.array_sort(F.map_entries(t["params"])).alias("params"),
            t["keyBy"].alias("keyBy"),
        ),
    )
    as_text = F.to_json(canonical, {"ignoreNullFields": "false"})
    return F.sha2(F.coalesce(as_text, F.lit("null")), 256)


def rejection(job_id: Column, steps: Column) -> Column:
    """Why a config is refused, or null where it is sound. The texts are fixed values."""
    listed = _listed(steps)
    known = [*STEP_BUILDERS, *AGGREGATES]
    unknown = F.filter(listed, lambda t: ~F.coalesce(t["type"].isin(*known), F.lit(False)))
    unusable = F.filter(listed, lambda t: ~usable(t["type"], ColumnParams(t["params"])))

    not_numbers = [f for f in EVENT_FIELDS if f not in ("measurement", "datetime")]

    def unfit(t: Column) -> Column:
        field = ColumnParams(t["params"]).text("field", "measurement")
        clock_sum = (field == "datetime") & ~t["type"].isin("min", "max")
        return t["type"].isin(*AGGREGATES) & (field.isin(*not_numbers) | clock_sum)

    non_numeric = F.filter(listed, unfit)
    first_unknown = F.get(unknown, F.lit(0))["type"]
    first_field = ColumnParams(F.get(non_numeric, F.lit(0))["params"]).text("field", "measurement")
    return (
        F.when(
            job_id.isNull() | (scalars.strip_control(job_id) == ""), F.lit("jobId is required")
        )
        .when(
            F.size(unknown) > 0,
            F.concat(
                F.lit("Unknown transformation type: "), F.coalesce(first_unknown, F.lit("null"))
            ),
        )
        .when(F.size(routing_keys(steps)) == 0, F.lit("no routing sensor"))
        .when(
            F.size(unusable) > 0,
            F.concat(F.lit("bad number in "), F.get(unusable, F.lit(0))["type"]),
        )
        .when(
            F.size(non_numeric) > 0,
            F.concat(
                F.get(non_numeric, F.lit(0))["type"], F.lit(" needs a numeric field: "), first_field
            ),
        )
    )


def with_rejection(configs: DataFrame) -> DataFrame:
    return configs.withColumn("reason", rejection(F.col("jobId"), F.col("transformations")))


def validate_configs(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); the rejected carry the first failure in `reason`."""
    checked = with_rejection(configs)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def latest_configs(log: DataFrame) -> DataFrame:
    """Last registration per (routing sensor, job).

    A job re-registered under another sensor stays registered under the old one too.
    `seq` numbers the log; the aggregate keeps one row per key on each mapper, so a job
    that re-registers endlessly costs one row per partition in the shuffle.
    """
    return (
        log.withColumn("routing_sensor", F.explode(routing_keys(F.col("transformations"))))
        .groupBy("routing_sensor", "jobId")
        .agg(F.max_by(F.struct("transformations", "outputTopic", "seq"), "seq").alias("last"))
        .select("routing_sensor", "jobId", "last.*")
    )


TEXT_PARAMS = (
    "field",
    "sensor",
    "filter_sensor",
    "filter_field",
    "filter_operator",
    "target_sensor",
)
NUMBER_PARAMS = ("threshold", "filter_threshold", "min", "max")


def _resolved_element(t: Column) -> Column:
    p = ColumnParams(t["params"])
    return F.struct(
        t["type"].alias("type"),
        t["params"].alias("params"),
        *[p.text(n).alias(n) for n in TEXT_PARAMS],
        *[p.number(n).alias(n) for n in NUMBER_PARAMS],
    )


def _resolved_aggregation(t: Column) -> Column:
    # An absent field means measurement; one given as null stays null and cannot be evaluated.
    given = F.coalesce(F.map_contains_key(t["params"], F.lit("field")), F.lit(False))
    p = ColumnParams(t["params"])
    return F.struct(
        t["type"].alias("type"),
        F.coalesce(t["keyBy"], F.lit("sensor")).alias("keyBy"),
        F.when(given, p.text("field")).otherwise(F.lit("measurement")).alias("field"),
        p.text("sensor").alias("sensor"),
    )


def _sensors(aggregations: Column) -> tuple[Column, Column]:
    """(takes every sensor, the sensors it names) of a list of aggregation steps."""
    names = F.transform(aggregations, lambda a: a["sensor"])
    return F.exists(aggregations, lambda a: a["sensor"].isNull()), F.filter(
        names, lambda s: s.isNotNull()
    )


# Columns of a config beside its steps that its resolved form keeps, where there are any.
CARRIED = ("routing_sensor", "valid_from", "valid_to")


def prepared(configs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Configs in the form the event join needs: one row per (routing sensor, job).

    All text is cast and all defaults are set here, once per config, so that the event
    side neither parses a parameter nor runs a lambda.
    """
    steps = F.col("transformations")
    keep = [c for c in CARRIED if c in configs.columns]
    listed = _listed(steps)
    out = configs.select(
        F.col("jobId").alias("cfg_job_id"),
        steps.alias("cfg_steps"),
        F.transform(element_steps(steps), _resolved_element).alias("cfg_elements"),
        F.transform(aggregation_steps(steps), _resolved_aggregation).alias("cfg_aggregations"),
        F.exists(listed, lambda t: ~usable(t["type"], ColumnParams(t["params"]))).alias(
            "cfg_unusable"
        ),
        steps_hash(steps).alias("cfg_hash"),
        *keep,
        *carry,
    )
    aggs = F.col("cfg_aggregations")
    takes_all, takes = _sensors(aggs)
    breaks_all, breaks = _sensors(F.filter(aggs, lambda a: a["field"].isNull()))

    def with_blockers(a: Column, i: Column) -> Column:
        """An aggregation with the earlier ones that, if they take the event, end the job's work."""
        before = F.filter(F.slice(aggs, F.lit(1), i), lambda e: e["field"].isNull())
        every, named = _sensors(before)
        return a.withField("blocked_all", every).withField("blocked", named)

    out = out.select(
        "*",
        takes_all.alias("cfg_takes_all"),
        takes.alias("cfg_takes"),
        breaks_all.alias("cfg_breaks_all"),
        breaks.alias("cfg_breaks"),
    ).withColumn("cfg_aggregations", F.transform(aggs, with_blockers))
    if "routing_sensor" not in keep:
        out = out.withColumn("routing_sensor", F.explode(routing_keys(F.col("cfg_steps"))))
    # A settled job never emits an event as it is: some aggregation takes every event of the
    # sensor, and none fails. Its pairs can be left out of the direct results altogether.
    may_rename = F.exists(
        F.col("cfg_elements"),
        lambda t: ~t["type"].isin(*REQUIRED_NUMBERS)
        & (~t["type"].isin(*CLEANERS) | (F.coalesce(t["field"], F.lit("location")) == "sensor")),
    )
    sure = F.col("cfg_takes_all") | (
        F.coalesce(F.array_contains("cfg_takes", F.col("routing_sensor")), F.lit(False))
        & ~may_rename
    )
    fails = F.col("cfg_unusable") | F.col("cfg_breaks_all") | (F.size("cfg_breaks") > 0)
    return out.withColumn("cfg_settled", sure & ~fails)


def config_acks(configs: DataFrame) -> DataFrame:
    """One result row per accepted config."""
    values = {
        "job_id": F.col("jobId"),
        "result_kind": F.lit("ack"),
        "result_string": F.lit(ACK_MESSAGE),
        "transformations": F.col("transformations"),
        "steps_hash": steps_hash(F.col("transformations")),
        "seq": next((F.col(c) for c in ("seq", "arrival_seq") if c in configs.columns), F.lit(None)),
    }
    return configs.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT]
    )


def config_messages(configs: DataFrame) -> DataFrame:
    """(key, value) rows for a keyed log: key is the job id, value the config as JSON."""
    body = F.struct(*[F.col(c) for c in ("jobId", "transformations", "outputTopic") if c in configs.columns])
    return configs.select(
        F.col("jobId").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value")
    )
