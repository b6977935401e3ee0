"""Ingest checks: quality label, plausible range, rounding and unit of a measurement."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.functions import scalars
from sensorflow.functions.vocabulary import DEFAULT_UNIT, RANGES, UNITS


def quality_label(sensor: Column, measurement: Column) -> Column:
    """Label by how far a measurement lies from what its sensor usually shows."""
    measurement = F.when(~F.isnan(measurement), measurement)  # NaN meets no condition
    # Fixed values: (sensor, condition, score), first match counts.
    off = F.abs(measurement - F.lit(22.0))
    score = (
        F.when((sensor == "temperature") & (off > 15.0), 0.7)
        .when((sensor == "temperature") & (off > 8.0), 0.9)
        .when((sensor == "humidity") & ((measurement < 20.0) | (measurement > 80.0)), 0.8)
        .when((sensor == "air_quality") & (measurement > 150.0), 0.6)
        .when((sensor == "air_quality") & (measurement > 100.0), 0.8)
        .when((sensor == "noise") & (measurement > 70.0), 0.7)
        .otherwise(1.0)
    )
    return (
        F.when(score >= 0.95, "excellent")
        .when(score >= 0.85, "good")
        .when(score >= 0.75, "fair")
        .otherwise("poor")
    )


def range_table(spark: SparkSession) -> DataFrame:
    """Six rows, one per known sensor."""
    return spark.createDataFrame(
        pa.table(
            {
                "sensor": list(RANGES),
                "unit": [UNITS[s] for s in RANGES],
                "low": [low for low, _ in RANGES.values()],
                "high": [high for _, high in RANGES.values()],
            }
        )
    )


def clamp_range(events: DataFrame) -> DataFrame:
    """Bound each measurement to its sensor's range; other sensors are left alone."""
    ranges = F.broadcast(range_table(events.sparkSession).drop("unit"))
    bounded = scalars.clamp(F.col("measurement"), F.col("low"), F.col("high"))
    return (
        events.join(ranges, "sensor", "left")
        .withColumn(
            "measurement", F.when(F.col("low").isNull(), F.col("measurement")).otherwise(bounded)
        )
        .select(*events.columns)
    )


def with_unit(events: DataFrame) -> DataFrame:
    """Set the unit of each measurement from its sensor."""
    units = F.broadcast(range_table(events.sparkSession).select("sensor", "unit"))
    return (
        events.join(units, "sensor", "left")
        .withColumn("measurement_unit", F.coalesce("unit", F.lit(DEFAULT_UNIT)))
        .select(*events.columns)
    )


def round_measurement(measurement: Column) -> Column:
    return scalars.round_half_up(measurement, 1)
