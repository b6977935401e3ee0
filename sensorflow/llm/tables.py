"""Intermediate tables in the shared folder, and functions that run in Python workers."""

from __future__ import annotations

import importlib
import pickle
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from sensorflow.session import shuffles_dropped, work_dir

ROOT = str(Path(__file__).resolve().parents[2])


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table below the shared folder.

    It cuts the lineage, so a lost executor costs only its own tasks, and gives the
    planner a true size, so its own threshold decides on broadcasts. What was shuffled to
    make it goes at once.
    """
    spark = frame.sparkSession
    path = work_dir(spark, name)
    with shuffles_dropped(spark):
        frame.write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.folder = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that no frame still in use reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_workers(function: Callable, **settings) -> Callable:
    """A function for mapInArrow that imports its module where it runs.

    Module-level caches of the worker then last from task to task. Settings are unpacked
    only there too, since they may be of the package's own types.
    """
    module, name, root, packed = function.__module__, function.__name__, ROOT, pickle.dumps(settings)

    def run(batches):
        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(batches, **pickle.loads(packed))

    return run
