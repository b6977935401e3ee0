"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sensorflow import catalog  # noqa: E402
from sensorflow.session import configured  # noqa: E402

HEADLINE = (
    "filter_greater",
    "step_chain",
    "agg_sum",
    "agg_max",
    "agg_avg",
    "agg_max_ten_seconds",
    "agg_max_datetime",
    "multi_agg_fanout",
    "group_keys_each",
    "multi_job_join",
    "multi_job_join_shuffled",
    "config_asof",
    "config_asof_bucketed",
    "parse_events",
    "config_latest",
    "quality_label",
    "compiled_all_jobs",
    "data_driven_all_jobs",
    "many_jobs",
    "latest_results",
    "stream_event_time",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = configured(SparkSession.builder.master(f"local[{cpus}]").appName("sensorflow-bench"))
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    timings: dict[str, float] = {}
    # One untimed pass over a simple query starts the JVM's threads and loads its classes.
    queries["agg_max"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
