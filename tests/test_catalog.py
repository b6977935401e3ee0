"""Catalog queries against DuckDB on the smallest tables (the driver checks all of them)."""

import math

import pytest
from conftest import TESTDATA

import __spark_entry__ as contract
from sensorflow import catalog

duckdb = pytest.importorskip("duckdb")
SMALL = TESTDATA / "sf0.001"
CHECKED = (
    "filter_cross_field",
    "normalize_degenerate",
    "step_chain",
    "agg_avg",
    "agg_max_datetime",
    "agg_empty_default",
    "multi_agg_fanout",
    "multi_job_join_shuffled",
    "config_validate",
    "config_asof_bucketed",
    "config_asof_untimed",
    "parse_configs",
    "agg_with_nans",
    "registered_step_and_aggregate",
    "latest_results",
    "parse_quarantine",
    "result_identity",
    "quality_label",
    "many_jobs",
    "agg_context_unordered",
    "step_tolerance",
    "job_files",
    "config_by_place",
    "document_store",
    "store_replay",
    "write_time",
    "identity_digest",
    "stream_live_config",
    "stream_recovery",
    "stream_late_rows",
)

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


def text(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def test_every_query_has_sql():
    assert set(catalog.all_queries()) == set(catalog.all_sql())
    assert set(catalog.all_queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = con.execute(contract.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    expected = sorted(tuple(text(r[i]) for i in order) for r in result.fetchall())
    df = contract.queries()[name](spark, str(SMALL))
    assert sorted(df.columns) == columns
    got = sorted(tuple(text(v) for v in r) for r in df.select(*columns).collect())
    assert got == expected and got


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
