"""Queries over the given tables and the SQL each must agree with."""

from sensorflow.catalog import aggregations, configurations, elements, inputs, stored, streamed

_MODULES = (elements, aggregations, configurations, inputs, stored, streamed)


def all_queries():
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def all_sql():
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
