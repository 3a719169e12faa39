"""The registry of queries: name, function of (spark, sf_dir), SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.plans.inputs import derived, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Register a function of derived tables (in the order named); ``sql`` reads tables of the same names."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(derived(spark, sf_dir, t) for t in tables))
        if sql is not None:
            SQL[name] = with_tables(sql, *tables)
        return f

    return add
