"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trencher.plans.catalogue import Catalogue, base_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    """Register ``fn(catalogue)``; ``sql`` continues the base ``WITH`` clause.

    SQL that starts with a comma adds further views before its final SELECT.
    """

    def wrap(fn: Callable[[Catalogue], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Catalogue(spark, folder))
        if sql is not None:
            ORACLES[name] = base_sql() + sql if base else sql
        return fn

    return wrap
