"""Where queries and their checks are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dispatchery.plans.views_sql import with_views
from dispatchery.sources.archive import Archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of an Archive as a query, with the SQL that checks it."""

    def register(fn: Callable[[Archive], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Archive.at(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
