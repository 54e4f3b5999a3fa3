"""Registered queries over the fixture tables, each beside the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) callable and, where SQL can state it, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


from tideline.plans import catalog_queries, identity_queries, index_queries, library_queries, media_queries, timeline_queries  # noqa: E402,F401
