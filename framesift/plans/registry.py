"""Named queries, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only that it runs can be checked."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"there is a query called {name} already")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register
