"""Registry of driver queries: a Spark callable and, where SQL can say it, an equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def add(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql.strip()
        return build

    return add
