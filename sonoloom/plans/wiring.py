"""A registry of queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonoloom.sources.views import duck

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, key: str, query: Query, sql: str | None = None) -> None:
        self.queries[key] = query
        if sql:
            self.oracles[key] = duck(sql)
