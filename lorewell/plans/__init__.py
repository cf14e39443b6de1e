"""Named queries over the driver tables, each with a DuckDB statement to check against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def load_all() -> None:
    import importlib

    for part in ("corpus", "search", "logs", "admin", "streams"):
        importlib.import_module(f"lorewell.plans.{part}")
