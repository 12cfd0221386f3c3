"""The registry of queries: a name, a callable of (spark, sf_dir), and the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(function):
        REGISTRY[function.__name__] = (function, sql)
        return function

    return register
