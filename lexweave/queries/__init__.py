"""The registered queries of the library and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL for the same rows."""

    def put(f: Query) -> Query:
        REGISTRY[name or f.__name__] = (f, sql)
        return f

    return put


def load() -> dict[str, tuple[Query, str | None]]:
    from lexweave.queries import catalog, chat, context, search, structure, text  # noqa: F401

    return REGISTRY
