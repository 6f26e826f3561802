"""The book of registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers fn(spark, sf_dir) -> DataFrame under a name, with the DuckDB SQL that gives the same rows."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add
