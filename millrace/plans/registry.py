"""Where queries and their SQL twins are registered."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under `name`, with its DuckDB SQL if any."""

    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register
