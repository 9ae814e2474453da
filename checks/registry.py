"""Registered queries: name -> (Spark query, DuckDB SQL)."""

from __future__ import annotations

REGISTRY: dict[str, tuple] = {}


def check(sql: str | None, name: str | None = None):
    """Register a query with the SQL that gives the same rows; its name is the operator's or the function's."""

    def register(query):
        key = name or query.__name__
        if key in REGISTRY:
            raise ValueError(f"{key} is registered twice")
        REGISTRY[key] = (query, sql)
        return query

    return register
