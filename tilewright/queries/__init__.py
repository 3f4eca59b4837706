"""Registered queries: ``QUERIES`` (name to callable) and ``SQL`` (name to oracle)."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    from . import general, matrix, trace

    queries: dict = {}
    sql: dict = {}
    for module in (matrix, trace, general):
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
