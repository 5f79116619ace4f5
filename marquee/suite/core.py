"""Registry of runnable queries, each with its check query where plain SQL can state the result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.plans.binding import Star, oracle_tables

_queries: dict[str, Callable[[Star], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(star) -> DataFrame`` under ``name``; ``sql`` may use the bound table names."""

    def register(fn):
        if name in _queries:
            raise ValueError(f"duplicate query {name}")
        _queries[name] = fn
        if sql is not None:
            _oracles[name] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Star(spark, sf_dir))

    return {name: bind(fn) for name, fn in _queries.items()}


def oracle_sql() -> dict[str, str]:
    tables = oracle_tables()
    return {name: _with_tables(sql, tables) for name, sql in _oracles.items()}


def _with_tables(sql: str, tables: dict[str, str]) -> str:
    """Prefix the bound tables that ``sql`` names."""
    used = [f"{name} AS ({body})" for name, body in tables.items() if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return f"WITH {', '.join(used)}, {body[4:].lstrip()}"
    return f"WITH {', '.join(used)} {body}"
