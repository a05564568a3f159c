"""Registered queries (Spark) and their independent DuckDB oracles.

Every query reads the driver's tables (through the fixture views) at whatever
scale ``sf_dir`` points to and returns a DataFrame; its oracle is ANSI SQL over
the same base tables with the fixture views inlined as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import arrivals, batching, edges, history, ops, stars, symbols  # noqa: F401
