"""Registered queries: each is a Spark job over the given tables plus its DuckDB oracle SQL.

``REGISTRY[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
Every query reads whole tables; none caps rows to make the check cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # Import for side effects: each module registers its queries.
    from newsprism.plans import (  # noqa: F401
        queries_core, queries_more, queries_outlets, queries_sinks, queries_sources, queries_state, queries_streaming,
    )
    return REGISTRY
