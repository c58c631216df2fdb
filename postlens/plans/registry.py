"""Registry of named queries (one per operator of the inventory).

A query binds an operator to the driver tables: ``fn(spark, sf_dir) -> DataFrame``.
Its oracle is the same computation written as portable SQL for DuckDB (with
the derived views inlined as CTEs).  Operators with no SQL form register no
oracle and are checked by pytest against hand-made or brute-force results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its ``register`` calls run."""
    import importlib

    for mod in MODULES:
        importlib.import_module(f"postlens.plans.{mod}")


MODULES = ("q_stats", "q_sampling", "q_merge", "q_quality", "q_dashboard", "q_text", "q_keywords",
           "q_scoring", "q_batching", "q_streams", "q_rules")
