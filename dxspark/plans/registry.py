"""Registry of named queries: the Spark callable and its DuckDB oracle.

A query is `fn(spark, sf_dir) -> DataFrame`. Its oracle is plain SQL over the
base tables and the fx views (inlined as CTEs by `with_fixtures`). Queries whose
result is not SQL-expressible (fitted models, sampled explanations) register
without an oracle and are covered by property tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dxspark.plans.fixtures import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register `fn` under `key`, with an optional oracle SQL text."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_fixtures(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that the registry is complete."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"dxspark.plans.{m}")


MODULES = ("queries_sources", "queries_reshape", "queries_joins", "queries_agg",
           "queries_scalars", "queries_codes", "queries_features", "queries_models",
           "queries_explain", "queries_graph")
