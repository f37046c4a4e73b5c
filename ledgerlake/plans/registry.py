"""Registry of named queries: a Spark job and, where SQL can state it, its
DuckDB twin over the driver's views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .context import Lake

QueryFn = Callable[[Lake], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load_all() -> None:
    from . import (q_generators, q_metrics, q_models, q_pipelines,  # noqa: F401
                   q_quality, q_sinks, q_sources)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def bind(fn: QueryFn):
        return lambda spark, sf_dir: fn(Lake(spark, sf_dir))
    return {name: bind(fn) for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
