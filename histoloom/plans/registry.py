"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from histoloom.session import importable_on_workers

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("column_queries", "spatial_queries", "expression_queries", "source_queries", "bulk_queries")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under a name, with its SQL where there is one."""

    def keep(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable_on_workers(spark)
            return function(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return function

    return keep


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"histoloom.plans.{module}")


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    _load()
    return dict(_SQL)
