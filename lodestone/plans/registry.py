"""All queries over the supplied tables, with the SQL that gives the same rows.

A query runs an operator on projections of the tables; its SQL is written on its own,
from what the operator is to compute.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import TABLES, Catalog, sql_for

Query = Callable[[Catalog], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(fn: Query) -> Query:
        name = fn.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} is there already")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_analysis, queries_core, queries_debug, queries_more, queries_report, queries_sources  # noqa: F401

    return {name: (lambda spark, sf_dir, fn=fn: fn(Catalog(spark, sf_dir))) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql_for("", {t: t for t in TABLES}, body.strip()) for name, body in _SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions scored and reported by stratum."""
    return queries()["A09_stratified_report"](spark, sf_dir)
