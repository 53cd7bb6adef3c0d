"""
the driver's tables, with its independent DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import fresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            with fresh():
                return fn(spark, sf_dir)
        query.__name__, query.__doc__ = name, fn.__doc__
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _load_all() -> None:
    # Importing the query modules fills the registry.
    from . import q_metrics, q_text, q_extraction, q_curation, q_crossmodel, q_prep, q_io  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
