"""Registered queries: a Spark plan and, where SQL can say it, its check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.catalog.views import with_views
from tillworks.sources.adapters import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None, **ctes: str):
    """Registers a plan under ``key``; ``sql`` is the same result for DuckDB."""

    def register(plan: Callable[[Tables], DataFrame]):
        PLANS[key] = plan
        if sql is not None:
            CHECKS[key] = with_views(sql, **ctes)
        return plan

    return register


def _plain(df: DataFrame) -> DataFrame:
    """Dates leave as ISO text, so both engines hand over the same values."""
    return df.select(*[F.col(f"`{n}`").cast("string").alias(n) if t == "date" else F.col(f"`{n}`") for n, t in df.dtypes])


def run(key: str, spark: SparkSession, folder: str) -> DataFrame:
    return _plain(PLANS[key](Tables(spark, folder)))
