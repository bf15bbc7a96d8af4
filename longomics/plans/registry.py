"""Registry of named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return fn
    return wrap


def rnd(value: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, for results compared across engines."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[rnd(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def rq(expression: str, alias: str, digits: int = 6) -> str:
    """SQL twin of :func:`rnd`."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {alias}"
