"""Collects the queries and, where SQL can state them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with the SQL it must agree with."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# A mean of two-decimal ratios over 32 or 64 rows lies exactly between two 6-digit numbers.
FINER = {"payment_amount_ratio": 9}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: the engines add in different orders, so the last bits differ."""
    return df.select(
        *[F.round(c, FINER.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
