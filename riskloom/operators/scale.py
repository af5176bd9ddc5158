"""Standard scaling with the population standard deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaling(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, from one pass."""
    moments = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [
        F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)
    ]
    row = df.agg(*moments).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    """Centre and scale; a constant column is only centred."""
    return df.select(
        *[
            ((F.col(c) - F.lit(scaling[c][0])) / F.lit(scaling[c][1] or 1.0)).alias(c) if c in scaling else F.col(c)
            for c in df.columns
        ]
    )
