"""The drift job: a stored reference against new data, one or many data sets at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift
from ..session import materialize


def store_reference(features: DataFrame, columns: list[str] | None = None, bins: int = drift.BINS) -> DataFrame:
    """The reference as a written table of features times bins; later comparisons do not read the
    reference data again."""
    return materialize(drift.reference_bins(features, columns, bins), "drift-reference")


def compare_sets(reference: DataFrame, sets: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(scenario, feature, psi, status) for every named data set."""
    named = None
    for name, features in sets.items():
        one = features.select(*columns).withColumn("scenario", F.lit(name))
        named = one if named is None else named.unionByName(one)
    return drift.drift_table(named, reference, columns, by=["scenario"])


def report(table: DataFrame) -> DataFrame:
    return drift.drift_report(table, ["scenario"])
