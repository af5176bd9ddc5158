"""Population stability: equal-width reference histograms and the shift against them.

The reference is a table with one row per feature and bin. Binning is column arithmetic and
counting combines map-side, so comparing a data set costs one scan and a shuffle of features
times bins.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, known
from ..functions.hashing import uniform
from .encode import long_form, numeric_columns

BINS = 10
OUTSIDE = -1
SMALLEST_SHARE = 1e-6
WARNING_PSI, ALERT_PSI = 0.10, 0.25


def _bin(value: Column, low: Column, width: Column, bins: int) -> Column:
    """0-based bin of ``value``; the last bin includes the upper edge.

    The quotient can be off by one next to an edge, so it is checked against the edges as
    they are defined: ``low + k * width``.
    """
    guess = F.least(F.lit(bins - 1), F.floor((value - low) / width).cast("int"))
    over = (guess < bins - 1) & (value >= (guess + 1) * width + low)
    under = (guess > 0) & (value < guess * width + low)
    return guess + over.cast("int") - under.cast("int")


def feature_ranges(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """(feature, low, high, width) from one aggregate; features without a usable range are left out.

    A constant feature gets a range of one around its value.
    """
    bounds = df.agg(
        *[F.min(known(F.col(c))).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(known(F.col(c))).alias(f"hi_{i}") for i, c in enumerate(columns)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"lo_{i}").alias("least"), F.col(f"hi_{i}").alias("most"))
            for i, c in enumerate(columns)
        ]
    )
    flat = F.when(F.col("least") == F.col("most"), F.lit(0.5)).otherwise(F.lit(0.0))
    infinite = F.lit(float("inf"))
    return (
        bounds.select(F.inline(entries))
        .filter(F.col("least").isNotNull() & (F.abs("least") < infinite) & (F.abs("most") < infinite))
        .select("feature", (F.col("least") - flat).alias("low"), (F.col("most") + flat).alias("high"))
        .withColumn("width", (F.col("high") - F.col("low")) / F.lit(float(bins)))
    )


def bin_counts(
    df: DataFrame, columns: list[str], ranges: DataFrame, bins: int = BINS, by: list[str] | None = None
) -> DataFrame:
    """Rows per feature and bin, with ``OUTSIDE`` for values beyond the reference range.

    ``ranges`` has one row per column of the frame, so broadcasting it is bounded by the width
    of the table, not by its length. Counts of several parts can be added up.
    """
    by = by or []
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    values = long_form(df, columns, by).withColumn("value", known(value)).filter(value.isNotNull())
    place = F.when(value.between(low, high), _bin(value, low, F.col("width"), bins)).otherwise(F.lit(OUTSIDE))
    return (
        values.join(F.broadcast(ranges), "feature")
        .withColumn("bin", place)
        .groupBy(*by, "feature", "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def bin_shares(counts: DataFrame, bins: int = BINS, by: list[str] | None = None) -> DataFrame:
    """Shares over all bins, empty ones included, of every feature that has a value at all."""
    keys = [*(by or []), "feature"]
    inside = F.col("bin") != OUTSIDE
    per_bin = [
        F.coalesce(F.sum(F.when(F.col("bin") == k, F.col("rows"))), F.lit(0)).alias(f"bin_{k}") for k in range(bins)
    ]
    whole = F.greatest(F.coalesce(F.sum(F.when(inside, F.col("rows"))), F.lit(0)), F.lit(1)).alias("total")
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("bin"), (F.col(f"bin_{k}") / F.col("total")).alias("current_share"))
            for k in range(bins)
        ]
    )
    return counts.groupBy(*keys).agg(*per_bin, whole).select(*keys, F.inline(entries))


def reference_bins(df: DataFrame, columns: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """The reference distribution: (feature, bin, low, high, width, share) with empty bins included."""
    columns = columns or numeric_columns(df)
    ranges = feature_ranges(df, columns, bins)
    shares = bin_shares(bin_counts(df, columns, ranges, bins), bins)
    return shares.join(F.broadcast(ranges), "feature").select(
        "feature", "bin", "low", "high", "width", F.col("current_share").alias("share")
    )


def reference_ranges(reference: DataFrame) -> DataFrame:
    return reference.filter(F.col("bin") == 0).select("feature", "low", "high", "width")


def current_bins(
    df: DataFrame, reference: DataFrame, columns: list[str], bins: int = BINS, by: list[str] | None = None
) -> DataFrame:
    """Shares of the current data on the reference bins; values outside the range are dropped.

    Only features present here with at least one value appear. ``by`` compares several data
    sets (scenarios, days) at once.
    """
    return bin_shares(bin_counts(df, columns, reference_ranges(reference), bins, by), bins, by)


def stability_index(current: DataFrame, reference: DataFrame, by: list[str] | None = None) -> DataFrame:
    """PSI per feature from the shares of both sides."""
    c, r = clip(F.col("current_share"), SMALLEST_SHARE), clip(F.col("share"), SMALLEST_SHARE)
    joined = current.join(reference.select("feature", "bin", "share"), ["feature", "bin"])
    return joined.groupBy(*(by or []), "feature").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def feature_drift(index: DataFrame) -> DataFrame:
    """Status from the unrounded index; the index itself is then shown with 4 decimals."""
    psi = F.col("psi")
    status = F.when(psi < WARNING_PSI, "stable").when(psi < ALERT_PSI, "warning").otherwise("alert")
    return index.withColumn("status", status).withColumn("psi", F.round("psi", 4))


def drift_table(
    df: DataFrame, reference: DataFrame, columns: list[str], bins: int = BINS, by: list[str] | None = None
) -> DataFrame:
    """Feature, PSI and status, most drifted first."""
    current = current_bins(df, reference, columns, bins, by)
    return feature_drift(stability_index(current, reference, by)).orderBy(F.col("psi").desc(), "feature")


def drift_report(drift: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overall status (the worst one), drifted and total feature counts."""
    alert, warning = F.bool_or(F.col("status") == "alert"), F.bool_or(F.col("status") == "warning")
    return drift.groupBy(*(by or [])).agg(
        F.when(alert, "alert").when(warning, "warning").otherwise("stable").alias("overall_status"),
        F.count_if(F.col("status") != "stable").alias("n_features_drifted"),
        F.count(F.lit(1)).alias("n_features_total"),
    )


# Distribution function of Poisson(1) as far as it differs from 1: a draw is the steps it reaches.
POISSON_STEPS = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(17)]
SCENARIOS = ("economic_downturn", "demographic_shift", "seasonal")


def stressed_borrowers(borrowers: DataFrame, scenario: str, key: str = "borrower_id") -> DataFrame:
    """Borrowers under a stress scenario. Draws depend on the key, so a rerun gives the same rows."""

    def between(low: float, high: float, salt: str) -> Column:
        return F.lit(low) + uniform(F.col(key), f"{scenario}:{salt}") * F.lit(high - low)

    c = F.col
    if scenario == "economic_downturn":
        extra = uniform(c(key), f"{scenario}:delinquency")
        more = sum((extra >= limit).cast("int") for limit in POISSON_STEPS)
        changes = {
            "annual_income": c("annual_income") * between(0.75, 0.95, "income"),
            "credit_utilization_ratio": clip(c("credit_utilization_ratio") * between(1.1, 1.6, "use"), 0.0, 2.0),
            "debt_to_income_ratio": clip(c("debt_to_income_ratio") * between(1.1, 1.4, "debt"), 0.0, 5.0),
            "number_of_delinquencies": c("number_of_delinquencies") + more,
        }
    elif scenario == "demographic_shift":
        years = F.floor(between(3, 10, "age"))
        changes = {
            "age": clip(c("age") - years, 18, 100).cast("int"),
            "employment_length_years": clip(c("employment_length_years") * between(0.3, 0.8, "job"), 0.0, 40.0),
            "account_age_months": clip(c("account_age_months") * between(0.3, 0.7, "account"), 1.0, 500.0).cast("int"),
        }
    elif scenario == "seasonal":
        changes = {
            "requested_loan_amount": c("requested_loan_amount") * between(1.1, 1.4, "loan"),
            "current_credit_balance": c("current_credit_balance") * between(1.05, 1.3, "balance"),
        }
    else:
        raise ValueError(f"unknown scenario {scenario}; known: {', '.join(SCENARIOS)}")
    return borrowers.withColumns(changes)
