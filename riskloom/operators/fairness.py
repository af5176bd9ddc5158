"""Group fairness of predictions: one aggregate per group, then reports over the few groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAVORABLE = 0
MAX_DISPARITY = 0.10
MIN_IMPACT_RATIO = 0.80


def group_rates(df: DataFrame, group: str, label: str, pred: str, favorable: int = FAVORABLE,
                by: list[str] | None = None) -> DataFrame:
    """Approval, true-positive and false-positive rate per group; 0 where a rate has no rows."""
    p = F.col(pred).cast("double")

    def rate(mask: Column) -> Column:
        return F.coalesce(F.avg(F.when(mask, p)), F.lit(0.0))

    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(*(by or []), group)
        .agg(
            F.avg((F.col(pred) == favorable).cast("double")).alias("approval_rate"),
            rate(F.col(label) == 1).alias("tpr"),
            rate(F.col(label) == 0).alias("fpr"),
            F.count(F.lit(1)).alias("rows"),
        )
    )


def _spread(name: str) -> Column:
    return F.coalesce(F.max(name) - F.min(name), F.lit(0.0))


def demographic_parity(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    found = rates.groupBy(*(by or [])).agg(_spread("approval_rate").alias("max_disparity"))
    return found.withColumn("passed", F.col("max_disparity") < MAX_DISPARITY)


def equalized_odds(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Both gaps are reported; only the true-positive gap decides."""
    found = rates.groupBy(*(by or [])).agg(
        _spread("tpr").alias("tpr_disparity"), _spread("fpr").alias("fpr_disparity")
    )
    return found.withColumn("passed", F.col("tpr_disparity") < MAX_DISPARITY)


def _privileged_rate(group: str, privileged: str) -> Column:
    """Approval rate of the privileged group; 1 when that group is absent."""
    mine = F.col(group).cast("string") == privileged
    return F.coalesce(F.max(F.when(mine, F.col("approval_rate"))), F.lit(1.0))


def impact_ratios(rates: DataFrame, group: str, privileged: str, by: list[str] | None = None) -> DataFrame:
    """Each other group's approval rate over the privileged group's; 0 where that one is 0."""
    by = by or []
    others = F.collect_list(
        F.when(
            F.col(group).cast("string") != privileged,
            F.struct(F.col(group).cast("string").alias("name"), F.col("approval_rate").alias("rate")),
        )
    )
    grouped = rates.groupBy(*by).agg(_privileged_rate(group, privileged).alias("base"), others.alias("others"))
    ratio = F.coalesce(F.try_divide(F.col("other.rate"), F.col("base")), F.lit(0.0))
    return grouped.select(*by, "base", F.explode("others").alias("other")).select(
        *by, F.concat(F.col("other.name"), F.lit(f"_vs_{privileged}")).alias("pair"), ratio.alias("ratio")
    )


def disparate_impact(rates: DataFrame, group: str, privileged: str, by: list[str] | None = None) -> DataFrame:
    """The smallest ratio and the four-fifths verdict; 1 when there is no other group."""
    mine = F.col(group).cast("string") == privileged
    lowest = F.min(F.when(~mine, F.col("approval_rate")))
    base = _privileged_rate(group, privileged)
    ratio = F.when(lowest.isNull(), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(lowest, base), F.lit(0.0)))
    found = rates.groupBy(*(by or [])).agg(ratio.alias("min_ratio"))
    return found.withColumn("passed", F.col("min_ratio") >= MIN_IMPACT_RATIO)


def fairness_report(rates: DataFrame, group: str, privileged: str, by: list[str] | None = None) -> DataFrame:
    """One row (per ``by``): parity, odds and impact with their verdicts, from one pass over the groups."""
    mine = F.col(group).cast("string") == privileged
    lowest = F.min(F.when(~mine, F.col("approval_rate")))
    ratio = F.when(lowest.isNull(), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(lowest, _privileged_rate(group, privileged)), F.lit(0.0))
    )
    found = rates.groupBy(*(by or [])).agg(
        _spread("approval_rate").alias("max_disparity"),
        _spread("tpr").alias("tpr_disparity"),
        _spread("fpr").alias("fpr_disparity"),
        ratio.alias("min_ratio"),
    )
    return found.withColumns(
        {
            "parity_passed": F.col("max_disparity") < MAX_DISPARITY,
            "odds_passed": F.col("tpr_disparity") < MAX_DISPARITY,
            "impact_passed": F.col("min_ratio") >= MIN_IMPACT_RATIO,
        }
    )


def bias_warnings(history: DataFrame, timestamp: str = "recorded_at") -> DataFrame:
    """Warnings from the latest fairness record, given at least two records."""
    latest = history.agg(
        F.count(F.lit(1)).alias("records"),
        F.max_by(F.struct("parity_passed", "impact_passed"), timestamp).alias("last"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(~F.col("last.parity_passed"), F.lit("Demographic parity check failed")),
            F.when(~F.col("last.impact_passed"), F.lit("Disparate impact ratio below 0.80 threshold")),
        )
    )
    return latest.filter(F.col("records") >= 2).select(F.explode(warnings).alias("warning"))
