"""Champion and challenger side by side: both score the same row in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .decision import FRAUD_THRESHOLD, credit_score, decide


def shadow_log(
    applications: DataFrame,
    champion_pd: str,
    challenger_pd: str,
    fraud: str = "fraud_score",
    key: str = "application_id",
    traffic: float = 1.0,
    timestamp: str | None = None,
    latencies: tuple[str, str] | None = None,
) -> DataFrame:
    """Comparison rows for the shadowed share of traffic.

    The share is drawn from the key, so a retried task shadows the same rows. A challenger
    without a usable probability is left out of the log, as its scoring failed.
    """
    flagged = F.col(fraud) > FRAUD_THRESHOLD
    champion, challenger = F.col(champion_pd), F.col(challenger_pd)
    usable = challenger.isNotNull() & ~F.isnan(challenger)
    drawn = F.lit(True) if traffic >= 1.0 else uniform(F.col(key), "shadow") < traffic
    first, second = credit_score(champion), credit_score(challenger)
    spent = latencies or (None, None)

    def latency(name: str | None) -> Column:
        return F.round(F.col(name).cast("double"), 2) if name else F.lit(None).cast("double")

    return (
        applications.filter(usable & drawn)
        .select(
            key,
            champion.alias("champion_pd"),
            challenger.alias("challenger_pd"),
            first.alias("champion_score"),
            second.alias("challenger_score"),
            decide(first, flagged).alias("champion_decision"),
            decide(second, flagged).alias("challenger_decision"),
            latency(spent[0]).alias("champion_latency_ms"),
            latency(spent[1]).alias("challenger_latency_ms"),
            (F.col(timestamp) if timestamp else F.current_timestamp()).alias("timestamp"),
        )
        .withColumn("agreement", F.col("champion_decision") == F.col("challenger_decision"))
    )


def recommendation(agreement: Column, correlation: Column) -> Column:
    # The published wording and limits.
    return (
        F.when(
            (agreement >= 0.95) & (correlation >= 0.98),
            "SAFE TO PROMOTE: High agreement, strong correlation.",
        )
        .when(agreement >= 0.90, "REVIEW NEEDED: Good agreement but check disagreement cases.")
        .when(agreement >= 0.80, "CAUTION: Moderate disagreement. Run longer before promoting.")
        .otherwise("DO NOT PROMOTE: Significant behavioral differences detected.")
    )


def comparison_report(log: DataFrame) -> DataFrame:
    """One row: agreement, correlation, differences, latencies, disagreement breakdown, advice."""
    apart = ~F.col("agreement")
    lenient = apart & (F.col("challenger_decision") == "approved") & (F.col("champion_decision") != "approved")
    strict = apart & (F.col("challenger_decision") == "declined") & (F.col("champion_decision") != "declined")
    found = log.agg(
        F.count(F.lit(1)).alias("n_comparisons"),
        F.avg(F.col("agreement").cast("double")).alias("agreement"),
        F.corr("champion_pd", "challenger_pd").alias("correlation"),
        F.avg(F.col("challenger_pd") - F.col("champion_pd")).alias("pd_gap"),
        F.avg(F.col("challenger_score") - F.col("champion_score")).alias("score_gap"),
        F.avg("champion_latency_ms").alias("champion_ms"),
        F.avg("challenger_latency_ms").alias("challenger_ms"),
        F.count_if(apart).alias("disagreements"),
        F.count_if(lenient).alias("challenger_more_lenient"),
        F.count_if(strict).alias("challenger_more_strict"),
    )
    other = F.col("disagreements") - F.col("challenger_more_lenient") - F.col("challenger_more_strict")
    some = F.col("n_comparisons") > 0
    return found.select(
        F.when(some, "active").otherwise("no_data").alias("status"),
        "n_comparisons",
        F.round("agreement", 4).alias("decision_agreement_rate"),
        F.round("correlation", 4).alias("pd_correlation"),
        F.round("pd_gap", 6).alias("pd_mean_difference"),
        F.round("score_gap", 2).alias("credit_score_mean_difference"),
        F.round("champion_ms", 2).alias("champion_avg_latency_ms"),
        F.round("challenger_ms", 2).alias("challenger_avg_latency_ms"),
        "disagreements",
        "challenger_more_lenient",
        "challenger_more_strict",
        other.alias("other"),
        F.when(some, recommendation(F.col("agreement"), F.coalesce(F.col("correlation"), F.lit(0.0)))).alias(
            "recommendation"
        ),
    )


def recent_comparisons(log: DataFrame, n: int = 20, key: str = "application_id") -> DataFrame:
    """The latest ``n`` comparisons: a top-n, not a sort of the log."""
    return log.orderBy(F.col("timestamp").desc(), F.col(key).desc()).limit(n)
