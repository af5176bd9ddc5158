"""From model outputs to score, tier, expected loss and decision. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip

# Fixed values of the scorecard.
FRAUD_THRESHOLD = 0.5
DECLINE_SCORE = 550
REVIEW_SCORE = 620
SCORE_CENTRE = 575.0
SCORE_PER_LOGIT = 55.0
SCORE_MIN, SCORE_MAX = 300.0, 850.0
PD_MARGIN = 1e-6
TIER_LIMITS = {"low": 0.05, "medium": 0.15, "high": 0.30}
TOP_TIER = "very_high"
REGULATORY_CONVERSION = 0.75
DEFAULT_DRAWN, DEFAULT_LIMIT = 0.0, 10000.0

SCORE_COLUMNS = [
    "pd",
    "lgd",
    "ead",
    "expected_loss",
    "credit_score",
    "risk_tier",
    "fraud_score",
    "fraud_flag",
    "decision",
]


def credit_score(pd: Column) -> Column:
    bounded = clip(pd, PD_MARGIN, 1 - PD_MARGIN)
    points = SCORE_CENTRE - SCORE_PER_LOGIT * F.ln(bounded / (1 - bounded))
    return clip(points, SCORE_MIN, SCORE_MAX).cast("int")


def risk_tier(pd: Column) -> Column:
    tiers = None
    for tier, limit in TIER_LIMITS.items():
        tiers = F.when(pd < limit, tier) if tiers is None else tiers.when(pd < limit, tier)
    return F.when(pd.isNotNull(), tiers.otherwise(TOP_TIER))


def decide(score: Column, fraud_flag: Column) -> Column:
    """A fraud flag outranks any score."""
    return (
        F.when(fraud_flag, "manual_review")
        .when(score < DECLINE_SCORE, "declined")
        .when(score < REVIEW_SCORE, "manual_review")
        .otherwise("approved")
    )


def exposure(conversion: Column, drawn: Column, limit: Column) -> Column:
    """Drawn plus the converted part of the undrawn limit; the limit wins over drawn."""
    return clip(drawn + conversion * clip(limit - drawn, 0.0), drawn, limit)


def score_frame(
    df: DataFrame,
    pd: str = "pd",
    lgd: str = "lgd",
    fraud: str = "fraud_score",
    conversion: str | None = None,
    drawn: str | None = None,
    limit: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The nine score columns next to ``keep``. Missing drawn or limit columns take the defaults,
    a missing conversion column the regulatory factor."""
    factor = clip(F.col(conversion), 0.0, 1.0) if conversion else F.lit(REGULATORY_CONVERSION)
    used = F.col(drawn) if drawn else F.lit(DEFAULT_DRAWN)
    granted = F.col(limit) if limit else F.lit(DEFAULT_LIMIT)
    return df.select(
        *(keep or []),
        F.col(pd).alias("pd"),
        F.col(lgd).alias("lgd"),
        exposure(factor, used, granted).alias("ead"),
        F.col(fraud).alias("fraud_score"),
    ).select(
        *(keep or []),
        "pd",
        "lgd",
        "ead",
        (F.col("pd") * F.col("lgd") * F.col("ead")).alias("expected_loss"),
        credit_score(F.col("pd")).alias("credit_score"),
        risk_tier(F.col("pd")).alias("risk_tier"),
        "fraud_score",
        (F.col("fraud_score") > FRAUD_THRESHOLD).alias("fraud_flag"),
        decide(credit_score(F.col("pd")), F.col("fraud_score") > FRAUD_THRESHOLD).alias("decision"),
    )


def portfolio_rollup(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean PD and summed expected loss for every prefix of ``by`` and in total."""
    return scored.rollup(*by).agg(
        F.count(F.lit(1)).alias("applications"),
        F.avg("pd").alias("avg_pd"),
        F.sum("expected_loss").alias("expected_loss"),
        F.avg("credit_score").alias("avg_score"),
    )
