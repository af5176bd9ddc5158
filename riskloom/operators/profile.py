"""Per-borrower projections: profile, credit standing and risk ratios. No shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, known, ratio_floor
from ..sources.schemas import CATEGORICAL_COLUMNS

PROFILE_FEATURES = [
    "age",
    "log_annual_income",
    "employment_length_years",
    "account_age_months",
    "profile_completeness_score",
]
CREDIT_FEATURES = [
    "credit_utilization_ratio",
    "existing_credit_lines",
    "months_since_last_delinquency",
    "number_of_delinquencies",
    "debt_to_income_ratio",
]
RATIO_FEATURES = [
    "loan_to_income_ratio",
    "balance_to_income_ratio",
    "utilization_x_dti",
    "income_stability_proxy",
]
CROSSES = {
    "utilization_x_dti_cross": ("credit_utilization_ratio", "debt_to_income_ratio"),
    "income_x_loan_cross": ("log_annual_income", "loan_to_income_ratio"),
    "delinquency_x_utilization_cross": ("number_of_delinquencies", "credit_utilization_ratio"),
}


def _number(name: str):
    return known(F.col(name))


def _profile_columns():
    return [
        _number("age").alias("age"),
        F.log1p(_number("annual_income")).alias("log_annual_income"),
        _number("employment_length_years").alias("employment_length_years"),
        _number("account_age_months").alias("account_age_months"),
        _number("profile_completeness_score").alias("profile_completeness_score"),
    ]


def _credit_columns():
    return [_number(c).alias(c) for c in CREDIT_FEATURES]


def _ratio_columns():
    income = _number("annual_income")
    return [
        ratio_floor(_number("requested_loan_amount"), income).alias("loan_to_income_ratio"),
        ratio_floor(_number("current_credit_balance"), income).alias("balance_to_income_ratio"),
        (_number("credit_utilization_ratio") * _number("debt_to_income_ratio")).alias("utilization_x_dti"),
        ratio_floor(_number("employment_length_years"), _number("age")).alias("income_stability_proxy"),
    ]


def present_categoricals(df: DataFrame) -> list[str]:
    return [c for c in [*CATEGORICAL_COLUMNS, "state"] if c in df.columns]


def profile_features(borrowers: DataFrame, key: str = "borrower_id") -> DataFrame:
    return borrowers.select(key, *_profile_columns(), *present_categoricals(borrowers))


def credit_features(borrowers: DataFrame, key: str = "borrower_id") -> DataFrame:
    return borrowers.select(key, *_credit_columns())


def ratio_features(borrowers: DataFrame, key: str = "borrower_id") -> DataFrame:
    return borrowers.select(key, *_ratio_columns())


def borrower_features(borrowers: DataFrame, key: str = "borrower_id", keep: list[str] | None = None) -> DataFrame:
    """All three families in one projection of the borrower row, instead of three joined ones."""
    return borrowers.select(
        key,
        *[c for c in (keep or []) if c in borrowers.columns],
        *_profile_columns(),
        *present_categoricals(borrowers),
        *_credit_columns(),
        *_ratio_columns(),
    )


def with_utilization(borrowers: DataFrame) -> DataFrame:
    """Fill an absent or null utilization with balance over limit."""
    derived = ratio_floor(F.col("current_credit_balance"), F.col("total_credit_limit"))
    if "credit_utilization_ratio" in borrowers.columns:
        derived = F.coalesce(_number("credit_utilization_ratio"), derived)
    return borrowers.withColumn("credit_utilization_ratio", derived)


def cross_features(features: DataFrame, key: str = "borrower_id") -> DataFrame:
    """The wide part of the challenger model: products of feature pairs."""
    return features.select(key, *[(F.col(a) * F.col(b)).alias(n) for n, (a, b) in CROSSES.items()])


def application_features(applications: DataFrame, key: str = "application_id") -> DataFrame:
    """Features of new applications, which have no history yet. Works on streams as well."""
    return borrower_features(with_utilization(applications), key=key)


def exposure_label(drawn, limit, conversion):
    """Exposure at default: drawn plus the converted part of the undrawn limit, 2 decimals.

    Where drawn exceeds the limit the limit wins.
    """
    exposure = drawn + conversion * clip(limit - drawn, 0.0)
    return F.round(clip(exposure, drawn, limit), 2)


def conversion_label(exposure, drawn, limit):
    """Observed credit conversion factor in [0, 1]; 0 where nothing was undrawn."""
    undrawn = limit - drawn
    return F.when(undrawn > 0, clip((exposure - drawn) / undrawn, 0.0, 1.0)).otherwise(F.lit(0.0))
