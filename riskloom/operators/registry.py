"""Catalogue of the computed features as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Feature name, description, type, group, source, nullable.
DEFINITIONS = [
    ("age", "Borrower age in years", "float64", "demographic", "borrowers", False),
    ("log_annual_income", "Log of annual income", "float64", "demographic", "computed", False),
    ("employment_length_years", "Years at current employer", "float64", "demographic", "borrowers", False),
    ("account_age_months", "Months since account creation", "int64", "demographic", "borrowers", False),
    ("profile_completeness_score", "Fraction of profile fields filled", "float64", "demographic", "borrowers", False),
    ("credit_utilization_ratio", "Current balance / credit limit", "float64", "credit_history", "borrowers", False),
    ("existing_credit_lines", "Number of open credit lines", "int64", "credit_history", "borrowers", False),
    ("months_since_last_delinquency", "Months since last late payment", "float64", "credit_history", "borrowers", True),
    ("number_of_delinquencies", "Total delinquencies on record", "int64", "credit_history", "borrowers", False),
    ("debt_to_income_ratio", "Total debt / annual income", "float64", "credit_history", "borrowers", False),
    ("txn_count_7d", "Transaction count in last 7 days", "int64", "velocity", "computed", False),
    ("txn_count_30d", "Transaction count in last 30 days", "int64", "velocity", "computed", False),
    ("txn_count_90d", "Transaction count in last 90 days", "int64", "velocity", "computed", False),
    ("txn_amount_sum_7d", "Total spend in last 7 days", "float64", "velocity", "computed", False),
    ("txn_amount_sum_30d", "Total spend in last 30 days", "float64", "velocity", "computed", False),
    ("txn_amount_sum_90d", "Total spend in last 90 days", "float64", "velocity", "computed", False),
    ("txn_amount_mean_30d", "Avg transaction in last 30 days", "float64", "velocity", "computed", False),
    ("txn_amount_std_30d", "Std dev of transactions in 30 days", "float64", "velocity", "computed", False),
    ("txn_amount_max_30d", "Max single transaction in 30 days", "float64", "velocity", "computed", False),
    ("decline_rate_30d", "Fraction of declined txns in 30 days", "float64", "velocity", "computed", False),
    ("international_txn_rate_30d", "Fraction of international txns", "float64", "velocity", "computed", False),
    ("avg_spend_grocery", "Average monthly grocery spend", "float64", "aggregation", "computed", False),
    ("avg_spend_restaurant", "Average monthly restaurant spend", "float64", "aggregation", "computed", False),
    ("avg_spend_online", "Average monthly online spend", "float64", "aggregation", "computed", False),
    ("avg_spend_travel", "Average monthly travel spend", "float64", "aggregation", "computed", False),
    ("merchant_diversity_30d", "Unique merchant categories in 30d", "int64", "aggregation", "computed", False),
    ("channel_diversity", "Unique channels used", "int64", "aggregation", "computed", False),
    ("spend_category_entropy", "Shannon entropy of spend categories", "float64", "aggregation", "computed", False),
    ("mobile_txn_fraction", "Fraction of mobile transactions", "float64", "behavioral", "computed", False),
    ("weekend_txn_fraction", "Fraction of weekend transactions", "float64", "behavioral", "computed", False),
    ("nighttime_txn_fraction", "Fraction of transactions 10pm-6am", "float64", "behavioral", "computed", False),
    ("spend_trend_3m", "Linear trend of monthly spend (3m)", "float64", "time_series", "computed", False),
    ("spend_trend_6m", "Linear trend of monthly spend (6m)", "float64", "time_series", "computed", False),
    ("spend_volatility_6m", "CV of monthly spend", "float64", "time_series", "computed", False),
    ("txn_frequency_trend", "Trend in monthly transaction count", "float64", "time_series", "computed", False),
    ("on_time_payment_rate", "Fraction of on-time payments", "float64", "risk", "computed", False),
    ("avg_days_past_due", "Average days past due", "float64", "risk", "computed", False),
    ("max_days_past_due", "Maximum days past due ever", "int64", "risk", "computed", False),
    ("missed_payment_count", "Total missed payments", "int64", "risk", "computed", False),
    ("payment_amount_ratio", "Average (paid / due)", "float64", "risk", "computed", False),
    ("consecutive_on_time", "Current on-time payment streak", "int64", "risk", "computed", False),
    ("payment_trend_3m", "Trend in payment timeliness (3m)", "float64", "risk", "computed", False),
    ("loan_to_income_ratio", "Requested loan / annual income", "float64", "risk", "computed", False),
    ("balance_to_income_ratio", "Credit balance / annual income", "float64", "risk", "computed", False),
    ("utilization_x_dti", "Interaction: utilization * DTI", "float64", "risk", "computed", False),
    ("income_stability_proxy", "employment_length / age", "float64", "risk", "computed", False),
]

SCHEMA = "name string, description string, dtype string, `group` string, source string, nullable boolean"


def feature_registry(spark: SparkSession, group: str | None = None) -> DataFrame:
    registry = spark.createDataFrame(DEFINITIONS, SCHEMA)
    return registry if group is None else registry.filter(F.col("group") == group)


def feature_names(group: str | None = None) -> list[str]:
    return [d[0] for d in DEFINITIONS if group is None or d[3] == group]


def registered_columns(df: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with, per feature, how many rows of ``df`` hold a value: coverage of a matrix."""
    names = [c for c in df.columns if c in feature_names()]
    filled = df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "name", "filled_rows")
    return registry.join(filled, "name", "left")
