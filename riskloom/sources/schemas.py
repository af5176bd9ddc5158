"""Record layouts. Column names, order and allowed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

BORROWER_COLUMNS = [
    "borrower_id",
    "age",
    "annual_income",
    "employment_length_years",
    "employment_type",
    "home_ownership",
    "existing_credit_lines",
    "total_credit_limit",
    "current_credit_balance",
    "credit_utilization_ratio",
    "months_since_last_delinquency",
    "number_of_delinquencies",
    "debt_to_income_ratio",
    "requested_loan_amount",
    "loan_purpose",
    "state",
    "account_age_months",
    "profile_completeness_score",
    "device_type",
    "is_default",
    "is_fraud",
    "lgd_value",
    "ead_value",
]

TRANSACTION_COLUMNS = [
    "transaction_id",
    "borrower_id",
    "timestamp",
    "amount",
    "merchant_category",
    "is_international",
    "channel",
    "is_declined",
]

PAYMENT_COLUMNS = [
    "borrower_id",
    "payment_date",
    "due_date",
    "amount_due",
    "amount_paid",
    "days_past_due",
    "payment_status",
]

EMPLOYMENT_TYPES = ["employed", "self_employed", "unemployed", "retired"]
HOME_OWNERSHIP = ["own", "mortgage", "rent"]
LOAN_PURPOSES = ["debt_consolidation", "home_improvement", "business", "education", "personal"]
CATEGORICAL_COLUMNS = ["employment_type", "home_ownership", "loan_purpose", "device_type"]
TARGET_COLUMNS = ["is_default", "is_fraud", "lgd_value", "ead_value"]

_INTEGERS = {
    "age",
    "existing_credit_lines",
    "number_of_delinquencies",
    "account_age_months",
    "is_default",
    "is_fraud",
}
_STRINGS = {"borrower_id", "employment_type", "home_ownership", "loan_purpose", "state", "device_type"}


def _borrower_type(name: str) -> T.DataType:
    if name in _STRINGS:
        return T.StringType()
    return T.IntegerType() if name in _INTEGERS else T.DoubleType()


BORROWER_SCHEMA = T.StructType([T.StructField(c, _borrower_type(c)) for c in BORROWER_COLUMNS])

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("borrower_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("is_international", T.BooleanType()),
        T.StructField("channel", T.StringType()),
        T.StructField("is_declined", T.BooleanType()),
    ]
)

PAYMENT_SCHEMA = T.StructType(
    [
        T.StructField("borrower_id", T.StringType()),
        T.StructField("payment_date", T.TimestampType()),
        T.StructField("due_date", T.TimestampType()),
        T.StructField("amount_due", T.DoubleType()),
        T.StructField("amount_paid", T.DoubleType()),
        T.StructField("days_past_due", T.IntegerType()),
        T.StructField("payment_status", T.StringType()),
    ]
)

APPLICATION_COLUMNS = ["application_id", *[c for c in BORROWER_COLUMNS if c not in TARGET_COLUMNS]]

APPLICATION_SCHEMA = T.StructType(
    [T.StructField("application_id", T.StringType())]
    + [T.StructField(c, _borrower_type(c)) for c in APPLICATION_COLUMNS[1:]]
)
