"""Table checks and the row-level valid / quarantine split.

All checks of a table are conditional aggregates of one pass; only key uniqueness and
referential integrity, which need a shuffle by key, run as passes of their own. Results are
rows of (check, passed, details).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import known
from ..sources.schemas import (
    BORROWER_COLUMNS,
    EMPLOYMENT_TYPES,
    HOME_OWNERSHIP,
    LOAN_PURPOSES,
    PAYMENT_COLUMNS,
    TRANSACTION_COLUMNS,
)
from .encode import numeric_columns

_NOT_REQUIRED = {"months_since_last_delinquency", "is_fraud", "lgd_value", "ead_value"}
REQUIRED_BORROWER_COLUMNS = [c for c in BORROWER_COLUMNS if c not in _NOT_REQUIRED]
LISTED_VALUES = 20  # in a check's detail; ``invalid_values`` returns all
RESULT_SCHEMA = "check string, passed boolean, details string"


def _holds(condition: Column) -> Column:
    """A null comparison counts as a failure."""
    return F.coalesce(condition, F.lit(False))


def _between(name: str, low: float, high: float) -> Column:
    return _holds(known(F.col(name)).between(low, high))


def _all(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(True))


def _missing(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if dict(df.dtypes)[name] in ("double", "float"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _as_rows(summary: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check"), p.alias("passed"), d.alias("details"))
            for n, p, d in checks
        ]
    )
    return summary.select(F.inline(rows))


def _schema_check(df: DataFrame, required: Iterable[str]) -> tuple[DataFrame, bool]:
    absent = sorted(set(required) - set(df.columns))
    row = [("schema", not absent, "Missing columns: " + ", ".join(absent))]
    return df.sparkSession.createDataFrame(row, RESULT_SCHEMA), not absent


def validate_borrowers(
    df: DataFrame, min_rows: int = 1000, max_null_fraction: float = 0.05, key: str = "borrower_id"
) -> DataFrame:
    schema, complete = _schema_check(df, REQUIRED_BORROWER_COLUMNS)
    n = F.col("n")
    row_check = ("min_rows", n >= min_rows, F.format_string(f"Got %d rows, need {min_rows}", n))
    if not complete:
        return _as_rows(df.agg(F.count(F.lit(1)).alias("n")), [row_check]).unionByName(schema)

    summary = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(_missing(df, c).cast("double")).alias(f"null_{c}") for c in REQUIRED_BORROWER_COLUMNS],
        _all(_between("age", 18, 100)).alias("age_range"),
        _all(_holds(known(F.col("annual_income")) > 0)).alias("income_positive"),
        _all(_between("credit_utilization_ratio", 0.0, 2.0)).alias("utilization_range"),
        F.avg(F.col("is_default").cast("double")).alias("default_rate"),
        F.count_if(~_holds(F.col("employment_type").isin(EMPLOYMENT_TYPES))).alias("bad_employment"),
    )
    rate = F.col("default_rate")
    checks = [
        row_check,
        *[
            (
                f"null_{c}",
                _holds(F.col(f"null_{c}") <= max_null_fraction),
                F.format_string(f"{c}: %.3f null fraction", F.col(f"null_{c}")),
            )
            for c in REQUIRED_BORROWER_COLUMNS
        ],
        ("age_range", F.col("age_range"), F.lit("Age out of [18, 100]")),
        ("income_positive", F.col("income_positive"), F.lit("Negative income found")),
        ("utilization_range", F.col("utilization_range"), F.lit("Utilization out of [0, 2.0]")),
        (
            "default_rate",
            _holds(rate.between(0.01, 0.30)),
            F.format_string("Default rate %.3f outside [0.01, 0.30]", rate),
        ),
        (
            "employment_type_valid",
            F.col("bad_employment") == 0,
            F.format_string(
                "Rows with an invalid employment type: %d (values: %s)", F.col("bad_employment"), F.col("bad_values")
            ),
        ),
    ]
    listed = _listed_values(invalid_values(df, "employment_type", EMPLOYMENT_TYPES), "employment_type", "bad_values")
    summary = summary.join(F.broadcast(listed), F.lit(True))  # one row each
    return _as_rows(summary, checks).unionByName(schema).unionByName(unique_key(df, key))


def unique_key(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key; null counts as a key of its own."""
    extra = df.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra"))
    return _as_rows(
        extra,
        [(f"{key}_unique", F.col("extra") == 0, F.format_string(f"Duplicate {key}s: %d", F.col("extra")))],
    )


def referential_integrity(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Count of distinct keys of ``df`` that ``parents`` does not know."""
    unknown = df.select(key).distinct().join(parents.select(key), key, "left_anti")
    counted = unknown.agg(F.count(F.lit(1)).alias("n"))
    detail = F.format_string(f"%d unknown {key}s", F.col("n"))
    return _as_rows(counted, [("referential_integrity", F.col("n") == 0, detail)])


def unknown_keys(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The unknown keys themselves."""
    return df.select(key).distinct().join(parents.select(key), key, "left_anti")


def _validate_events(
    df: DataFrame, required, conditions: dict[str, tuple[Column, str]], parents: DataFrame | None, key: str
) -> DataFrame:
    schema, complete = _schema_check(df, required)
    if not complete:
        return schema
    summary = df.agg(*[_all(_holds(c)).alias(n) for n, (c, _) in conditions.items()])
    out = schema.unionByName(_as_rows(summary, [(n, F.col(n), F.lit(d)) for n, (_, d) in conditions.items()]))
    if parents is not None:
        out = out.unionByName(referential_integrity(df, parents, key))
    return out


def validate_transactions(df: DataFrame, borrowers: DataFrame | None = None, key: str = "borrower_id") -> DataFrame:
    conditions = {"amount_positive": (known(F.col("amount")) > 0, "Non-positive amounts found")}
    return _validate_events(df, TRANSACTION_COLUMNS, conditions, borrowers, key)


def validate_payments(df: DataFrame, borrowers: DataFrame | None = None, key: str = "borrower_id") -> DataFrame:
    conditions = {
        f"{c}_non_negative": (known(F.col(c)) >= 0, f"Negative {c}")
        for c in ("amount_due", "amount_paid", "days_past_due")
    }
    return _validate_events(df, PAYMENT_COLUMNS, conditions, borrowers, key)


def validate_features(df: DataFrame) -> DataFrame:
    """Infinite values (a failure) and columns with a single value (reported only)."""
    names = numeric_columns(df)
    infinite = [
        F.count_if(F.abs(F.col(c).cast("double")) == F.lit(float("inf"))).alias(f"inf_{i}")
        for i, c in enumerate(names)
    ]
    constant = [
        ((F.count(c) > 1) & (F.min(c) == F.max(c))).alias(f"flat_{i}") for i, c in enumerate(names)
    ]
    summary = df.agg(*infinite, *constant)
    found = sum((F.col(f"inf_{i}") for i in range(len(names))), F.lit(0))
    flat = F.array_compact(F.array(*[F.when(F.col(f"flat_{i}"), F.lit(c)) for i, c in enumerate(names)]))
    listed = F.when(F.size(flat) == 0, F.lit("No zero variance columns")).otherwise(
        F.concat(F.lit("Zero variance columns: "), F.concat_ws(", ", flat))
    )
    return _as_rows(
        summary,
        [
            ("no_infinities", found == 0, F.format_string("%d infinite values found", found)),
            ("no_zero_variance", F.lit(True), listed),
        ],
    )


def invalid_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Every value outside the allowed set with its row count; null is one of them."""
    return df.filter(~_holds(F.col(column).isin(allowed))).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def _listed_values(values: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the values by name, null as ``null``. Beyond ``LISTED_VALUES`` the text ends in an ellipsis."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")
    first = values.select(text).distinct().orderBy("value").limit(LISTED_VALUES + 1)
    found = first.agg(F.sort_array(F.collect_list("value")).alias("values"))
    shown = F.array_join(F.slice("values", 1, LISTED_VALUES), ", ")
    more = F.when(F.size("values") > LISTED_VALUES, F.lit(", ...")).otherwise(F.lit(""))
    return found.select(F.concat(shown, more).alias(name))


def overall(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Roll checks up: all passed, how many ran, how many failed."""
    return checks.groupBy(*(by or [])).agg(
        F.bool_and("passed").alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def _at_least(name: str, low: float, high: float | None = None) -> Column:
    value = known(F.col(name))
    return value.between(low, high) if high is not None else value >= low


_PROFILE_RULES = {
    "age": lambda: _at_least("age", 18, 100),
    "annual_income": lambda: known(F.col("annual_income")) > 0,
    "employment_length_years": lambda: _at_least("employment_length_years", 0),
    "existing_credit_lines": lambda: _at_least("existing_credit_lines", 0),
    "total_credit_limit": lambda: _at_least("total_credit_limit", 0),
    "current_credit_balance": lambda: _at_least("current_credit_balance", 0),
    "number_of_delinquencies": lambda: _at_least("number_of_delinquencies", 0),
    "debt_to_income_ratio": lambda: _at_least("debt_to_income_ratio", 0),
    "requested_loan_amount": lambda: known(F.col("requested_loan_amount")) > 0,
    "account_age_months": lambda: _at_least("account_age_months", 0),
    "profile_completeness_score": lambda: _at_least("profile_completeness_score", 0, 1),
    "device_type": lambda: F.col("device_type").isNotNull(),
}


def borrower_rules() -> dict[str, Column]:
    return {
        "borrower_id": F.col("borrower_id").isNotNull(),
        **{n: rule() for n, rule in _PROFILE_RULES.items()},
        "credit_utilization_ratio": _at_least("credit_utilization_ratio", 0, 2),
        "employment_type": F.col("employment_type").isin(EMPLOYMENT_TYPES),
        "home_ownership": F.col("home_ownership").isin(HOME_OWNERSHIP),
        "loan_purpose": F.col("loan_purpose").isin(LOAN_PURPOSES),
        "state": F.length("state") == 2,
    }


def application_rules() -> dict[str, Column]:
    """Requests are looser than stored borrowers: any category text, utilization optional."""
    return {
        **{c: F.col(c).isNotNull() for c in ("application_id", "borrower_id")},
        **{n: rule() for n, rule in _PROFILE_RULES.items()},
        **{c: F.col(c).isNotNull() for c in ("employment_type", "home_ownership", "loan_purpose", "state")},
    }


def transaction_rules() -> dict[str, Column]:
    present = ("transaction_id", "borrower_id", "timestamp", "merchant_category", "is_international", "channel",
               "is_declined")
    return {**{c: F.col(c).isNotNull() for c in present}, "amount": known(F.col("amount")) > 0}


def payment_rules() -> dict[str, Column]:
    present = ("borrower_id", "payment_date", "due_date", "payment_status")
    limits = ("amount_due", "amount_paid", "days_past_due")
    return {**{c: F.col(c).isNotNull() for c in present}, **{c: _at_least(c, 0) for c in limits}}


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks. Batch and streaming."""
    broken = [F.when(~_holds(condition), F.lit(name)) for name, condition in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the quarantined rows with their reasons."""
    judged = with_violations(df, rules)
    return judged.filter(F.size("violations") == 0).drop("violations"), judged.filter(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows broken per rule, for the rules that are broken at all."""
    reasons = with_violations(df, rules).select(F.explode_outer("violations").alias("reason"))
    return reasons.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
