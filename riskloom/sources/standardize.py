"""Raw public loan files mapped to the common borrower layout.

Attributes a file does not carry are drawn from a hash of the record's own id, so a rerun or a
retried task yields the same borrower. Column arithmetic only: one pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clip, known, ratio_floor
from ..functions.hashing import choose, uniform
from ..operators.profile import exposure_label
from .schemas import BORROWER_COLUMNS

# Column names of the two public files and the mapping tables.
GIVE_ME_CREDIT_SCHEMA = T.StructType(
    [
        T.StructField("record", T.LongType()),
        T.StructField("SeriousDlqin2yrs", T.IntegerType()),
        T.StructField("RevolvingUtilizationOfUnsecuredLines", T.DoubleType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("NumberOfTime30-59DaysPastDueNotWorse", T.IntegerType()),
        T.StructField("DebtRatio", T.DoubleType()),
        T.StructField("MonthlyIncome", T.DoubleType()),
        T.StructField("NumberOfOpenCreditLinesAndLoans", T.IntegerType()),
        T.StructField("NumberOfTimes90DaysLate", T.IntegerType()),
        T.StructField("NumberRealEstateLoansOrLines", T.IntegerType()),
        T.StructField("NumberOfTime60-89DaysPastDueNotWorse", T.IntegerType()),
        T.StructField("NumberOfDependents", T.IntegerType()),
    ]
)
LATE_COUNTERS = [
    "NumberOfTime30-59DaysPastDueNotWorse",
    "NumberOfTime60-89DaysPastDueNotWorse",
    "NumberOfTimes90DaysLate",
]
HOME_MAP = {"MORTGAGE": "mortgage", "RENT": "rent", "OWN": "own"}
PURPOSE_MAP = {
    "debt_consolidation": "debt_consolidation",
    "credit_card": "debt_consolidation",
    "home_improvement": "home_improvement",
    "small_business": "business",
    "educational": "education",
}
DEFAULTED_STATUS = ["Charged Off", "Default", "Late (31-120 days)"]
EMPLOYMENT_SHARES = {"employed": 0.65, "self_employed": 0.15, "unemployed": 0.10, "retired": 0.10}
CLUB_EMPLOYMENT_SHARES = {"employed": 0.70, "self_employed": 0.15, "unemployed": 0.05, "retired": 0.10}
HOME_SHARES = {"own": 0.20, "mortgage": 0.40, "rent": 0.40}
PURPOSE_SHARES = {
    "debt_consolidation": 0.40,
    "home_improvement": 0.15,
    "business": 0.15,
    "education": 0.10,
    "personal": 0.20,
}
DEVICE_SHARES = {"mobile": 0.55, "desktop": 0.35, "tablet": 0.10}
STATES = ["CA", "TX", "FL", "NY", "PA", "IL", "OH", "GA", "NC", "MI", "NJ", "VA", "WA", "AZ", "MA", "TN", "IN", "MO",
          "MD", "WI"]
FRAUD_SHARE = 0.015


def _field(df: DataFrame, name: str, kind: str) -> Column:
    """The raw field, or null when the file has no such column."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _mapped(value: Column, table: dict[str, str], default: str) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, value), F.lit(default))


class _Draws:
    """Attributes drawn from the record id."""

    def __init__(self, key: Column, seed: int):
        self.key, self.seed = key, seed

    def between(self, name: str, low: float, high: float) -> Column:
        return F.lit(low) + uniform(self.key, f"{self.seed}:{name}") * F.lit(high - low)

    def whole(self, name: str, low: int, high: int) -> Column:
        return F.floor(self.between(name, low, high)).cast("int")

    def choice(self, name: str, shares: dict[str, float]) -> Column:
        return choose(self.key, f"{self.seed}:{name}", shares)

    def flag(self, name: str, share: float) -> Column:
        return (uniform(self.key, f"{self.seed}:{name}") < share).cast("int")

    def decay(self, name: str, mean: float) -> Column:
        return -F.lit(mean) * F.ln(1 - uniform(self.key, f"{self.seed}:{name}"))

    def low_share(self, name: str, skew: float) -> Column:
        """A share in [0, 1) leaning to small values."""
        return F.pow(uniform(self.key, f"{self.seed}:{name}"), F.lit(skew))


def _finish(df: DataFrame, draws: _Draws, keep: list[str]) -> DataFrame:
    """Shared tail: profile attributes without a source, fraud, loss and exposure labels."""
    loss = F.round(draws.low_share("loss", 2.0), 4)
    drawn, limit = F.col("current_credit_balance"), F.col("total_credit_limit")
    return df.withColumns(
        {
            "account_age_months": draws.whole("account", 6, 180),
            "profile_completeness_score": F.round(draws.between("complete", 0.6, 1.0), 2),
            "device_type": draws.choice("device", DEVICE_SHARES),
            "is_fraud": draws.flag("fraud", FRAUD_SHARE),
            "lgd_value": F.when(F.col("is_default") == 1, loss).otherwise(F.lit(0.0)),
            "ead_value": exposure_label(drawn, limit, draws.low_share("conversion", 4.0)),
        }
    ).select(*keep)


def standardize_give_me_credit(raw: DataFrame, record: str = "record", seed: int = 42) -> DataFrame:
    """The "Give Me Some Credit" layout. ``record`` is the file's own row id, 0-based."""
    key = F.col(record)
    draws = _Draws(key, seed)

    def number(name: str, default: float) -> Column:
        return F.coalesce(known(_field(raw, name, "double")), F.lit(default))

    late = sum((number(c, 0.0) for c in LATE_COUNTERS), F.lit(0.0)).cast("int")
    states = F.array(*[F.lit(s) for s in STATES])
    mapped = raw.select(
        key.alias(record),
        F.format_string("gmc-%06d", key).alias("borrower_id"),
        F.coalesce(_field(raw, "age", "int"), draws.whole("age", 22, 70)).alias("age"),
        (number("MonthlyIncome", 4500.0) * 12).alias("annual_income"),
        F.round(clip(draws.decay("job", 5.0), 0.0, 40.0), 1).alias("employment_length_years"),
        draws.choice("employment", EMPLOYMENT_SHARES).alias("employment_type"),
        draws.choice("home", HOME_SHARES).alias("home_ownership"),
        number("NumberOfOpenCreditLinesAndLoans", 5.0).cast("int").alias("existing_credit_lines"),
        (number("RevolvingUtilizationOfUnsecuredLines", 0.5)).alias("_utilization"),
        late.alias("number_of_delinquencies"),
        F.when(late > 0, draws.whole("since", 1, 60).cast("double")).alias("months_since_last_delinquency"),
        clip(number("DebtRatio", 0.3), 0.0, 5.0).alias("debt_to_income_ratio"),
        draws.choice("purpose", PURPOSE_SHARES).alias("loan_purpose"),
        F.element_at(states, draws.whole("state", 0, len(STATES)) + 1).alias("state"),
        number("SeriousDlqin2yrs", 0.0).cast("int").alias("is_default"),
    )
    income = F.col("annual_income")
    limited = mapped.withColumns(
        {
            "total_credit_limit": F.round(income * draws.between("limit", 0.3, 1.5), 2),
            "requested_loan_amount": F.round(income * draws.between("loan", 0.1, 0.5), 2),
        }
    ).withColumn("current_credit_balance", F.round(F.col("total_credit_limit") * draws.low_share("use", 2.5), 2))
    own = "RevolvingUtilizationOfUnsecuredLines" in raw.columns
    used = F.col("_utilization") if own else ratio_floor(F.col("current_credit_balance"), F.col("total_credit_limit"))
    return _finish(limited.withColumn("credit_utilization_ratio", clip(used, 0.0, 2.0)), draws, BORROWER_COLUMNS)


def standardize_lending_club(raw: DataFrame, record: str = "id", seed: int = 42) -> DataFrame:
    """The "Lending Club" layout. ``record`` is the file's own row id, 0-based."""
    key = F.col(record)
    draws = _Draws(key, seed)

    def number(name: str, default: float) -> Column:
        return F.coalesce(known(_field(raw, name, "double")), F.lit(default))

    digits = F.regexp_extract(_field(raw, "emp_length", "string"), r"(\d+)", 1)
    years = F.coalesce(F.nullif(digits, F.lit("")).cast("double"), F.lit(3.0))
    status = _field(raw, "loan_status", "string").isin(DEFAULTED_STATUS)
    states = F.array(*[F.lit(s) for s in STATES[:4]])
    fallback_state = F.element_at(states, draws.whole("state", 0, 4) + 1)
    mapped = raw.select(
        key.alias(record),
        F.format_string("lc-%06d", key).alias("borrower_id"),
        draws.whole("age", 22, 70).alias("age"),
        number("annual_inc", 60000.0).alias("annual_income"),
        clip(years, 0.0, 40.0).alias("employment_length_years"),
        draws.choice("employment", CLUB_EMPLOYMENT_SHARES).alias("employment_type"),
        _mapped(_field(raw, "home_ownership", "string"), HOME_MAP, "rent").alias("home_ownership"),
        number("open_acc", 8.0).cast("int").alias("existing_credit_lines"),
        number("total_rev_hi_lim", 30000.0).alias("total_credit_limit"),
        number("revol_bal", 10000.0).alias("current_credit_balance"),
        clip(number("revol_util", 50.0) / 100, 0.0, 2.0).alias("credit_utilization_ratio"),
        known(_field(raw, "mths_since_last_delinq", "double")).alias("months_since_last_delinquency"),
        number("delinq_2yrs", 0.0).cast("int").alias("number_of_delinquencies"),
        clip(number("dti", 15.0) / 100, 0.0, 5.0).alias("debt_to_income_ratio"),
        number("loan_amnt", 15000.0).alias("requested_loan_amount"),
        _mapped(_field(raw, "purpose", "string"), PURPOSE_MAP, "personal").alias("loan_purpose"),
        (_field(raw, "addr_state", "string") if "addr_state" in raw.columns else fallback_state).alias("state"),
        F.coalesce(status, F.lit(False)).cast("int").alias("is_default"),
    )
    return _finish(mapped, draws, BORROWER_COLUMNS)
