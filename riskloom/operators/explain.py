"""Why a row was scored as it was.

Contributions of a row are kept as one array on that row. Ranking them, naming reasons and
formatting notices are then row-local: nothing is unpivoted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import computed_once

# Reason code and wording per feature.
REASON_CODES = {
    "credit_utilization_ratio": ("AA001", "High credit utilization ratio"),
    "debt_to_income_ratio": ("AA002", "High debt-to-income ratio"),
    "number_of_delinquencies": ("AA003", "Number of delinquent accounts"),
    "months_since_last_delinquency": ("AA004", "Recent delinquency on record"),
    "on_time_payment_rate": ("AA005", "Insufficient payment history"),
    "missed_payment_count": ("AA006", "Number of missed payments"),
    "existing_credit_lines": ("AA007", "Limited number of credit accounts"),
    "account_age_months": ("AA008", "Insufficient account history"),
    "employment_length_years": ("AA009", "Length of employment"),
    "loan_to_income_ratio": ("AA010", "Requested amount relative to income"),
    "avg_days_past_due": ("AA011", "Average days past due on accounts"),
    "max_days_past_due": ("AA012", "Severe delinquency on record"),
    "spend_trend_6m": ("AA013", "Increasing spending trend"),
    "txn_amount_max_30d": ("AA014", "Unusually large recent transactions"),
    "decline_rate_30d": ("AA015", "High rate of declined transactions"),
    "international_txn_rate_30d": ("AA016", "High rate of international transactions"),
    "balance_to_income_ratio": ("AA017", "High balance relative to income"),
    "profile_completeness_score": ("AA018", "Incomplete application profile"),
    "payment_amount_ratio": ("AA019", "Insufficient payment amounts"),
    "consecutive_on_time": ("AA020", "Short streak of on-time payments"),
}
PROTECTED_FEATURES = {"age", "state_encoded"}
MAX_REASONS, MAX_FACTORS, MAX_LISTED = 4, 5, 20


def reason_codes(spark: SparkSession) -> DataFrame:
    rows = [(f, c, d) for f, (c, d) in REASON_CODES.items()]
    return spark.createDataFrame(rows, "feature string, code string, reason string")


def _entry(feature: str, value: Column, contribution: Column) -> Column:
    return F.struct(
        (-F.abs(contribution)).alias("order"),
        F.lit(feature).alias("feature"),
        value.alias("value"),
        contribution.alias("contribution"),
        F.when(contribution > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
    )


def linear_contributions(
    df: DataFrame,
    coefficients: dict[str, float],
    scaling: dict[str, tuple[float, float]],
    centre: dict[str, float] | None = None,
) -> DataFrame:
    """Add ``contributions``, strongest first: coefficient times distance from the background mean.

    ``scaling`` holds mean and deviation per feature; ``centre`` the background mean in
    unscaled units where it differs from the scaling mean. Order of equals is by name. Each
    contribution is worked out once, as a column; entries read it from there.
    """
    held, entries = {}, []
    for feature, weight in coefficients.items():
        mean, deviation = scaling[feature]
        origin = (centre or {}).get(feature, mean)
        value = F.col(feature).cast("double")
        scaled = (value - F.lit(float(origin))) / F.lit(float(deviation) or 1.0)
        name = f"_contribution_{len(held)}"
        held[name] = F.lit(float(weight)) * scaled
        entries.append(_entry(feature, value, F.col(name)))
    return df.withColumns(held).withColumn("contributions", F.sort_array(F.array(*entries))).drop(*held)


def from_long(contributions: DataFrame, key: str) -> DataFrame:
    """Arrays from (key, feature, value, contribution) rows, one row per feature of the model."""
    entry = F.struct(
        (-F.abs("contribution")).alias("order"),
        "feature",
        "value",
        "contribution",
        F.when(F.col("contribution") > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
    )
    return contributions.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("contributions"))


def global_importance(explained: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute contribution per feature, largest first.

    Arrays are exploded into (feature, contribution) and combined map-side: the shuffle holds
    one row per feature and task.
    """
    long = explained.select(F.inline_outer("contributions"))
    importance = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    return importance.filter(F.col("feature").isin(features)).orderBy(F.col("importance").desc(), "feature")


def _directed(direction: str, n: int) -> Column:
    picked = F.filter("contributions", lambda c: c["direction"] == direction)
    return F.slice(picked, 1, n)


def local_explanation(explained: DataFrame, key: str, n: int = MAX_LISTED) -> DataFrame:
    """The strongest ``n`` contributions with the top risk and protective factors of each row."""
    return explained.select(
        key,
        F.slice("contributions", 1, n).alias("feature_contributions"),
        _directed("increases_risk", MAX_FACTORS).alias("top_risk_factors"),
        _directed("decreases_risk", MAX_FACTORS).alias("top_protective_factors"),
    )


def contribution_rows(explained: DataFrame, key: str, column: str = "contributions") -> DataFrame:
    """One row per contribution with its 1-based place.

    The outer form, because for the plain one the optimiser repeats the whole array expression
    in a filter on its size.
    """
    return (
        explained.select(key, F.posexplode_outer(column))
        .filter(F.col("pos").isNotNull())
        .select(
            key,
            (F.col("pos") + 1).alias("place"),
            "col.feature",
            "col.value",
            "col.contribution",
            "col.direction",
        )
    )


def adverse_reasons(explained: DataFrame, max_reasons: int = MAX_REASONS) -> DataFrame:
    """Add ``reasons``: up to four coded features that raise the risk, strongest first.

    Protected features and features without a code take no slot.
    """
    codes = F.create_map(
        *[F.lit(x) for f, (c, _) in REASON_CODES.items() if f not in PROTECTED_FEATURES for x in (f, c)]
    )
    wording = F.create_map(
        *[F.lit(x) for f, (_, d) in REASON_CODES.items() if f not in PROTECTED_FEATURES for x in (f, d)]
    )
    coded = [f for f in REASON_CODES if f not in PROTECTED_FEATURES]
    usable = F.filter(
        "contributions", lambda c: (c["direction"] == "increases_risk") & c["feature"].isin(coded)
    )
    reasons = F.transform(
        F.slice(usable, 1, max_reasons),
        lambda c: F.struct(
            F.element_at(codes, c["feature"]).alias("code"),
            F.element_at(wording, c["feature"]).alias("description"),
            c["feature"].alias("feature"),
            F.abs(c["contribution"]).alias("impact_score"),
        ),
    )
    return explained.withColumn("reasons", reasons)


def reason_rows(reasoned: DataFrame, key: str) -> DataFrame:
    """One row per reason."""
    return reasoned.select(key, F.inline_outer("reasons")).filter(F.col("code").isNotNull())


def notice(reasoned: DataFrame, key: str) -> DataFrame:
    """The (code, reason) list of an adverse-action notice."""
    pairs = F.transform("reasons", lambda r: F.struct(r["code"].alias("code"), r["description"].alias("reason")))
    return reasoned.select(key, pairs.alias("adverse_action_reasons"))


def declined_only(df: DataFrame) -> DataFrame:
    """Reasons are owed for declined applications; filtering first keeps the rest unexplained.

    Pass only the columns needed: a decision is worked out once per row, and so is every other column.
    """
    return computed_once(df).filter(F.col("decision") == "declined")
