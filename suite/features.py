"""Feature families and the assembled matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import distinct
from riskloom.operators import payments as pay
from riskloom.operators import profile as prof
from riskloom.operators import transactions as txn
from riskloom.session import shared_folder

from .registry import FINER, query, rounded
from .views import LONG_REFERENCE, RECENT_REFERENCE, table, with_views


def _velocity_sql(view: str, ref: str, digits: int | None = 6) -> str:
    def r(e):
        return f"round({e}, {digits})" if digits is not None else e

    since = {d: f"timestamp >= TIMESTAMP '{ref} 00:00:00' - INTERVAL {d} DAY" for d in (7, 30, 90)}
    counted = ",\n".join(
        f"count(amount) FILTER ({since[d]}) AS txn_count_{d}d,"
        f" {r(f'coalesce(sum(amount) FILTER ({since[d]}), 0)')} AS txn_amount_sum_{d}d"
        for d in (7, 30, 90)
    )
    m = since[30]
    return f"""
SELECT borrower_id, {counted},
  {r(f'coalesce(avg(amount) FILTER ({m}), 0)')} AS txn_amount_mean_30d,
  {r(f'coalesce(stddev_samp(amount) FILTER ({m}), 0)')} AS txn_amount_std_30d,
  {r(f'coalesce(max(amount) FILTER ({m}), 0)')} AS txn_amount_max_30d,
  {r(f'coalesce(avg(is_declined::INT) FILTER ({m}), 0)')} AS decline_rate_30d,
  {r(f'coalesce(avg(is_international::INT) FILTER ({m}), 0)')} AS international_txn_rate_30d
FROM {view} WHERE {since[90]} GROUP BY borrower_id"""


def _spend_sql(view: str, ref: str, digits: int | None = 6) -> str:
    def r(e):
        return f"round({e}, {digits})" if digits is not None else e

    cats = ",\n".join(
        f"{r(f'coalesce(max(mean_spend) FILTER (merchant_category = {c!r}), 0)')} AS avg_spend_{c}"
        for c in txn.SPEND_CATEGORIES
    )
    return f"""
SELECT borrower_id, {cats},
  coalesce(max(merchant_diversity_30d), 0) AS merchant_diversity_30d,
  coalesce(max(channel_diversity), 0) AS channel_diversity,
  {r("sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END)")} AS spend_category_entropy
FROM (
  SELECT *, spend / greatest(sum(spend) OVER (PARTITION BY borrower_id), 1e-8) AS p
  FROM (
    SELECT borrower_id, merchant_category, sum(month_spend) AS spend, avg(month_spend) AS mean_spend
    FROM (SELECT borrower_id, date_trunc('month', timestamp) AS m, merchant_category, sum(amount) AS month_spend
          FROM {view} GROUP BY ALL) a GROUP BY ALL) b) c
LEFT JOIN (
  SELECT borrower_id, count(DISTINCT merchant_category) AS merchant_diversity_30d,
    count(DISTINCT channel) AS channel_diversity
  FROM {view} WHERE timestamp >= TIMESTAMP '{ref} 00:00:00' - INTERVAL 30 DAY GROUP BY borrower_id) d
USING (borrower_id)
GROUP BY borrower_id"""


def _behavior_sql(view: str, digits: int | None = 6) -> str:
    def r(e):
        return f"round({e}, {digits})" if digits is not None else e

    return f"""
SELECT borrower_id, {r("avg((channel = 'mobile')::INT)")} AS mobile_txn_fraction,
  {r("avg((isodow(timestamp) >= 6)::INT)")} AS weekend_txn_fraction,
  {r("avg((hour(timestamp) IN (22, 23, 0, 1, 2, 3, 4, 5))::INT)")} AS nighttime_txn_fraction
FROM {view} GROUP BY borrower_id"""


def _trend_sql(view: str, digits: int | None = 6) -> str:
    def r(e):
        return f"round({e}, {digits})" if digits is not None else e

    def slope(measure, n):
        return r(f"CASE WHEN count(*) FILTER (back <= {n}) < 2 THEN 0 ELSE"
                 f" regr_slope({measure}, -back) FILTER (back <= {n}) END")

    return f"""
SELECT borrower_id, {slope('spend', 3)} AS spend_trend_3m, {slope('spend', 6)} AS spend_trend_6m,
  {slope('n', 6)} AS txn_frequency_trend,
  {r('coalesce(stddev_samp(spend) / (avg(spend) + 1e-8), 0)')} AS spend_volatility_6m
FROM (
  SELECT *, row_number() OVER (PARTITION BY borrower_id ORDER BY m DESC) AS back
  FROM (SELECT borrower_id, date_trunc('month', timestamp) AS m, sum(amount) AS spend, count(amount) AS n
        FROM {view} GROUP BY ALL) a) b
GROUP BY borrower_id"""


def _payment_sql(digits: int | None = 6) -> str:
    def r(e):
        return f"round({e}, {digits})" if digits is not None else e

    return f"""
SELECT borrower_id, {r("avg((payment_status = 'on_time')::INT)")} AS on_time_payment_rate,
  {r("avg(days_past_due)")} AS avg_days_past_due,
  max(days_past_due)::DOUBLE AS max_days_past_due,
  count(*) FILTER (payment_status = 'missed') AS missed_payment_count,
  {"avg(amount_paid / greatest(amount_due, 1))" if digits is None else
   f"round(avg(amount_paid / greatest(amount_due, 1)), {FINER['payment_amount_ratio']})"} AS payment_amount_ratio,
  count(*) FILTER (breaks = 0) AS consecutive_on_time,
  {r("CASE WHEN count(*) FILTER (back <= 3) < 2 THEN 0 ELSE regr_slope(days_past_due, -back) FILTER (back <= 3) END")}
    AS payment_trend_3m
FROM (
  SELECT *, row_number() OVER w AS back,
    sum((payment_status <> 'on_time')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS breaks
  FROM payments
  WINDOW w AS (PARTITION BY borrower_id
    ORDER BY due_date DESC, (payment_status <> 'on_time') DESC, days_past_due DESC)) a
GROUP BY borrower_id"""


for _view, _ref in (("recent_transactions", RECENT_REFERENCE), ("long_transactions", LONG_REFERENCE)):
    _tag = _view.split("_")[0]
    # Means of two-decimal amounts over 64 rows have 8 decimals; the long view's sums allow only 6.
    _digits = 8 if _tag == "recent" else 6

    @query(f"velocity_features_{_tag}", with_views([_view], _velocity_sql(_view, _ref, _digits)))
    def _(spark, folder, view=_view, ref=_ref, digits=_digits):
        return rounded(txn.velocity_features(table(spark, folder, view), ref), digits)

    @query(f"spend_features_{_tag}", with_views([_view], _spend_sql(_view, _ref)))
    def _(spark, folder, view=_view, ref=_ref):
        return rounded(txn.spend_features(table(spark, folder, view), ref))

    @query(f"behavior_features_{_tag}", with_views([_view], _behavior_sql(_view)))
    def _(spark, folder, view=_view):
        return rounded(txn.behavior_features(table(spark, folder, view)))

    @query(f"trend_features_{_tag}", with_views([_view], _trend_sql(_view)))
    def _(spark, folder, view=_view):
        return rounded(txn.trend_features(table(spark, folder, view)))


_WINDOWS = [7, 30, 90]


def _distinct_sql(view: str, ref: str) -> str:
    since = {d: f"timestamp >= TIMESTAMP '{ref} 00:00:00' - INTERVAL {d} DAY" for d in _WINDOWS}
    counts = ", ".join(
        f"count(DISTINCT {c}) FILTER ({since[d]}) AS {name}_{d}d" for d in _WINDOWS for c, name in distinct.DIVERSITY.items()
    )
    return f"SELECT borrower_id, {counts} FROM {view} WHERE {since[90]} GROUP BY borrower_id"


for _view, _ref in (("recent_transactions", RECENT_REFERENCE), ("long_transactions", LONG_REFERENCE)):

    @query(f"diversity_from_days_{_view.split('_')[0]}", with_views([_view], _distinct_sql(_view, _ref)))
    def _(spark, folder, view=_view, ref=_ref):
        """Sketches of all days are written once; three windows are united from them."""
        path = shared_folder(spark, "day-sketches")
        days = distinct.daily_sketches(table(spark, folder, view), ["borrower_id"], list(distinct.DIVERSITY))
        distinct.save_months(days, path)
        return distinct.window_distinct(distinct.read_months(spark, path), ["borrower_id"], distinct.DIVERSITY, ref, _WINDOWS)


@query(
    "clients_from_days",
    with_views(
        ["requests"],
        "SELECT endpoint, count(DISTINCT client_id) AS clients, true AS within FROM requests GROUP BY endpoint",
    ),
)
def _(spark, folder):
    """Clients per endpoint, counted exactly, and whether the estimate lies within four standard errors."""
    requests = table(spark, folder, "requests")
    days = distinct.daily_sketches(requests, ["endpoint"], ["client_id"], at="requested_at")
    estimated = days.groupBy("endpoint").agg(F.hll_sketch_estimate(F.hll_union_agg("client_id")).alias("estimate"))
    exact = requests.groupBy("endpoint").agg(F.count_distinct("client_id").alias("clients"))
    off = F.abs(F.col("estimate") - F.col("clients"))
    near = off <= 4 * distinct.relative_error() * F.col("clients") + 1
    return exact.join(estimated, "endpoint").select("endpoint", "clients", near.alias("within"))


def _transaction_sql(view: str, ref: str, digits: int | None = 6) -> str:
    return f"""
SELECT s.borrower_id, v.* EXCLUDE (borrower_id), s.* EXCLUDE (borrower_id), b.* EXCLUDE (borrower_id),
  t.* EXCLUDE (borrower_id)
FROM ({_spend_sql(view, ref, digits)}) s JOIN ({_behavior_sql(view, digits)}) b USING (borrower_id)
JOIN ({_trend_sql(view, digits)}) t USING (borrower_id)
LEFT JOIN ({_velocity_sql(view, ref, digits)}) v USING (borrower_id)"""


@query(
    "transaction_features_fused",
    with_views(["long_transactions"], _transaction_sql("long_transactions", LONG_REFERENCE)),
)
def _(spark, folder):
    return rounded(txn.transaction_features(table(spark, folder, "long_transactions"), LONG_REFERENCE))


@query(
    "monthly_rollup",
    with_views(
        ["long_transactions"],
        """
SELECT borrower_id, m::DATE AS month, round(spend, 4) AS total_spend, n AS txn_count,
  row_number() OVER (PARTITION BY borrower_id ORDER BY m) - 1 AS month_idx
FROM (SELECT borrower_id, date_trunc('month', timestamp) AS m, sum(amount) AS spend, count(amount) AS n
      FROM long_transactions GROUP BY ALL) a""",
    ),
)
def _(spark, folder):
    out = rounded(txn.monthly_rollup(table(spark, folder, "long_transactions")), 4)
    return out.withColumn("month_idx", out["month_idx"].cast("bigint"))


@query("payment_features", with_views(["payments"], _payment_sql()))
def _(spark, folder):
    return rounded(pay.payment_features(table(spark, folder, "payments")))


PROFILE_SQL = """age::DOUBLE AS age, ln(1 + annual_income) AS log_annual_income, employment_length_years,
  account_age_months::DOUBLE AS account_age_months, profile_completeness_score"""
CREDIT_SQL = """credit_utilization_ratio, existing_credit_lines::DOUBLE AS existing_credit_lines,
  months_since_last_delinquency, number_of_delinquencies::DOUBLE AS number_of_delinquencies, debt_to_income_ratio"""
RATIO_SQL = """CASE WHEN annual_income IS NOT NULL THEN requested_loan_amount / greatest(annual_income, 1) END
    AS loan_to_income_ratio,
  CASE WHEN annual_income IS NOT NULL THEN current_credit_balance / greatest(annual_income, 1) END
    AS balance_to_income_ratio,
  credit_utilization_ratio * debt_to_income_ratio AS utilization_x_dti,
  employment_length_years / greatest(age, 1) AS income_stability_proxy"""


def _round_all(body: str, columns: list[str], rest: str, digits: int = 6) -> str:
    return "SELECT " + rest + ", " + ", ".join(f"round({c}, {digits}) AS {c}" for c in columns) + f" FROM ({body}) q"


@query(
    "profile_features",
    with_views(
        ["borrowers"],
        _round_all(
            f"SELECT borrower_id, {PROFILE_SQL}, employment_type, home_ownership, loan_purpose, device_type, state"
            " FROM borrowers",
            prof.PROFILE_FEATURES,
            "borrower_id, employment_type, home_ownership, loan_purpose, device_type, state",
        ),
    ),
)
def _(spark, folder):
    return rounded(prof.profile_features(table(spark, folder, "borrowers")))


@query(
    "credit_features",
    with_views(
        ["borrowers"], _round_all(f"SELECT borrower_id, {CREDIT_SQL} FROM borrowers", prof.CREDIT_FEATURES, "borrower_id")
    ),
)
def _(spark, folder):
    return rounded(prof.credit_features(table(spark, folder, "borrowers")))


@query(
    "ratio_features",
    with_views(
        ["borrowers"], _round_all(f"SELECT borrower_id, {RATIO_SQL} FROM borrowers", prof.RATIO_FEATURES, "borrower_id")
    ),
)
def _(spark, folder):
    return rounded(prof.ratio_features(table(spark, folder, "borrowers")))
