"""Transaction features.

The history of a borrower is long and a single borrower may own a large part of it, so every
operator combines rows before they are shuffled by borrower, and windows run only over
per-month or per-category totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cutoff, known, month_start, rate_or_zero, total

DEFAULT_REFERENCE_DATE = "2024-12-31"
VELOCITY_DAYS = (7, 30, 90)
SPEND_CATEGORIES = ("grocery", "restaurant", "online", "travel")
TINY = 1e-8

VELOCITY_FEATURES = [
    *[f"txn_{what}_{d}d" for d in VELOCITY_DAYS for what in ("count", "amount_sum")],
    "txn_amount_mean_30d",
    "txn_amount_std_30d",
    "txn_amount_max_30d",
    "decline_rate_30d",
    "international_txn_rate_30d",
]
SPEND_FEATURES = [
    *[f"avg_spend_{c}" for c in SPEND_CATEGORIES],
    "merchant_diversity_30d",
    "channel_diversity",
    "spend_category_entropy",
]
BEHAVIOR_FEATURES = ["mobile_txn_fraction", "weekend_txn_fraction", "nighttime_txn_fraction"]
TREND_FEATURES = ["spend_trend_3m", "spend_trend_6m", "txn_frequency_trend", "spend_volatility_6m"]
TRANSACTION_FEATURES = [*VELOCITY_FEATURES, *SPEND_FEATURES, *BEHAVIOR_FEATURES, *TREND_FEATURES]


def _amount() -> Column:
    return known(F.col("amount"))


def _weekend() -> Column:
    return F.coalesce((F.weekday("timestamp") >= 5).cast("long"), F.lit(0))


def _night() -> Column:
    hour = F.hour("timestamp")
    return F.coalesce(((hour >= 22) | (hour < 6)).cast("long"), F.lit(0))


def _mobile() -> Column:
    return F.coalesce((F.col("channel") == "mobile").cast("long"), F.lit(0))


def _velocity_aggregates(txns: DataFrame, reference_date) -> list[Column]:
    since = {d: F.col("timestamp") >= cutoff(txns, "timestamp", reference_date, d) for d in VELOCITY_DAYS}
    amount, month = _amount(), since[30]
    counted = [
        column
        for d in VELOCITY_DAYS
        for column in (
            F.count(F.when(since[d], amount)).alias(f"txn_count_{d}d"),
            total(F.when(since[d], amount)).alias(f"txn_amount_sum_{d}d"),
        )
    ]

    def zero(aggregate: Column) -> Column:
        return F.coalesce(aggregate, F.lit(0.0))

    return counted + [
        zero(F.avg(F.when(month, amount))).alias("txn_amount_mean_30d"),
        zero(F.stddev_samp(F.when(month, amount))).alias("txn_amount_std_30d"),
        zero(F.max(F.when(month, amount))).alias("txn_amount_max_30d"),
        zero(F.avg(F.when(month, F.col("is_declined").cast("double")))).alias("decline_rate_30d"),
        zero(F.avg(F.when(month, F.col("is_international").cast("double")))).alias("international_txn_rate_30d"),
    ]


def _diversity_aggregates(txns: DataFrame, reference_date) -> list[Column]:
    """Sets rather than distinct counts: few values each, and the rows are not copied once per count."""
    month = F.col("timestamp") >= cutoff(txns, "timestamp", reference_date, 30)

    def kinds(name: str) -> Column:
        return F.size(F.collect_set(F.when(month, F.col(name)))).cast("long")

    return [
        kinds("merchant_category").alias("merchant_diversity_30d"),
        kinds("channel").alias("channel_diversity"),
    ]


def velocity_features(
    txns: DataFrame, reference_date=DEFAULT_REFERENCE_DATE, key: str = "borrower_id"
) -> DataFrame:
    """Counts, sums and rates over the last 7, 30 and 90 days, for borrowers active in the last 90.

    The widest window is a scan filter (it pushes down to parquet); the narrower ones are
    conditional aggregates of the same single pass.
    """
    recent = txns.filter(F.col("timestamp") >= cutoff(txns, "timestamp", reference_date, max(VELOCITY_DAYS)))
    return recent.groupBy(key).agg(*_velocity_aggregates(txns, reference_date))


def behavior_features(txns: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Share of mobile, weekend and night-time (22:00-05:59) transactions."""
    return txns.groupBy(key).agg(
        F.avg(_mobile().cast("double")).alias("mobile_txn_fraction"),
        F.avg(_weekend().cast("double")).alias("weekend_txn_fraction"),
        F.avg(_night().cast("double")).alias("nighttime_txn_fraction"),
    )


def _slope(position: str, measure: str, last: int) -> Column:
    """Least-squares slope over the ``last`` latest positions (1 = latest), 0 below two points."""
    within = F.col(position) <= last
    return F.coalesce(
        F.regr_slope(F.when(within, F.col(measure)), F.when(within, -F.col(position))), F.lit(0.0)
    )


def _history_rollup(txns: DataFrame, key: str) -> DataFrame:
    """One row per borrower, month and category, laid out by borrower.

    Combining happens map-side; afterwards even the busiest borrower has no more rows than
    months times categories, so the later per-borrower steps need no further shuffle.
    """
    return (
        txns.withColumn("month", month_start(F.col("timestamp")))
        .groupBy(key, "month", "merchant_category")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(_amount()).alias("amounts"),
            total(_amount()).alias("spend"),
            F.sum(_mobile()).alias("mobile"),
            F.sum(_weekend()).alias("weekend"),
            F.sum(_night()).alias("night"),
        )
        .repartition(key)
    )


def _history_features(txns: DataFrame, key: str) -> DataFrame:
    """Spend by category, entropy, trends and behaviour from one scan of the history.

    Each rollup row counts once towards its month and once towards its category; ``view``
    tells the two apart, so one hash aggregate and one window serve both.
    """
    views = _history_rollup(txns, key).withColumn(
        "view", F.explode(F.array(F.lit("month"), F.lit("category")))
    )
    by_month = F.col("view") == "month"
    parts = (
        views.groupBy(
            key,
            "view",
            F.when(by_month, F.col("month")).alias("part_month"),
            F.when(~by_month, F.col("merchant_category")).alias("part_category"),
        )
        .agg(
            *[F.sum(c).alias(c) for c in ("rows", "amounts", "mobile", "weekend", "night")],
            F.sum("spend").alias("spend"),
            F.count("month").alias("months"),
        )
    )
    is_month = (F.col("view") == "month") & F.col("part_month").isNotNull()
    is_category = (F.col("view") == "category") & F.col("part_category").isNotNull()
    latest_first = Window.partitionBy(key, "view").orderBy(F.col("part_month").desc_nulls_last())
    placed = parts.select(
        "*",
        F.row_number().over(latest_first).alias("_place"),
        F.sum(F.when(is_category, F.col("spend"))).over(Window.partitionBy(key)).alias("_spend_all"),
    ).select(
        "*",
        F.when(is_month, F.col("_place")).alias("place"),
        F.when(is_month, F.col("spend")).alias("month_spend"),
        F.when(is_month, F.col("amounts").cast("double")).alias("month_count"),
        F.when(is_category, F.col("spend") / F.greatest(F.col("_spend_all"), F.lit(TINY))).alias("share"),
    )
    counted = F.when(F.col("view") == "month", F.col("rows"))

    def fraction(name: str) -> Column:
        return rate_or_zero(F.sum(F.when(F.col("view") == "month", F.col(name))), F.sum(counted))

    def monthly_mean(category: str) -> Column:
        mine = is_category & (F.col("part_category") == category)
        return rate_or_zero(F.sum(F.when(mine, F.col("spend"))), F.sum(F.when(mine, F.col("months"))))

    entropy = total(F.when(F.col("share") > 0, -F.col("share") * F.log2("share")))
    volatility = F.stddev_samp("month_spend") / (F.avg("month_spend") + F.lit(TINY))
    return placed.groupBy(key).agg(
        *[monthly_mean(c).alias(f"avg_spend_{c}") for c in SPEND_CATEGORIES],
        entropy.alias("spend_category_entropy"),
        fraction("mobile").alias("mobile_txn_fraction"),
        fraction("weekend").alias("weekend_txn_fraction"),
        fraction("night").alias("nighttime_txn_fraction"),
        _slope("place", "month_spend", 3).alias("spend_trend_3m"),
        _slope("place", "month_spend", 6).alias("spend_trend_6m"),
        _slope("place", "month_count", 6).alias("txn_frequency_trend"),
        F.coalesce(volatility, F.lit(0.0)).alias("spend_volatility_6m"),
        F.count(F.when(is_category, 1)).alias("_categories"),
        F.count(F.when(is_month, 1)).alias("_months"),
    )


def spend_features(
    txns: DataFrame, reference_date=DEFAULT_REFERENCE_DATE, key: str = "borrower_id"
) -> DataFrame:
    """Average monthly spend in four categories, 30-day diversity and spend entropy."""
    history = (
        _history_features(txns, key)
        .filter(F.col("_categories") > 0)
        .select(key, *[c for c in SPEND_FEATURES if c.startswith(("avg_spend", "spend_category"))])
    )
    recent = txns.filter(F.col("timestamp") >= cutoff(txns, "timestamp", reference_date, 30))
    diversity = recent.groupBy(key).agg(*_diversity_aggregates(txns, reference_date))
    joined = history.join(diversity, key, "full")
    return joined.select(key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in SPEND_FEATURES])


def monthly_rollup(txns: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Spend and transaction count per borrower and observed month, with a 0-based month index."""
    by_month = (
        txns.withColumn("month", month_start(F.col("timestamp")))
        .filter(F.col("month").isNotNull())
        .groupBy(key, "month")
        .agg(total(_amount()).alias("total_spend"), F.count(_amount()).alias("txn_count"))
    )
    order = Window.partitionBy(key).orderBy("month")
    return by_month.withColumn("month_idx", F.row_number().over(order) - 1)


def trend_features(txns: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Slopes over the last 3 and 6 observed months and the volatility of monthly spend."""
    latest_first = Window.partitionBy(key).orderBy(F.col("month").desc())
    placed = monthly_rollup(txns, key).withColumn("place", F.row_number().over(latest_first))
    volatility = F.stddev_samp("total_spend") / (F.avg("total_spend") + F.lit(TINY))
    return placed.groupBy(key).agg(
        _slope("place", "total_spend", 3).alias("spend_trend_3m"),
        _slope("place", "total_spend", 6).alias("spend_trend_6m"),
        _slope("place", "txn_count", 6).alias("txn_frequency_trend"),
        F.coalesce(volatility, F.lit(0.0)).alias("spend_volatility_6m"),
    )


def transaction_features(
    txns: DataFrame, reference_date=DEFAULT_REFERENCE_DATE, key: str = "borrower_id"
) -> DataFrame:
    """All transaction families from two scans: the whole history once, the last 90 days once.

    Columns of a family are null for a borrower who has no part in it, which later imputation
    tells apart from a zero.
    """
    history = _history_features(txns, key)
    recent = (
        txns.filter(F.col("timestamp") >= cutoff(txns, "timestamp", reference_date, max(VELOCITY_DAYS)))
        .groupBy(key)
        .agg(
            *_velocity_aggregates(txns, reference_date),
            *_diversity_aggregates(txns, reference_date),
            F.count(F.when(F.col("timestamp") >= cutoff(txns, "timestamp", reference_date, 30), 1)).alias("_rows_30d"),
        )
    )
    in_spend = (F.col("_categories") > 0) | (F.coalesce(F.col("_rows_30d"), F.lit(0)) > 0)
    in_trend = F.col("_months") > 0
    joined = history.join(recent, key, "left")
    return joined.select(
        key,
        *VELOCITY_FEATURES,
        *[F.when(in_spend, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in SPEND_FEATURES],
        *BEHAVIOR_FEATURES,
        *[F.when(in_trend, F.col(c)).alias(c) for c in TREND_FEATURES],
    )
