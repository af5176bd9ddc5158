"""Payment discipline features.

Rows are combined by (borrower, due date, on time or not, days late) before they are laid out
by borrower, so a borrower with very many payments arrives as a short calendar.

Payments due at the same time have no order of their own. They are taken as: on time first,
then by days late, so of several payments on the latest date the worst one counts as the most
recent. That makes the streak and the trend a function of the values alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import known, ratio_floor, total

PAYMENT_FEATURES = [
    "on_time_payment_rate",
    "avg_days_past_due",
    "max_days_past_due",
    "missed_payment_count",
    "payment_amount_ratio",
    "consecutive_on_time",
    "payment_trend_3m",
]
TREND_PAYMENTS = 3


def _calendar(payments: DataFrame, key: str) -> DataFrame:
    on_time = F.coalesce(F.col("payment_status") == "on_time", F.lit(False))
    missed = F.coalesce(F.col("payment_status") == "missed", F.lit(False))
    paid_ratio = ratio_floor(known(F.col("amount_paid")), known(F.col("amount_due")))
    return (
        payments.select(
            key,
            "due_date",
            (~on_time).alias("broken"),
            F.col("days_past_due").cast("double").alias("late_days"),
            missed.cast("long").alias("missed"),
            paid_ratio.alias("paid_ratio"),
        )
        .groupBy(key, "due_date", "broken", "late_days")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("missed").alias("missed"),
            F.sum("paid_ratio").alias("paid_ratio"),
            F.count("paid_ratio").alias("paid_ratios"),
        )
    )


def _recent_slope() -> Column:
    """Slope of days late over the last payments, from those that stand newest in each month.

    Recency counts backwards from the newest payment, hence the sign.
    """
    sums = []
    for place in range(TREND_PAYMENTS):
        x = F.col("_rows_later") + place
        counts = (F.col("rows") > place) & (x < TREND_PAYMENTS)
        sums.append([F.when(counts, value.cast("double")).otherwise(0.0) for value in (
            F.lit(1), x, x * x, F.col(f"late_{place}"), x * F.col(f"late_{place}"))])
    n, sx, sxx, sy, sxy = (F.sum(sum(of[1:], of[0])) for of in zip(*sums, strict=True))
    spread = n * sxx - sx * sx
    return F.when(n >= 2, -(n * sxy - sx * sy) / F.nullif(spread, F.lit(0.0))).otherwise(F.lit(0.0))


def payment_features(payments: DataFrame, key: str = "borrower_id") -> DataFrame:
    """Features of a borrower's payments, newest first.

    Payments are ordered within a borrower's month and added up by month, then months within a borrower, so the rows
    of a borrower with very many payments are spread over as many tasks as there are months. Payments are read once.
    A null due date counts as the newest and makes a month of its own. Rows without a key are left out.
    """
    newest_first = Window.partitionBy(key, "month").orderBy(
        F.col("due_date").desc_nulls_first(),
        F.col("broken").desc(),
        F.col("late_days").desc_nulls_first(),
    )
    up_to_here = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(key).orderBy(F.col("month").desc()).rowsBetween(Window.unboundedPreceding, -1)
    month = F.coalesce(F.trunc("due_date", "month"), F.lit("9999-12-31").cast("date"))
    placed = _calendar(payments.filter(F.col(key).isNotNull()), key).withColumn("month", month).select(
        "*",
        F.sum("rows").over(up_to_here).alias("_rows_here"),
        F.max("broken").over(up_to_here).alias("_broken_here"),
    )
    late, zero = F.col("late_days"), F.lit(0.0)

    def late_at(place: int) -> Column:
        """Days late of the payment that stands so many places from the month's newest."""
        there = (F.col("_rows_here") > place) & (F.col("_rows_here") - F.col("rows") <= place)
        return F.max(F.when(there, F.coalesce(late, zero))).alias(f"late_{place}")

    months = placed.groupBy(key, "month").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(~F.col("broken"), F.col("rows")).otherwise(0)).alias("on_time"),
        F.sum(late * F.col("rows")).alias("late"),
        F.sum(F.when(late.isNotNull(), F.col("rows"))).alias("late_rows"),
        F.max("late_days").alias("late_most"),
        F.sum("missed").alias("missed"),
        F.sum("paid_ratio").alias("paid_ratio"),
        F.sum("paid_ratios").alias("paid_ratios"),
        F.max("broken").alias("broken"),
        F.sum(F.when(~F.col("_broken_here"), F.col("rows")).otherwise(0)).alias("streak"),
        *[late_at(place) for place in range(TREND_PAYMENTS)],
    ).select(
        "*",
        F.coalesce(F.sum("rows").over(later), F.lit(0)).alias("_rows_later"),
        F.coalesce(F.max("broken").over(later), F.lit(False)).alias("_broken_later"),
    )
    return months.groupBy(key).agg(
        (F.sum("on_time") / F.sum("rows")).alias("on_time_payment_rate"),
        F.coalesce(F.try_divide(F.sum("late"), F.sum("late_rows")), zero).alias("avg_days_past_due"),
        F.coalesce(F.max("late_most"), zero).alias("max_days_past_due"),
        F.sum("missed").alias("missed_payment_count"),
        F.coalesce(F.try_divide(total(F.col("paid_ratio")), F.sum("paid_ratios")), zero).alias("payment_amount_ratio"),
        F.sum(F.when(~F.col("_broken_later"), F.col("streak")).otherwise(0)).alias("consecutive_on_time"),
        F.coalesce(_recent_slope(), zero).alias("payment_trend_3m"),
    )
