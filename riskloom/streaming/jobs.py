"""Continuous versions of the batch operators, as Structured Streaming plans.

State is bounded by a watermark everywhere. Scoring is stateless; it uses the batch functions
as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cutoff, known, total
from ..operators import drift, quality, shadow
from ..operators.monitor import LATENCY_BUCKETS
from ..operators.transactions import VELOCITY_DAYS


def read_applications(json_lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parse application messages; a message that is no JSON yields nulls and is quarantined later."""
    return json_lines.select(F.from_json(column, schema).alias("a")).select("a.*")


def valid_applications(applications: DataFrame) -> DataFrame:
    valid, _ = quality.split_valid(applications, quality.application_rules())
    return valid


def scored_stream(applications: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Quarantine, then score: ``score`` is the batch function (features, models, decision)."""
    return score(valid_applications(applications))


def shadow_stream(applications: DataFrame, champion_pd: str, challenger_pd: str, **options) -> DataFrame:
    return shadow.shadow_log(applications, champion_pd, challenger_pd, **options)


def shadow_pairs(
    champion: DataFrame,
    challenger: DataFrame,
    key: str = "application_id",
    at: str = "scored_at",
    within: str = "10 minutes",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Scores of two services that answer on streams of their own, joined by key and time.

    A challenger's answer counts if it comes at most ``within`` after the champion's; the first one does. Champion
    rows without one come out with null challenger columns once the watermark has passed their time. State holds
    rows for ``within`` and ``lateness`` only. Apart from key and time the two sides must not share column names.
    """
    first = _watermarked(champion, at, lateness).dropDuplicatesWithinWatermark([key])
    second = _watermarked(challenger.withColumnsRenamed({key: "_key", at: "answered_at"}), "answered_at", lateness)
    second = second.dropDuplicatesWithinWatermark(["_key"])
    same = F.col(key) == F.col("_key")
    soon = F.col("answered_at").between(F.col(at), F.col(at) + F.expr(f"INTERVAL {within}"))
    return first.join(second, same & soon, "left_outer").drop("_key")


def shadow_misses(pairs: DataFrame, challenger_pd: str, key: str = "application_id") -> DataFrame:
    """Pairs without a usable challenger and why: ``no answer`` in time, or ``failed``."""
    usable = F.col(challenger_pd).isNotNull() & ~F.isnan(challenger_pd)
    reason = F.when(F.col("answered_at").isNull(), "no answer").otherwise("failed")
    return pairs.where(~usable).select(key, reason.alias("reason"))


def _watermarked(df: DataFrame, timestamp: str, lateness: str) -> DataFrame:
    """Watermarks need an instant, so a zoneless timestamp is read in the session's zone (UTC)."""
    return df.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, lateness)


def request_windows(
    requests: DataFrame, timestamp: str = "requested_at", length: str = "1 minute", lateness: str = "10 minutes"
) -> DataFrame:
    """Requests, errors and cumulative latency buckets per endpoint, status and tumbling window."""
    names = {b: f"le_{b * 1000:g}ms" for b in LATENCY_BUCKETS}
    buckets = [F.count_if(F.col("latency_seconds") <= b).alias(n) for b, n in names.items()]
    return (
        _watermarked(requests, timestamp, lateness)
        .groupBy(F.window(timestamp, length).alias("w"), "endpoint", "status")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("latency_seconds").alias("latency_sum"), *buckets)
        .select(F.col("w.start").alias("window_start"), "endpoint", "status", "requests", "latency_sum",
                *names.values())
    )


def over_limit(
    requests: DataFrame,
    limit: int,
    client: str = "client_id",
    timestamp: str = "requested_at",
    length: str = "1 minute",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Clients with more requests in a window than allowed."""
    return (
        _watermarked(requests, timestamp, lateness)
        .groupBy(F.window(timestamp, length).alias("w"), client)
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > limit)
        .select(F.col("w.start").alias("window_start"), client, "requests")
    )


def daily_activity(txns: DataFrame, key: str = "borrower_id", lateness: str = "2 days") -> DataFrame:
    """Count and sum per borrower and day.

    A 90-day window sliding by a day would keep 90 open windows per borrower in state. Daily
    parts keep only the days the watermark allows; ``velocity_as_of`` adds them up on read.
    """
    return (
        _watermarked(txns, "timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("w"), key)
        .agg(F.count(known(F.col("amount"))).alias("amounts"), total(known(F.col("amount"))).alias("spend"))
        .select(F.col("w.start").alias("day"), key, "amounts", "spend")
    )


def velocity_as_of(days: DataFrame, reference_date, key: str = "borrower_id") -> DataFrame:
    """7/30/90-day counts and sums from daily parts; exact where the reference is a midnight."""
    recent = days.filter(F.col("day") >= cutoff(days, "day", reference_date, max(VELOCITY_DAYS)))
    aggregates = []
    for d in VELOCITY_DAYS:
        inside = F.col("day") >= cutoff(days, "day", reference_date, d)
        aggregates.append(F.coalesce(F.sum(F.when(inside, F.col("amounts"))), F.lit(0)).alias(f"txn_count_{d}d"))
        aggregates.append(total(F.when(inside, F.col("spend"))).alias(f"txn_amount_sum_{d}d"))
    return recent.groupBy(key).agg(*aggregates)


def sliding_velocity(
    txns: DataFrame, days: int = 7, key: str = "borrower_id", lateness: str = "1 day"
) -> DataFrame:
    """Counts and sums in a window of ``days`` that slides by one day, for short windows."""
    return (
        _watermarked(txns, "timestamp", lateness)
        .groupBy(F.window("timestamp", f"{days} days", "1 day").alias("w"), key)
        .agg(F.count(known(F.col("amount"))).alias("txn_count"), total(known(F.col("amount"))).alias("txn_amount_sum"))
        .select(F.col("w.start").alias("window_start"), key, "txn_count", "txn_amount_sum")
    )


def drift_counts(
    reference: DataFrame, columns: list[str], timestamp: str, bins: int = drift.BINS
) -> Callable[[DataFrame], DataFrame]:
    """A micro-batch function: bin counts per day against a fixed reference.

    Only counts leave the batch, and counts of several batches add up.
    """
    ranges = drift.reference_ranges(reference)

    def count(batch: DataFrame) -> DataFrame:
        dated = batch.withColumn("day", F.col(timestamp).cast("date"))
        return drift.bin_counts(dated, columns, ranges, bins, ["day"])

    return count


def drift_by_day(counts: DataFrame, reference: DataFrame, bins: int = drift.BINS) -> DataFrame:
    """PSI and status per day and feature from the counts gathered so far."""
    added = counts.groupBy("day", "feature", "bin").agg(F.sum("rows").alias("rows"))
    shares = drift.bin_shares(added, bins, ["day"])
    return drift.feature_drift(drift.stability_index(shares, reference, ["day"]))


def first_seen(events: DataFrame, key: str, timestamp: str, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of an id that arrive within the watermark."""
    return _watermarked(events, timestamp, lateness).dropDuplicatesWithinWatermark([key])
