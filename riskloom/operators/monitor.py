"""Performance over time and service metrics from a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rate_or_zero
from .evaluate import evaluate_pd

# Upper bounds of the latency buckets in seconds.
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def performance_history(df: DataFrame, batch: str, label: str = "label", prob: str = "prob") -> DataFrame:
    """Metrics per scored batch; the time series of the model."""
    return evaluate_pd(df, [batch], label, prob)


def degradation(history: DataFrame, batch: str, metric: str = "auc_roc", threshold: float = 0.05) -> DataFrame:
    """Whether the metric fell by more than ``threshold`` from the first to the last batch."""
    ends = history.agg(
        F.count(F.lit(1)).alias("batches"),
        F.min_by(metric, batch).alias("first_value"),
        F.max_by(metric, batch).alias("last_value"),
    )
    fell = (F.col("batches") >= 2) & (F.col("first_value") - F.col("last_value") > threshold)
    return ends.withColumn("degraded", F.coalesce(fell, F.lit(False)))


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(requests: DataFrame, latency: str = "latency_seconds") -> DataFrame:
    """Cumulative bucket counts per endpoint with the overall sum and count."""
    bounds = [f"`{b}`" for b in LATENCY_BUCKETS]
    wide = requests.groupBy("endpoint").agg(
        *[F.count_if(F.col(latency) <= b).alias(str(b)) for b in LATENCY_BUCKETS],
        F.count(latency).alias("+Inf"),
        F.sum(latency).alias("latency_sum"),
        F.count(latency).alias("latency_count"),
    )
    return wide.unpivot(["endpoint", "latency_sum", "latency_count"], [*bounds, "+Inf"], "le", "requests")


def latest_gauge(history: DataFrame, names: list[str], value: str, timestamp: str) -> DataFrame:
    """The last recorded value per name (model, feature, metric and group)."""
    return history.groupBy(*names).agg(F.max_by(value, timestamp).alias(value))


def service_metrics(requests: DataFrame, latency: str = "latency_seconds", ok: str = "200") -> DataFrame:
    """Total requests, mean latency in ms (2 decimals) and error share (4 decimals); 0 without requests."""
    found = requests.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(F.col(latency) * 1000).alias("total_ms"),
        F.count_if(F.col("status") != ok).alias("errors"),
    )
    return found.select(
        "total_requests",
        F.round(rate_or_zero(F.col("total_ms"), F.col("total_requests")), 2).alias("avg_latency_ms"),
        F.round(rate_or_zero(F.col("errors"), F.col("total_requests")), 4).alias("error_rate"),
    )
