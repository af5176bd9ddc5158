"""Append-only result tables, partitioned by day so that later reads prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORING_COLUMNS = [
    "application_id",
    "borrower_id",
    "credit_score",
    "pd_value",
    "lgd_value",
    "ead_value",
    "expected_loss",
    "fraud_score",
    "decision",
    "model_version",
    "scored_at",
]
DRIFT_COLUMNS = ["feature_name", "psi_value", "status", "recorded_at"]
FAIRNESS_COLUMNS = ["metric_name", "group_name", "value", "recorded_at"]


def _append(df: DataFrame, path: str, moment: str) -> None:
    df.withColumn("day", F.col(moment).cast("date")).write.mode("append").partitionBy("day").parquet(path)


def scoring_rows(scored: DataFrame, model_version: str, scored_at) -> DataFrame:
    """Scored applications in the layout of the result table."""
    renamed = scored.select(
        "*",
        F.col("pd").alias("pd_value"),
        F.col("lgd").alias("lgd_value"),
        F.col("ead").alias("ead_value"),
        F.lit(model_version).alias("model_version"),
        F.lit(str(scored_at)).cast("timestamp").alias("scored_at"),
    )
    if missing := [c for c in SCORING_COLUMNS if c not in renamed.columns]:
        raise ValueError(f"scores lack the columns {missing}")
    return renamed.select(*SCORING_COLUMNS)


def append_scores(scored: DataFrame, path: str, model_version: str, scored_at) -> None:
    _append(scoring_rows(scored, model_version, scored_at), path, "scored_at")


def append_drift(drift: DataFrame, path: str, recorded_at) -> None:
    rows = drift.select(
        F.col("feature").alias("feature_name"),
        F.col("psi").alias("psi_value"),
        "status",
        F.lit(str(recorded_at)).cast("timestamp").alias("recorded_at"),
    )
    _append(rows, path, "recorded_at")


def append_fairness(rates: DataFrame, group: str, path: str, recorded_at) -> None:
    """Group rates as (metric, group, value) rows."""
    metrics = ["approval_rate", "tpr", "fpr"]
    named = rates.select(F.col(group).cast("string").alias("group_name"), *metrics)
    rows = named.unpivot(["group_name"], metrics, "metric_name", "value").withColumn(
        "recorded_at", F.lit(str(recorded_at)).cast("timestamp")
    )
    _append(rows.select(*FAIRNESS_COLUMNS), path, "recorded_at")


def read_results(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Appended rows, from a day on when given: older partitions are not opened."""
    df = spark.read.parquet(path)
    return df if since is None else df.filter(F.col("day") >= F.lit(str(since)).cast("date"))
