"""Model performance over any union of scored batches, from counts instead of rows.

A batch leaves one row per distinct score: how many applications had it and how many of them defaulted. These
counts add up, so AUC, KS, losses and the best threshold of any set of batches are exact and need neither
the raw rows nor a second look at batches measured before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import value_steps
from .evaluate import metrics_of_steps

SCHEMA = "prob double, pos long, rows long, batch string"


def score_counts(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """(prob, pos, rows) per distinct score. Rows without a score are left out; a null label is no default."""
    scored = df.where(F.col(prob).isNotNull())
    return scored.groupBy(F.col(prob).cast("double").alias("prob")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("rows")
    )


def add_batch(df: DataFrame, path: str, batch: str, label: str = "label", prob: str = "prob") -> None:
    """Keep the counts of one batch; a batch that is added again replaces its own."""
    if not batch or "/" in batch:
        raise ValueError(f"a batch needs a name without slashes: {batch!r}")
    counts = score_counts(df, label, prob).withColumn("batch", F.lit(batch))
    out = counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("batch").parquet(path)


def read_counts(spark: SparkSession, path: str, batches: list[str] | None = None) -> DataFrame:
    """Counts of the named batches, of which only their folders are opened; of all batches by default."""
    counts = spark.read.schema(SCHEMA).parquet(path)
    return counts if batches is None else counts.where(F.col("batch").isin(batches))


def united_metrics(spark: SparkSession, path: str, unions: dict[str, list[str]]) -> DataFrame:
    """One row per entry of ``unions``, its name in ``union``: all metrics over its batches taken together.

    A batch may belong to several unions. Unknown batches count as empty; a union without any row has no result.
    """
    if not unions:
        raise ValueError("no union is named")
    wanted = sorted({b for parts in unions.values() for b in parts})
    belongs = [F.when(F.col("batch").isin(parts), F.lit(name)) for name, parts in unions.items()]
    placed = read_counts(spark, path, wanted).select(
        F.explode(F.array_compact(F.array(*belongs))).alias("union"), "prob", "pos", "rows"
    )
    counts = {"pos": F.col("pos"), "rows": F.col("rows")}
    steps = value_steps(placed, ["union"], "prob", counts, groups=len(unions))
    return metrics_of_steps(steps, ["union"])
