"""Stratified splits, samples and class weights, repeatable from the keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, rank_within
from ..functions.hashing import hash_bucket, key_hash

TEST_SHARE = 0.20
VALIDATION_SHARE = 0.15
MAX_POSITIVE_WEIGHT = 50.0


def _ranked(df: DataFrame, by: list[str], key: str, seed, limit: int | None = None) -> DataFrame:
    hashed = df.withColumn("_hash", key_hash(F.col(key), seed))
    order = [F.col("_hash"), F.col(key)]
    return rank_within(hashed, by, hash_bucket(F.col("_hash")), order, limit).drop("_hash")


def stratified_split(
    df: DataFrame,
    label: str,
    key: str = "borrower_id",
    seed: int = 42,
    test_share: float = TEST_SHARE,
    validation_share: float = VALIDATION_SHARE,
) -> DataFrame:
    """Add ``split``: exact shares of every label value, in the order of a hash of the key."""
    size = F.col("group_size")
    test = F.floor(size * F.lit(test_share) + F.lit(0.5))
    validation = F.floor(size * F.lit(validation_share) + F.lit(0.5))
    part = (
        F.when(F.col("rank") <= test, "test")
        .when(F.col("rank") <= test + validation, "validation")
        .otherwise("train")
    )
    return _ranked(df, [label], key, seed).withColumn("split", part).drop("rank", "group_size")


def fold_column(df: DataFrame, label: str, folds: int = 3, key: str = "borrower_id", seed: int = 42) -> DataFrame:
    """Add ``fold`` (0-based): every fold holds the same share of each label value."""
    return (
        _ranked(df, [label], key, seed)
        .withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int"))
        .drop("rank", "group_size")
    )


def split_summary(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("default_rate")
    )


def sample_rows(df: DataFrame, n: int, key: str = "borrower_id", seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those with the smallest key hashes.

    Only rows of the hash buckets that can hold them are ranked.
    """
    return _ranked(df, [], key, seed, limit=n).drop("rank", "group_size")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per label value, n / (2 n_c), and the capped positive weight."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    neg, pos = F.col("neg"), F.col("pos")

    def entry(value: int, rows, capped):
        return F.struct(
            F.lit(value).alias(label),
            rows.alias("rows"),
            F.try_divide((neg + pos).cast("double"), 2 * rows).alias("balanced_weight"),
            capped.alias("capped_weight"),
        )

    capped = clip(neg / (pos + 1), None, MAX_POSITIVE_WEIGHT)
    return counts.select(F.inline(F.array(entry(0, neg, F.lit(1.0)), entry(1, pos, capped)))).filter("rows > 0")


def with_class_weight(
    df: DataFrame, label: str, kind: str = "balanced_weight", name: str = "weight"
) -> DataFrame:
    """Rows of the two classes with their weight, two numbers learned beforehand: no join, no shuffle."""
    weights = {r[label]: r[kind] for r in class_weights(df, label).collect()}
    known = F.when(F.col(label) == 1, F.lit(weights.get(1))).otherwise(F.lit(weights.get(0)))
    return df.filter(F.col(label).isin(0, 1)).withColumn(name, known.cast("double"))
