"""Weighted average of model probabilities and the search for its weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evaluate import rank_metrics
from ..session import spread

GRID_STEPS = 10
BUCKETS = 4096
ODDS = 14.0  # log odds of the outermost buckets
ROUNDING = 1e-9
CHUNK = 1 << 18  # rows counted at once


def normalised(weights: dict[str, float]) -> dict[str, float]:
    whole = sum(weights.values())
    if whole <= 0:
        raise ValueError("ensemble weights must have a positive sum")
    return {m: w / whole for m, w in weights.items()}


def combine(weights: dict[str, float]) -> Column:
    """The weighted average of the named probability columns."""
    parts = [F.lit(float(w)) * F.col(m) for m, w in normalised(weights).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def weight_grid(models: list[str], steps: int = GRID_STEPS) -> list[dict[str, float]]:
    """All weight vectors with entries k/steps that sum to one."""
    heads = product(range(steps + 1), repeat=len(models) - 1)
    whole = [(*h, steps - sum(h)) for h in heads if sum(h) <= steps]
    return [{m: k / steps for m, k in zip(models, ks, strict=True)} for ks in whole]


def _around(best: dict[str, float], span: float, steps: int) -> list[dict[str, float]]:
    """Vectors near ``best``: each pair of models trades up to ``span`` of weight."""
    models = list(best)
    near = [best]
    for giver in models:
        for taker in models:
            for k in range(1, steps + 1):
                amount = min(span * k / steps, best[giver])
                if giver != taker and amount > 0:
                    near.append({**best, giver: best[giver] - amount, taker: best[taker] + amount})
    return near


def _counts(df: DataFrame, candidates: list[dict[str, float]], label: str, value: str, place: Callable) -> DataFrame:
    """``(candidate, <value>, pos, rows)``: counts per value that ``place`` gives a candidate's probabilities.

    Rows are taken some hundred thousands at a time, a candidate after the other, so that what is counted stays small; a
    value comes once per candidate and such a chunk. Rows that lack a probability are left out.
    """
    models = list(candidates[0])
    weights = [[normalised(w)[m] for m in models] for w in candidates]
    given = df.select((F.col(label) == 1).alias("y"), *[F.col(m).cast("double").alias(m) for m in models])
    kind = "int" if value == "bucket" else "double"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for positive, columns in _chunks(batches, len(models)):
            for candidate, shares in enumerate(weights):
                prob = shares[0] * columns[0]
                for share, column in zip(shares[1:], columns[1:], strict=True):
                    prob = prob + share * column
                found, at, rows = np.unique(place(prob), return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), candidate), pa.int32()), pa.array(found, pa.int32() if kind == "int" else pa.float64()),
                     pa.array(np.bincount(at, positive, len(found)).astype(np.int64)), pa.array(rows)],
                    ["candidate", value, "pos", "rows"])

    # A small file is one task's; each of its rows counts once per candidate.
    return spread(given).mapInArrow(count, f"candidate int, {value} {kind}, pos long, rows long")


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Marks of positive rows and the probabilities of each model, of rows that have all of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield from _whole_rows(held, width)
            held, size = [], 0
    if size:
        yield from _whole_rows(held, width)


def _whole_rows(held: list[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    table = pa.Table.from_batches(held)
    there = np.ones(table.num_rows, bool)
    for at in range(width):
        there &= table.column(1 + at).is_valid().to_numpy()
    if there.any():
        positive = table.column(0).fill_null(False).to_numpy()
        yield positive[there], [table.column(1 + at).to_numpy()[there] for at in range(width)]


def weight_metrics(df: DataFrame, candidates: list[dict[str, float]], label: str = "label") -> DataFrame:
    """AUC of every candidate in one job: (candidate, auc_roc).

    A row counts once per candidate, a number fixed by the grid; equal probabilities are combined before they are shuffled.
    """
    counted = _counts(df, candidates, label, "prob", lambda prob: prob + 0.0)  # no negative zero beside zero
    return rank_metrics(counted, ["candidate"], None, groups=len(candidates)).select("candidate", "auc_roc")


def _bucket_edges(buckets: int) -> np.ndarray:
    """Lower edges of all buckets but the first: even steps of the log odds, where models differ."""
    return 1 / (1 + np.exp(-(np.arange(1, buckets) * (2 * ODDS / buckets) - ODDS)))


def auc_bounds(df: DataFrame, candidates: list[dict[str, float]], label: str = "label") -> DataFrame:
    """(candidate, lower, upper): bounds of the AUC of every candidate, from counts per bucket.

    Pairs of a positive and a negative row in different buckets are decided, the others may fall either way.
    Shuffled are at most ``BUCKETS`` counts and one for NaN per candidate and task, however many rows there are.
    """
    edges, beyond = _bucket_edges(BUCKETS), BUCKETS

    def bucket(prob: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(prob), beyond, np.searchsorted(edges, prob, "right"))

    counted = (
        _counts(df, candidates, label, "bucket", bucket)
        .groupBy("candidate", "bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("rows").alias("rows"))
        .withColumn("neg", F.col("rows") - F.col("pos"))
    )
    above = Window.partitionBy("candidate").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("over", F.coalesce(F.sum("pos").over(above), F.lit(0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    won, open_ = F.sum(F.col("neg").cast("double") * F.col("over")), F.sum(F.col("neg").cast("double") * F.col("pos"))
    return placed.groupBy("candidate").agg(
        F.try_divide(won, pairs).alias("lower"), F.try_divide(won + open_, pairs).alias("upper"))


def promising(df: DataFrame, candidates: list[dict[str, float]], label: str = "label") -> list[int]:
    """Numbers of the candidates that can be the best: their upper bound reaches the best lower one."""
    bounds = {r["candidate"]: r for r in auc_bounds(df, candidates, label).collect() if r["lower"] is not None}
    best = max((r["lower"] for r in bounds.values()), default=0.0)
    return sorted(i for i, r in bounds.items() if r["upper"] >= best - ROUNDING)


def _best(df: DataFrame, candidates: list[dict[str, float]], label: str) -> dict[str, float]:
    """The candidate with the best AUC, the first of equals; only those that bounds leave open are ranked exactly."""
    left = promising(df, candidates, label)
    if not left:
        return normalised({m: 1.0 for m in candidates[0]})
    if len(left) == 1:
        return candidates[left[0]]
    rows = weight_metrics(df, [candidates[i] for i in left], label).collect()
    scored = {left[r["candidate"]]: r["auc_roc"] for r in rows if r["auc_roc"] is not None}
    return candidates[max(scored, key=lambda i: (scored[i], -i))]


def search_weights(
    df: DataFrame, models: list[str], label: str = "label", steps: int = GRID_STEPS, refine: int = 4
) -> dict[str, float]:
    """Weights with the best validation AUC: a simplex grid, then finer steps around its best."""
    best = _best(df, weight_grid(models, steps), label)
    if refine and len(models) > 1:
        best = _best(df, _around(best, 1.0 / steps, refine), label)
    return normalised(best)


def weights_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "model string, weight double")


def save_weights(spark: SparkSession, weights: dict[str, float], path: str) -> None:
    weights_table(spark, weights).coalesce(1).write.mode("overwrite").json(path)


def load_weights(spark: SparkSession, path: str, available: list[str] | None = None) -> dict[str, float]:
    """Saved weights of the models at hand, rescaled to sum to one."""
    rows = spark.read.schema("model string, weight double").json(path).collect()
    kept = {r["model"]: r["weight"] for r in rows if available is None or r["model"] in available}
    return normalised(kept)
