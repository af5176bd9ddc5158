"""Exact contributions of boosted trees, from a table of their leaves and the ways that lead to them.

A leaf is reached if each feature on its way lies in the leaf's interval of that feature. For a row and a
background row, the leaf's part in the Shapley values has a closed form: with a features that only the row
has inside, c that only the background row has, and no feature that both have outside, each of the a gets
``value (a-1)! c! / (a+c)!`` and each of the c ``-value a! (c-1)! / (a+c)!``. Sums over leaves and means over
background rows are the exact values: no coalition is drawn, no prediction asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_folder, spread
from .shapley import BACKGROUND_ROWS

LEAVES = "tree int, leaf int, value double, features array<int>, lows array<double>, highs array<double>"
CELLS = 1 << 19  # leaf visits held in memory at once
PARTS = 1 << 21  # leaves times ways to meet their conditions, up to which their contributions are kept


def _ensemble(model: PipelineModel) -> GBTClassificationModel | GBTRegressionModel:
    trees = model.stages[-1]
    if not isinstance(trees, GBTClassificationModel | GBTRegressionModel):
        raise ValueError(f"a boosted model of trees is needed, not {type(trees).__name__}")
    return trees


def leaf_paths(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row per leaf: its weighted value, and the interval ``low < x <= high`` of each feature on its way.

    The nodes are read from the saved form of the model; conditions spread from the roots
    down, a step per level of the trees, so the number of joins is the depth.
    """
    path = shared_folder(spark, "trees")
    _ensemble(model).write().save(path)
    node = F.col("nodeData")
    split = node["split"]
    nodes = materialize(
        spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), node["id"].alias("id"), node["prediction"].alias("value"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"),
            split["featureIndex"].alias("feature"), split["numCategories"].alias("categories"),
            F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("edge")),
        "nodes")
    if nodes.where("left >= 0 and categories >= 0").limit(1).count():
        raise ValueError("splits by category are not supported")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))

    way = "array<struct<feature:int,low:double,high:double>>"
    at = nodes.where("id = 0").withColumn("way", F.array().cast(way))
    leaves = None
    while True:
        ended = at.where("left < 0")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        going = at.where("left >= 0")
        if not going.limit(1).count():
            break
        low, high = F.lit(float("-inf")), F.lit(float("inf"))
        step = F.inline(F.array(
            F.struct(F.col("left").alias("id"), F.struct("feature", low.alias("low"), F.col("edge").alias("high")).alias("turn")),
            F.struct(F.col("right").alias("id"), F.struct("feature", F.col("edge").alias("low"), high.alias("high")).alias("turn"))))
        ways = going.select("tree", "way", step).select("tree", "id", F.concat("way", F.array("turn").cast(way)).alias("way"))
        at = materialize(ways.join(nodes, ["tree", "id"]), "level")

    merged = F.transform(
        F.array_sort(F.array_distinct(F.transform("way", lambda t: t["feature"]))),
        lambda f: F.struct(
            f.alias("feature"),
            F.array_max(F.transform(F.filter("way", lambda t: t["feature"] == f), lambda t: t["low"])).alias("low"),
            F.array_min(F.transform(F.filter("way", lambda t: t["feature"] == f), lambda t: t["high"])).alias("high")))
    one = leaves.join(weights, "tree").withColumn("ends", merged)
    return materialize(one.select(
        "tree", F.col("id").alias("leaf"), (F.col("value") * F.col("weight")).alias("value"),
        F.col("ends.feature").alias("features"), F.col("ends.low").alias("lows"), F.col("ends.high").alias("highs")), "leaves")


class LeafTable:
    """Leaves as padded arrays, with the background rows counted by the conditions they meet."""

    def __init__(self, leaves: list, background: np.ndarray):
        self.value = np.array([r["value"] for r in leaves])
        self.width = max((len(r["features"]) for r in leaves), default=0)
        shape = (len(leaves), self.width)
        self.feature = np.zeros(shape, np.int64)
        self.low, self.high = np.full(shape, -np.inf), np.full(shape, np.inf)
        for at, row in enumerate(leaves):
            n = len(row["features"])
            self.feature[at, :n], self.low[at, :n], self.high[at, :n] = row["features"], row["lows"], row["highs"]
        self.full = (1 << self.width) - 1
        # Leaves share their conditions; one that always holds fills up the width.
        edges = np.stack([self.feature.ravel(), self.low.ravel(), self.high.ravel()], axis=1)
        self.conditions, number = np.unique(edges, axis=0, return_inverse=True)
        self.condition = number.reshape(shape)
        self.known = self.parts = self.place = None
        codes = [self._codes(background[at : at + self._rows()]) for at in range(0, len(background), self._rows())]
        found, counts = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
        self.leaf, self.mask = found >> self.width, found & self.full
        self.share = counts / max(1, len(background))
        self.first = np.searchsorted(self.leaf, np.arange(len(leaves) + 1))
        alone = 1 + self.width
        self.plus, self.minus = np.zeros((alone, alone)), np.zeros((alone, alone))
        for a in range(alone):
            for c in range(alone - a):
                if a:
                    self.plus[a, c] = factorial(a - 1) * factorial(c) / factorial(a + c)
                if c:
                    self.minus[a, c] = factorial(a) * factorial(c - 1) / factorial(a + c)

    def _rows(self) -> int:
        return max(1, CELLS // max(1, len(self.value)))

    def _codes(self, rows: np.ndarray) -> np.ndarray:
        """For each row and leaf: the leaf, and a bit per feature on its way whose interval holds the row."""
        # A missing number turns right at every split, as a number beyond all edges does.
        rows = np.maximum(np.where(np.isnan(rows), np.inf, rows), np.finfo(float).min)
        x = rows[:, self.conditions[:, 0].astype(int)]
        inside = (x <= self.conditions[:, 2]) & ~(x <= self.conditions[:, 1])
        mask = np.zeros((len(rows), len(self.value)), np.int64)
        for at in range(self.width):
            mask |= inside[:, self.condition[:, at]].astype(np.int64) << at
        return (mask | (np.arange(len(self.value)) << self.width)).ravel()

    def contributions(self, rows: np.ndarray) -> np.ndarray:
        """Contribution of each feature to each row."""
        out = [self._some(rows[at : at + self._rows()]) for at in range(0, len(rows), self._rows())]
        return np.concatenate(out) if out else np.zeros(rows.shape)

    def _some(self, rows: np.ndarray) -> np.ndarray:
        n, features = rows.shape
        if self.place is None:
            self.place = (self.feature.ravel()[:, None] == np.arange(features)).astype(float)
        codes = self._codes(rows)
        if len(self.value) << self.width > PARTS:
            pairs, number = np.unique(codes, return_inverse=True)
            parts = self._parts(pairs)[number.ravel()]
        else:
            if self.known is None:
                self.known = np.zeros(len(self.value) << self.width, bool)
                self.parts = np.zeros((len(self.known), self.width))
            fresh = np.unique(codes[~self.known[codes]])
            if len(fresh):
                self.parts[fresh], self.known[fresh] = self._parts(fresh), True
            parts = self.parts[codes]
        return parts.reshape(n, -1) @ self.place

    def _parts(self, pairs: np.ndarray) -> np.ndarray:
        """Contribution of each condition on a leaf's way, for pairs of a leaf and a mask."""
        leaf, mask = pairs >> self.width, pairs & self.full
        # Every pair of leaf and mask meets the masks the background has in that leaf.
        counts = self.first[leaf + 1] - self.first[leaf]
        pair = np.repeat(np.arange(len(pairs)), counts)
        other = np.repeat(self.first[leaf] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        reached = (mask[pair] | self.mask[other]) == self.full
        pair, other = pair[reached], other[reached]
        own = np.bitwise_count(self.full & ~self.mask[other])
        theirs = np.bitwise_count(self.full & ~mask[pair])
        scale = self.share[other] * self.value[leaf[pair]]
        plus, minus = scale * self.plus[own, theirs], scale * self.minus[own, theirs]
        against = np.bincount(pair, minus, len(pairs))
        out = np.zeros((len(pairs), self.width))
        for at in range(self.width):
            only_own = (self.mask[other] >> at & 1) == 0
            gain = np.bincount(pair[only_own], plus[only_own], len(pairs))
            out[:, at] = np.where((mask >> at & 1) == 1, gain, -against)
        return out


def tree_contributions(
    df: DataFrame, key: str, columns: list[str], background: DataFrame, model: PipelineModel,
    most_background: int = BACKGROUND_ROWS, leaves: DataFrame | None = None,
) -> DataFrame:
    """``(key, feature, value, contribution)`` rows, exact Shapley values of a boosted model's margin.

    ``columns`` are the model's inputs in order. A row's contributions add up to its margin less the
    mean margin of ``background``. The leaves of the model (their number is set by its trees and
    depth, not by the data) and the background, at most ``most_background`` rows or it raises, are sent
    to the tasks; rows are dealt to all cores and explained in one pass. Null features count as missing.
    ``leaves`` spares reading the model again.
    """
    spark = df.sparkSession
    chosen = background.select(*[F.col(c).cast("double").alias(c) for c in columns]).limit(most_background + 1).collect()
    if len(chosen) > most_background:
        raise ValueError(f"a background of more than {most_background} rows")
    if not chosen:
        raise ValueError("the background is empty")
    listed = (leaf_paths(spark, model) if leaves is None else leaves).orderBy("tree", "leaf").collect()
    lines = np.array([[np.nan if v is None else v for v in r] for r in chosen])
    sent = spark.sparkContext.broadcast(LeafTable(listed, lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]]
            rows = np.stack(numbers, axis=1)
            found = table.contributions(rows)
            n = batch.num_rows
            names = pa.DictionaryArray.from_arrays(np.tile(np.arange(len(columns)), n).astype(np.int32), pa.array(columns))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), len(columns)))), names.cast(pa.string()),
                 pa.array(rows.ravel(), from_pandas=True), pa.array(found.ravel())],
                [key, "feature", "value", "contribution"])

    given = spread(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]))
    kind = given.schema[key].dataType.simpleString()
    return given.mapInArrow(run, f"`{key}` {kind}, feature string, value double, contribution double")


def on_edges(df: DataFrame, model: PipelineModel, columns: list[str], chosen: list[str]) -> DataFrame:
    """``df`` with each ``chosen`` number put on the next edge above it that the trees have for it, or on infinity.

    ``columns`` are the model's inputs in order. Every split sends ``x <= edge`` to the left, so the margin stays the
    same; a feature has at most as many edges as bins. Missing numbers turn right everywhere, as infinity does.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "trees")
    _ensemble(model).write().save(path)
    split = F.col("nodeData.split")
    found = spark.read.parquet(f"{path}/data").where("nodeData.leftChild >= 0")
    if found.where(split["numCategories"] >= 0).limit(1).count():
        raise ValueError("splits by category are not supported")
    edges = {columns[r["feature"]]: sorted(r["edges"]) for r in found.groupBy(split["featureIndex"].alias("feature")).agg(
        F.collect_set(F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("edges")).collect()}

    def above(name: str) -> Column:
        own = F.array(*[F.lit(float(e)) for e in edges.get(name, [])], F.lit(float("inf")))
        return F.coalesce(F.get(F.filter(own, lambda e: e >= F.col(name)), F.lit(0)), F.lit(float("inf"))).alias(name)

    return df.select(*[above(c) if c in chosen else F.col(c) for c in df.columns])


def margins(df: DataFrame, model: PipelineModel, name: str = "margin") -> DataFrame:
    """``df`` with the boosted model's margin: the weighted sum over its trees."""
    trees = _ensemble(model)
    scored = model.transform(df)
    if isinstance(trees, GBTRegressionModel):
        return scored.select(*df.columns, F.col(trees.getPredictionCol()).alias(name))
    return scored.select(*df.columns, vector_to_array(trees.getRawPredictionCol())[1].alias(name))
