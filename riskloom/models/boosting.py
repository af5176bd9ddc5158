"""Boosted trees over binned rows.

``pyspark.ml`` grows the same trees by several jobs per level, so that a model of hundreds of trees is thousands of jobs.
Here a table of up to ``TASK_CELLS`` numbers, or ``BESIDE_CELLS`` where other fits take the other cores, is one task, which grows all trees; several features are counted at once
there. A larger one stays in the memory of many tasks, which add up their histograms by one short job a level. (Tasks of a barrier stage can't: Spark looks for the answer
to an ``allGather`` once a second.) Loss, bins, gains, leaf values and weights are those of ``pyspark.ml``, and the result is
its model class; only the draws of rows and features differ.
"""

from __future__ import annotations

import json
import pickle
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

TASK_CELLS = 1 << 23  # numbers of a training table that one task takes
BESIDE_CELLS = 1 << 26  # the same for one of several fits side by side
FITS = "riskloom.fits"  # local property: how many fits run side by side
SHARE_CELLS = 1 << 20  # numbers a task keeps of a larger one, as long as there are cores for more tasks
BITS = 10  # bits of the bins of the features that are counted at once
POINTS = 1 << 14  # distinct values of a feature a task reports for the bins; more are put together by rank
MESSAGE = 1 << 18  # numbers in one row of a task's answer
ADDED = 50  # trees after which margins are worked out from the rows anew, which keeps their lineage short
NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
    "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)
TREE = "org.apache.spark.ml.regression.DecisionTreeRegressionModel"


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    step: float
    rate: float
    features: int
    bins: int
    least_rows: int
    least_gain: float
    seed: int
    classes: bool
    weighted: bool


def feature_number(strategy: str, width: int) -> int:
    """How many of ``width`` features a node may choose from: all, a share or a number."""
    if strategy in ("all", "auto"):
        return width
    if re.fullmatch(r"\d+", strategy) and int(strategy) > 0:
        return min(int(strategy), width)
    if re.fullmatch(r"\d*\.\d+", strategy) and 0 < float(strategy) <= 1:
        return ceil(float(strategy) * width)
    raise ValueError(f"unknown feature subset {strategy}")


class Peers:
    """The tasks that share the rows of a forest: one."""

    number = 1

    def total(self, numbers: np.ndarray) -> np.ndarray:
        return numbers


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Edges between sorted distinct values: all if there are fewer than ``bins``, else near equal weights."""
    between = (values[:-1] + values[1:]) / 2
    if len(between) < bins:
        return between
    below = np.cumsum(weights)
    nearer, stride, found, at = (below[:-1] + below[1:]) / 2, below[-1] / bins, [], -1
    target = stride
    while (at := max(at + 1, int(np.searchsorted(nearer, target, "right")))) < len(between):
        found.append(at)
        target += stride
    return between[found]


def _distinct(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(values, return_inverse=True)
    return found, np.bincount(place, weights, len(found))


def _points(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Known distinct values and their weights."""
    known = ~np.isnan(values)
    return _distinct(values[known], weights[known])


def _fewer_points(found: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(found) <= POINTS:
        return found, mass
    cell = np.minimum((np.cumsum(mass) * (POINTS / mass.sum())).astype(int), POINTS - 1)
    last = np.append(np.flatnonzero(np.diff(cell)), len(cell) - 1)
    return found[last], np.diff(np.cumsum(mass)[last], prepend=0.0)


def _both_children(small: list[np.ndarray], parents: list[np.ndarray], left: np.ndarray) -> list[np.ndarray]:
    """Histograms of all children, from those of the smaller ones and their parents'; rows come first, their counts are exact."""
    found, empty, at = [], None, 2 * np.arange(len(left))
    for few, whole in zip(small, parents, strict=True):
        rest = whole - few
        empty = rest == 0 if empty is None else empty
        rest[empty] = 0.0  # no rows, no remainder of rounding
        found.append(np.empty((2 * len(left), *few.shape[1:])))
        found[-1][at + ~left], found[-1][at + left] = few, rest
    return found


def _ends(nodes: dict, codes: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
    """The node of a tree, grown as far as it is, that the rows of these bins, or some of them, come to."""
    some = np.arange(codes.shape[1]) if some is None else some
    at, row = np.zeros(len(some), np.int64), np.arange(len(some))
    left, cut, line = nodes["left"], nodes["cut"], np.maximum(nodes["feature"], 0) * codes.shape[1]
    flat = codes.ravel()
    while len(row):
        row = row[left.take(at.take(row)) >= 0]
        here = at.take(row)
        at[row] = left.take(here) + (flat.take(line.take(here) + some.take(row)) > cut.take(here))
    return at


def _values(nodes: dict, codes: np.ndarray) -> np.ndarray:
    """A tree's prediction for the rows of these bins."""
    return nodes["prediction"][_ends(nodes, codes)]


class Bins:
    """What to grow and the edges of the features; all that needs no rows in hand."""

    def __init__(self, settings: Settings, edges: list[np.ndarray]):
        self.settings, self.edges = settings, edges
        self.bins = max((len(e) for e in edges), default=0) + 1
        self.cuts = np.array([[b < len(e) for b in range(self.bins)] for e in edges])  # a bin that an edge ends
        self.held = np.array([[b <= len(e) for b in range(self.bins)] for e in edges])
        self.bits = [len(e).bit_length() for e in edges]
        self.bundles: list[list[int]] = []
        for f in sorted(range(len(edges)), key=lambda f: -self.bits[f]):
            room = [b for b in self.bundles if sum(self.bits[g] for g in b) + self.bits[f] <= BITS]
            if room:
                room[0].append(f)
            else:
                self.bundles.append([f])

    def step(self, tree: int) -> float:
        return self.settings.step if tree else 1.0

    def drawn(self, tree: int, rank: int, rows: int) -> np.ndarray | slice:
        s = self.settings
        return slice(None) if s.rate >= 1 else np.random.default_rng([s.seed, tree, rank]).random(rows) < s.rate

    def target(self, label: np.ndarray, margin: np.ndarray, tree: int) -> np.ndarray:
        """The negative gradient of the loss at the margin."""
        if not tree:
            return label
        if not self.settings.classes:
            return 2 * (label - margin)
        with np.errstate(over="ignore"):
            return 4 * label / (1 + np.exp(2 * label * margin))

    def _codes(self, rows: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The bin of each number, a line per feature; of some rows."""
        kind = np.min_scalar_type(self.bins)
        return np.stack([np.searchsorted(e, rows[some, f]).astype(kind) for f, e in enumerate(self.edges)])

    def _packed(self, codes: np.ndarray) -> list[np.ndarray]:
        """The bins of the features of each bundle in one number, the first in its lowest bits."""
        out = []
        for features in self.bundles:
            whole, at = np.zeros(codes.shape[1], np.min_scalar_type((1 << sum(self.bits[f] for f in features)) - 1)), 0
            for f in features:
                whole |= codes[f].astype(whole.dtype) << whole.dtype.type(at)
                at += self.bits[f]
            out.append(whole)
        return out

    def sums(self, codes, slot, target, value, weight, count: int, smaller, deepest: bool, row=None, packed=None) -> np.ndarray:
        """Sums of these rows by node, then histograms: of all nodes, or of the ``smaller`` one of two children.

        The larger child has what their parent has besides. ``row`` has the places of the rows in ``codes``.
        """
        number = np.bincount(slot, minlength=count)
        mass = np.bincount(slot, weight, count) if self.settings.weighted else number
        own = [number, mass, np.bincount(slot, value, count), np.bincount(slot, value * target, count)]
        hists = []
        if not deepest and smaller is None:
            hists = self._histograms(codes, slot, value, weight, count, row, packed)
        elif not deepest:
            picked = np.flatnonzero(np.stack([smaller, ~smaller], 1).ravel().take(slot))
            places = picked if row is None else row[picked]
            hists = self._histograms(codes, slot[picked] >> 1, value[picked], weight[picked], count // 2, places, packed)
        return np.concatenate([*own, *(h[:, self.held].ravel() for h in hists)]).astype(float)

    def _tree(self, rows, tree: int) -> dict:
        """Columns of the nodes; ``rows`` counts them and follows their splits."""
        s, width = self.settings, len(self.edges)
        levels, born = [], 1
        halves = None  # of each split node: its histograms, and whether its left child is the smaller one
        for level in range(s.depth + 1):
            count = 1 if not level else kept
            summed = rows.counted(count, None if halves is None else halves[1], level == s.depth)
            number, mass, total, square = summed[: 4 * count].reshape(4, count)
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = np.where(mass > 0, total / mass, 0.0)
                spread = np.where(mass > 0, np.maximum(square / mass - mean**2, 0.0), 0.0)
            nodes = {
                "prediction": mean, "impurity": spread, "stats": np.stack([mass, total, square], 1), "rows": number.astype(np.int64),
                "gain": np.full(count, -1.0), "left": np.full(count, -1), "feature": np.full(count, -1), "cut": np.full(count, -1),
            }
            levels.append(nodes)
            if level == s.depth:
                rows.end(nodes)
                break
            full, asked = [], count if halves is None else count // 2
            for h in summed[4 * count :].reshape(2 + s.weighted, -1):
                full.append(np.zeros((asked, width, self.bins)))
                full[-1][:, self.held] = h.reshape(asked, -1)
            if halves is not None:
                full = _both_children(full, *halves)
            gain, feature, cut, fewer = self._best(full, number, mass, total, tree, level)
            # A node of one value is split no further; rounding may leave it a gain.
            going = (gain > 0) & (gain >= s.least_gain) & (spread > 1e-14 * (spread + mean**2))
            kept = 2 * int(going.sum())
            if not kept:
                rows.end(nodes)
                break
            child = np.where(going, 2 * np.cumsum(going) - 2, -1)
            nodes["gain"][going], nodes["feature"][going], nodes["cut"][going] = gain[going], feature[going], cut[going]
            nodes["left"][going] = born + child[going]
            born += kept
            halves = [h[going] for h in full], fewer[going]
            rows.follow(nodes, going, child)
        return {name: np.concatenate([n[name] for n in levels]) for name in levels[0]}

    def _histograms(self, codes, slot, value, weight, count: int, picked=None, packed=None) -> list[np.ndarray]:
        """Rows, sums and, where they differ from the rows, weights by node, feature and bin; of the picked rows."""
        size, first = count * self.bins, slot * self.bins
        out = [np.empty((count, len(codes), self.bins)) for _ in range(2 + self.settings.weighted)]
        if packed is not None and len(slot) >= count << BITS:
            return self._of_bundles(packed, slot, value, weight, count, picked, out)
        for f, code in enumerate(codes):
            key = first + (code if picked is None else code[picked])
            for hist, of in zip(out, (None, value, weight)):
                hist[:, f] = np.bincount(key, of, size).reshape(count, self.bins)
        return out

    def _of_bundles(self, packed, slot, value, weight, count: int, picked, out: list[np.ndarray]) -> list[np.ndarray]:
        """The histograms from those of the bundles, by adding up over their other features: for many rows a node."""
        for line, features in zip(packed, self.bundles, strict=True):
            size = 1 << sum(self.bits[f] for f in features)
            key = slot * size
            key += line if picked is None else line.take(picked)
            for hist, of in zip(out, (None, value, weight)):
                cells = np.bincount(key, of, count * size).astype(float, copy=False)
                for f in features:
                    cells = cells.reshape(count, -1, 1 << self.bits[f])
                    bins = len(self.edges[f]) + 1
                    hist[:, f, :bins] = (np.ones(cells.shape[1]) @ cells)[:, :bins]
                    cells = cells @ np.ones(cells.shape[2])
        return out

    def _best(self, hists, rows, mass, total, tree: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gain, feature and last bin to the left of the best split of each node, and whether fewer rows go left."""
        s, (count, width, _) = self.settings, hists[0].shape
        left = [np.cumsum(h, axis=2) for h in hists]
        few, sums, heavy = left[0], left[1], left[-1] if s.weighted else left[0]
        ways = self.cuts & (few >= s.least_rows) & (rows[:, None, None] - few >= s.least_rows)
        if s.features < width:
            order = np.random.default_rng([s.seed, tree, level]).random((count, width)).argsort(axis=1).argsort(axis=1)
            ways &= (order < s.features)[:, :, None]
        whole, all_ = mass[:, None, None], total[:, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = (sums**2 / heavy + (all_ - sums) ** 2 / (whole - heavy) - all_**2 / whole) / whole
        gains = np.where(ways & np.isfinite(gains), gains, -np.inf).reshape(count, -1)
        best = gains.argmax(axis=1)
        at = np.arange(count)
        return gains[at, best], best // self.bins, best % self.bins, 2 * few.reshape(count, -1)[at, best] <= rows


class Forest(Bins):
    """The rows of a task, or the ``learned`` ones of them, and the trees it grows over them."""

    def __init__(self, rows: np.ndarray, label: np.ndarray, weight: np.ndarray, settings: Settings, peers: Peers, learned=None):
        order = _order(rows, label, weight, np.arange(len(rows)) if learned is None else learned)
        self.label, self.weight = _signed(label[order], settings), weight[order]
        self.peers = peers
        super().__init__(settings, [thresholds(*_points(rows[order, f], self.weight), settings.bins) for f in range(rows.shape[1])])
        self.codes = self._codes(rows, order)
        self.packed = self._packed(self.codes)
        self.margin = np.zeros(len(order))

    def grow(self) -> Iterator[dict]:
        """The trees, one after another: columns of their nodes."""
        for tree in range(self.settings.trees):
            rows = Drawn(self, self.drawn(tree, 0, len(self.label)), self.target(self.label, self.margin, tree))
            nodes = self._tree(rows, tree)
            self.margin += self.step(tree) * rows.found
            yield nodes

    def margins(self, codes: np.ndarray) -> np.ndarray:
        """Grows the trees; margins of rows of these bins, which they don't learn from."""
        margin = np.zeros(codes.shape[1])
        for tree, nodes in enumerate(self.grow()):
            margin += self.step(tree) * _values(nodes, codes)
        return margin


class Drawn:
    """The rows in hand, each in the slot of its node: first those that a tree learns from.

    The others go along, so that no row has to find its leaf anew; ``found`` has the predictions.
    """

    def __init__(self, forest: Forest, drawn: np.ndarray | slice, target: np.ndarray):
        learned = np.arange(len(target))[drawn]
        rest = [] if isinstance(drawn, slice) else [np.flatnonzero(~drawn)]
        self.forest, self.row, self.number = forest, np.concatenate([learned, *rest]), len(learned)
        self.target, self.weight = target[learned], forest.weight[learned]
        self.value, self.slot = self.weight * self.target, np.zeros(len(target), np.int64)
        self.found = np.empty(len(target))

    def counted(self, count: int, smaller: np.ndarray | None, deepest: bool) -> np.ndarray:
        forest, n = self.forest, self.number
        found = forest.sums(
            forest.codes, self.slot[:n], self.target, self.value, self.weight, count, smaller, deepest, self.row[:n], forest.packed)
        return forest.peers.total(found)

    def follow(self, nodes: dict, going: np.ndarray, child: np.ndarray) -> None:
        alive = going.take(self.slot)
        if not alive.all():
            self._end(nodes, np.flatnonzero(~alive))
            kept, alive = np.flatnonzero(alive[: self.number]), np.flatnonzero(alive)
            self.target, self.weight, self.value = self.target[kept], self.weight[kept], self.value[kept]
            self.row, self.slot, self.number = self.row[alive], self.slot[alive], len(kept)
        slot, codes = self.slot, self.forest.codes
        at = (nodes["feature"] * codes.shape[1]).take(slot)
        at += self.row
        right = codes.ravel().take(at) > nodes["cut"].take(slot)
        self.slot = child.take(slot)
        self.slot += right

    def end(self, nodes: dict) -> None:
        self._end(nodes, slice(None))

    def _end(self, nodes: dict, over: np.ndarray | slice) -> None:
        self.found[self.row[over]] = nodes["prediction"][self.slot[over]]


def _order(rows, label, weight, some: np.ndarray) -> np.ndarray:
    """The order of rows in a task is left open by shuffles; draws and sums need one."""
    for key in (weight, label, *rows.T):
        some = some[np.argsort(key[some], kind="stable")]
    return some


def _signed(label: np.ndarray, settings: Settings) -> np.ndarray:
    return 2 * label - 1 if settings.classes else label


class DealtForest(Bins):
    """Trees over rows dealt to many tasks, which keep them binned, next to their margins.

    ``blocks`` has an array of rows, labels, weights and marks of held rows per partition. Histograms and distinct values,
    whose size the settings fix, come to the driver; rows don't.
    """

    def __init__(self, blocks: RDD, width: int, settings: Settings):
        self.trees: list[dict] = []
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        told = blocks.map(lambda b: [_fewer_points(*_points(b[0][~b[3], f], b[2][~b[3]])) for f in range(width)]).collect()
        points = [_distinct(*(np.concatenate(side) for side in zip(*of, strict=True))) for of in zip(*told, strict=True)]
        super().__init__(settings, [thresholds(*p, settings.bins) for p in points])
        bins = self._plain()
        self.blocks = blocks.map(lambda b: (bins._codes(b[0]), *b[1:])).persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks.count()
        blocks.unpersist()
        self.state = self._from_start()

    def _plain(self) -> Bins:
        """Without the handles of the cluster, to be sent to it."""
        return Bins(self.settings, self.edges)

    def _from_start(self) -> RDD:
        bins, trees = self._plain(), [{k: t[k] for k in ("left", "feature", "cut", "prediction")} for t in self.trees]

        def margins(block: tuple) -> tuple:
            margin = np.zeros(len(block[1]))
            for tree, nodes in enumerate(trees):
                margin += bins.step(tree) * _values(nodes, block[0])
            return *block, margin

        return self.blocks.map(margins).persist(StorageLevel.MEMORY_AND_DISK)

    def _added(self, tree: int, nodes: dict) -> RDD:
        step, nodes = self.step(tree), {k: nodes[k] for k in ("left", "feature", "cut", "prediction")}
        kept = self.state.map(lambda b: (*b[:4], b[4] + step * _values(nodes, b[0])))
        return kept.persist(StorageLevel.MEMORY_AND_DISK)

    def grow(self) -> Iterator[dict]:
        """The trees, one after another. Of margins the newest are kept, and those before until the newest are there."""
        before = None
        for tree in range(self.settings.trees):
            rows = Counted(self._plain(), self.state, tree, before)
            nodes = self._tree(rows, tree)
            self.trees.append(nodes)
            before = self.state
            self.state = self._added(tree, nodes) if (tree + 1) % ADDED else self._from_start()
            yield nodes

    def close(self) -> None:
        for kept in (self.state, self.blocks):
            kept.unpersist()


class Counted:
    """Counts the rows of a forest by a job a level, in which they find their nodes anew."""

    def __init__(self, bins: Bins, state: RDD, tree: int, before: RDD | None):
        self.bins, self.state, self.tree, self.before = bins, state, tree, before
        self.levels: list[dict] = []

    def counted(self, count: int, smaller: np.ndarray | None, deepest: bool) -> np.ndarray:
        bins, tree = self.bins, self.tree
        grown = {k: np.concatenate([*(n[k] for n in self.levels), np.full(count, -1)]) for k in ("left", "feature", "cut")}
        first = len(grown["left"]) - count

        def task(rank: int, blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
            for codes, label, weight, held, margin in blocks:
                learned = np.flatnonzero(~held)
                learned = learned[bins.drawn(tree, rank, len(learned))]
                slot = _ends(grown, codes, learned) - first
                open_ = slot >= 0
                if not open_.all():
                    slot, learned = slot[open_], learned[open_]
                target, weight = bins.target(label[learned], margin[learned], tree), weight[learned]
                found = bins.sums(codes, slot, target, weight * target, weight, count, smaller, deepest, learned)
                yield from (found[at : at + MESSAGE] for at in range(0, len(found), MESSAGE))

        parts = self.state.mapPartitionsWithIndex(task).collect()
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        messages = -(-sum(map(len, parts)) // self.state.getNumPartitions() // MESSAGE)
        return np.concatenate([np.add.reduce(parts[at::messages]) for at in range(messages)])

    def follow(self, nodes: dict, going: np.ndarray, child: np.ndarray) -> None:
        self.levels.append(nodes)

    def end(self, nodes: dict) -> None:
        """Rows find their leaf when the tree is added."""


def _batch(tree: int, nodes: dict, edges: list[np.ndarray]) -> pa.RecordBatch:
    number, inner = len(nodes["left"]), nodes["left"] >= 0
    edge = np.array([edges[f][c] for f, c in zip(nodes["feature"][inner], nodes["cut"][inner], strict=True)], float)
    at = pa.array(np.append(0, np.cumsum(inner)), pa.int32())
    split = pa.StructArray.from_arrays(
        [pa.array(nodes["feature"], pa.int32()), pa.ListArray.from_arrays(at, pa.array(edge, pa.float64())), pa.array(np.full(number, -1), pa.int32())],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = pa.ListArray.from_arrays(pa.array(np.arange(number + 1) * 3, pa.int32()), pa.array(nodes["stats"].ravel()))
    data = pa.StructArray.from_arrays(
        [pa.array(np.arange(number), pa.int32()), pa.array(nodes["prediction"]), pa.array(nodes["impurity"]), stats, pa.array(nodes["rows"]),
         pa.array(nodes["gain"]), pa.array(nodes["left"], pa.int32()), pa.array(np.where(inner, nodes["left"] + 1, -1), pa.int32()), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(number, tree), pa.int32()), data], ["treeID", "nodeData"])


def _read(batches: Iterator[pa.RecordBatch], width: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, labels, weights and marks; about ``number`` rows, so that they are held once."""
    rows, rest, at = np.empty((number, width)), [np.zeros((3, 0))], 0
    for batch in batches:
        end = at + batch.num_rows
        if end > len(rows):
            rows = np.concatenate([rows[:at], np.empty((end, width))])
        rows[at:end] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        rest.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3)]))
        at = end
    label, weight, held = np.concatenate(rest, axis=1)
    return rows[:at], label, weight, held > 0


class BoostedTrees(Estimator):
    """Fits what ``trees``, a ``GBTClassifier`` or ``GBTRegressor``, asks for; ``width`` features."""

    def __init__(self, trees: GBTClassifier | GBTRegressor, width: int):
        super().__init__()
        self.trees, self.width = trees, width

    def _given(self, dataset: DataFrame, held: Column) -> tuple[DataFrame, Settings, int, int]:
        """The rows to learn from and those held back, what to grow, the number of tasks and that of rows."""
        spark, trees, width = dataset.sparkSession, self.trees, self.width
        classes, weighted = isinstance(trees, GBTClassifier), trees.isSet("weightCol")
        settings = Settings(
            trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.getSubsamplingRate(),
            feature_number(trees.getFeatureSubsetStrategy(), width), trees.getMaxBins(), trees.getMinInstancesPerNode(),
            trees.getMinInfoGain(), trees.getSeed() & (1 << 63) - 1, classes, weighted)
        weight = F.col(trees.getWeightCol()).cast("double") if weighted else F.lit(1.0)
        label = F.col(trees.getLabelCol()).cast("double")
        given = dataset.select(vector_to_array(trees.getFeaturesCol()).alias("x"), label.alias("y"), weight.alias("w"), held.alias("h"))
        valid = F.col("y").isin(0.0, 1.0) if classes else ~F.isnan("y")
        checked = given.agg(
            F.count(F.lit(1)).alias("all"), F.count_if(~F.col("h")).alias("rows"),
            F.count_if(~F.col("h") & F.coalesce(valid & (F.col("w") >= 0), F.lit(False))).alias("valid")).first()
        if not checked["rows"] or checked["rows"] != checked["valid"]:
            raise ValueError(f"{checked['rows']} rows to learn from, {checked['valid']} of them with a valid label and weight")
        cells = checked["rows"] * width
        beside = int(spark.sparkContext.getLocalProperty(FITS) or 1) > 1
        slots = max(1, spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1")))
        tasks = 1 if cells <= (BESIDE_CELLS if beside else TASK_CELLS) else max(2, min(slots, ceil(cells / min(TASK_CELLS, SHARE_CELLS))))
        return given, settings, tasks, checked["all"]

    def _dealt(self, given: DataFrame, settings: Settings, tasks: int, number: int) -> DealtForest:
        width, each = self.width, number // tasks + 1

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, label, weight, held = _read(batches, width, each)
            order = _order(rows, label, weight, np.arange(len(rows)))
            block = rows[order], _signed(label[order], settings), weight[order], held[order]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

        packed = given.repartition(tasks).mapInArrow(pack, "block binary")
        return DealtForest(packed.rdd.map(lambda r: pickle.loads(r["block"])), width, settings)

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel | GBTRegressionModel:
        spark, width = dataset.sparkSession, self.width
        given, settings, tasks, number = self._given(dataset, F.lit(False))
        path = shared_folder(spark, "boosted")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = Forest(*_read(batches, width, number)[:3], settings, Peers())
            for tree, nodes in enumerate(forest.grow()):
                yield _batch(tree, nodes, forest.edges)

        if tasks == 1:
            given.repartition(1).mapInArrow(run, NODES).write.parquet(f"{path}/data")
        else:
            forest = self._dealt(given, settings, tasks, number)
            try:
                grown = pa.Table.from_batches([_batch(tree, nodes, forest.edges) for tree, nodes in enumerate(forest.grow())])
            finally:
                forest.close()
            spark.createDataFrame(grown, NODES).coalesce(1).write.parquet(f"{path}/data")
        return self._model(spark, path, settings)

    def write_margins(self, dataset: DataFrame, held: Column, path: str) -> None:
        """Writes ``(label, margin)`` of the rows where ``held``, by trees grown on all others; builds no model."""
        spark, width, schema = dataset.sparkSession, self.width, "label double, margin double"
        given, settings, tasks, number = self._given(dataset, held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, label, weight, kept = _read(batches, width, number)
            forest, kept = Forest(rows, label, weight, settings, Peers(), np.flatnonzero(~kept)), np.flatnonzero(kept)
            codes = forest._codes(rows, kept)
            del rows
            yield pa.RecordBatch.from_arrays([pa.array(label[kept]), pa.array(forest.margins(codes))], ["label", "margin"])

        if tasks == 1:
            given.coalesce(1).mapInArrow(run, schema).write.parquet(path)  # a fit among many: no core is left to deal rows
            return
        forest = self._dealt(given, settings, tasks, number)
        try:
            for _ in forest.grow():
                pass
            classes = settings.classes
            found = forest.state.flatMap(lambda b: zip(((b[1][b[3]] + 1) / 2 if classes else b[1][b[3]]).tolist(), b[4][b[3]].tolist()))
            spark.createDataFrame(found, schema).write.parquet(path)
        finally:
            forest.close()

    def _model(self, spark, path: str, settings: Settings):
        """The model class of ``pyspark.ml``, from its saved form around the nodes."""
        kind = GBTClassificationModel if settings.classes else GBTRegressionModel
        area = "classification" if settings.classes else "regression"
        given = {p.name: v for p, v in self.trees._paramMap.items()}
        usual = {p.name: v for p, v in self.trees._defaultParamMap.items()}
        now = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        single = {"maxDepth": settings.depth}
        whole = {
            "class": f"org.apache.spark.ml.{area}.{kind.__name__}", **now, "uid": self.trees.uid, "paramMap": given,
            "defaultParamMap": usual, "numFeatures": self.width, "numTrees": settings.trees}
        one = {"class": TREE, **now, "paramMap": single, "defaultParamMap": {}}
        lines = [(t, json.dumps({**one, "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), settings.step if t else 1.0) for t in range(settings.trees)]
        spark.createDataFrame(lines, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return kind.load(path)
