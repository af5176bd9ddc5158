"""Margins of boosted trees for many rows at once, tree by tree over Arrow batches.

``transform`` of ``pyspark.ml`` takes each row through the objects of all trees, whose nodes lie scattered in memory. Here
the numbers of a batch become ranks among the model's thresholds first, and a step down a tree is one lookup for all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

ROWS = 1 << 13  # rows that go down a tree together
LINE = re.compile(r"\s*(?:Tree \d+ \(weight (\S+)\):|If \(feature (\d+) <= (\S+)\)|(Else) \(.*\)|Predict: (\S+))")


class Trees:
    """Nodes of all trees in one table; a leaf is its own child."""

    def __init__(self, roots: list[int], feature: np.ndarray, edge: np.ndarray, child: np.ndarray, value: np.ndarray, width: int):
        self.feature, self.child, self.value = feature, child.ravel(), value
        inner = feature >= 0
        self.edges = [np.unique(edge[inner & (feature == f)]) for f in range(width)]
        self.cut = np.zeros(len(feature), np.int64)
        for f, edges in enumerate(self.edges):
            own = inner & (feature == f)
            self.cut[own] = np.searchsorted(edges, edge[own])
        self.feature = np.maximum(feature, 0)
        self.roots, self.steps = roots, []
        for root in roots:
            level, steps = np.array([root]), 0
            while len(level := level[inner[level]]):
                level, steps = child[level].ravel(), steps + 1
            self.steps.append(steps)

    def margins(self, numbers: list[np.ndarray]) -> np.ndarray:
        """The sum over the trees for each row of these features. A missing number turns right everywhere."""
        rows = len(numbers[0])
        parts = [self._some([x[at : at + ROWS] for x in numbers]) for at in range(0, rows, ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _some(self, numbers: list[np.ndarray]) -> np.ndarray:
        rows = len(numbers[0])
        kind = np.min_scalar_type(max(map(len, self.edges)))
        ranks = np.concatenate([np.searchsorted(e, x).astype(kind) for e, x in zip(self.edges, numbers, strict=True)])
        line, row, total = self.feature * rows, np.arange(rows), np.zeros(rows)
        for root, steps in zip(self.roots, self.steps, strict=True):
            at = np.full(rows, root)
            for _ in range(steps):
                right = ranks.take(line.take(at) + row) > self.cut.take(at)
                at = self.child.take(2 * at + right)
            total += self.value.take(at)
        return total


def read_trees(lines: Iterable[str], width: int) -> Trees | None:
    """From the description that a model of ``pyspark.ml`` gives of itself; none where it splits by category."""
    roots, weight, feature, edge, child, value = [], 1.0, [], [], [], []
    above, side, open_ = -1, 0, []
    for line in lines:
        found = LINE.fullmatch(line)
        if found is None:
            return None
        scale, asked, most, other, leaf = found.groups()
        if scale is not None:
            weight, above = float(scale), -1
        elif other is not None:
            above, side = open_.pop(), 1
        else:
            node = len(feature)
            if above < 0:
                roots.append(node)
            else:
                child[above][side] = node
            feature.append(-1 if asked is None else int(asked))
            edge.append(0.0 if asked is None else float(most))
            value.append(0.0 if leaf is None else weight * float(leaf))
            child.append([node, node])
            if asked is not None:
                open_.append(node)
                above, side = node, 0
    return Trees(roots, np.array(feature), np.array(edge), np.array(child), np.array(value), width)


def margin(df: DataFrame, model: PipelineModel) -> Column | None:
    """The margin of ``df``'s rows as a column, where the model is boosted trees over plain numbers."""
    if len(model.stages) != 2 or not isinstance(model.stages[0], VectorAssembler):
        return None
    prepare, boosted = model.stages
    columns = prepare.getInputCols()
    plain = all(isinstance(df.schema[c].dataType, NumericType | BooleanType) for c in columns)
    if not isinstance(boosted, GBTClassificationModel | GBTRegressionModel) or prepare.getHandleInvalid() != "keep" or not plain:
        return None
    if not hasattr(boosted, "_as_table"):
        boosted._as_table = read_trees(filter(str.strip, boosted.toDebugString.splitlines()[1:]), len(columns))
    trees = boosted._as_table
    if trees is None:
        return None

    def run(rows: pa.Array) -> pa.Array:
        return pa.array(trees.margins([rows.field(f).to_numpy(zero_copy_only=False) for f in range(len(columns))]))

    given = F.struct(*[F.col(f"`{c}`").cast("double").alias(f"f{at}") for at, c in enumerate(columns)])
    return F.arrow_udf(run, "double")(given)
