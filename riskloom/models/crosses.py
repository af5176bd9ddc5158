"""Factorisation machines for classes, with row weights.

``pyspark.ml`` works out the gradient row by row and knows no weights, so that rows had to be repeated. Here the rows lie
in blocks of numbers in the memory of the tasks, and an iteration is one job that adds up the gradients of the blocks. Loss,
steps (AdamW) and end are those of ``pyspark.ml``, and the result is its model class; only the first factors are drawn otherwise.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, MatrixUDT, Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import shared_folder

BLOCK = 1 << 14  # rows in a block
BLOCKS_CELLS = 1 << 18  # numbers a task takes at least, where there are more cores than that


def gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, intercept: float, linear: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Of the summed loss of a block: by intercept, linear terms and factors; then the weight of its rows."""
    inner, squares = x @ factors, x * x
    margin = intercept + x @ linear + 0.5 * ((inner**2).sum(axis=1) - squares @ (factors**2).sum(axis=1))
    with np.errstate(over="ignore"):
        pull = weight * (1 / (1 + np.exp(-margin)) - y)
    crossed = x.T @ (pull[:, None] * inner) - (squares.T @ pull)[:, None] * factors
    return np.concatenate([[pull.sum()], x.T @ pull, crossed.ravel(), [weight.sum()]])


class WeightedMachine(Estimator):
    """Fits what ``machine`` asks for on ``width`` features; ``weight`` names a column that says how often a row counts."""

    def __init__(self, machine: FMClassifier, width: int, weight: str):
        super().__init__()
        if machine.getSolver() != "adamW" or machine.getRegParam() or machine.getMiniBatchFraction() != 1:
            raise ValueError("only the solver adamW over all rows, without a penalty")
        self.machine, self.width, self.weight = machine, width, weight

    def _fit(self, dataset: DataFrame) -> FMClassificationModel:
        spark, machine, width, size = dataset.sparkSession, self.machine, self.width, self.machine.getFactorSize()
        given = dataset.select(
            vector_to_array(machine.getFeaturesCol()).alias("x"), F.col(machine.getLabelCol()).cast("double").alias("y"),
            F.col(self.weight).cast("double").alias("w"))
        found = given.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False))).alias("valid")).first()
        if not found["rows"] or found["rows"] != found["valid"]:
            raise ValueError(f"{found['rows']} rows to learn from, {found['valid']} of them with a valid label")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                y, w = (batch.column(at).to_numpy(zero_copy_only=False) for at in (1, 2))
                for at in range(0, len(y), BLOCK):
                    part = np.concatenate([x[at * width : (at + BLOCK) * width], y[at : at + BLOCK], w[at : at + BLOCK]])
                    yield pa.RecordBatch.from_arrays([pa.array([part.astype(float).tobytes()], pa.binary())], ["block"])

        def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            numbers = np.frombuffer(bytes(row["block"]))
            rows = len(numbers) // (width + 2)
            x, y, w = np.split(numbers, [rows * width, rows * width + rows])
            return x.reshape(rows, width), y, w

        tasks = max(1, min(spark.sparkContext.defaultParallelism, ceil(found["rows"] * width / BLOCKS_CELLS)))
        dealt = given.repartition(tasks).mapInArrow(pack, "block binary")
        blocks = dealt.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            learned = self._steps(blocks, size)
        finally:
            blocks.unpersist()
        return self._model(spark, learned, size)

    def _steps(self, blocks, size: int) -> np.ndarray:
        m, width = self.machine, self.width
        start = np.random.default_rng(m.getSeed() & (1 << 63) - 1).normal(0.0, m.getInitStd(), width * size)
        now = np.concatenate([np.zeros(1 + width), start])
        first, second = np.zeros(len(now)), np.zeros(len(now))
        fitted = np.concatenate([[m.getFitIntercept()], np.full(width, m.getFitLinear()), np.ones(width * size, bool)])
        for step in range(1, m.getMaxIter() + 1):
            held = now

            def total(part: Iterator[tuple], held: np.ndarray = held) -> Iterator[np.ndarray]:
                parts = held[0], held[1 : 1 + width], held[1 + width :].reshape(width, size)
                yield sum((gradient(*block, *parts) for block in part), np.zeros(len(held) + 1))

            sums = np.add.reduce(blocks.mapPartitions(total).collect())
            if not sums[-1]:
                break
            slope = np.where(fitted, sums[:-1] / sums[-1], 0.0)
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            moved = m.getStepSize() * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            now = held - np.where(fitted, moved, 0.0)
            if np.linalg.norm(now - held) < m.getTol() * max(np.linalg.norm(now), 1.0):
                break
        return now

    def _model(self, spark, learned: np.ndarray, size: int) -> FMClassificationModel:
        """The model class of ``pyspark.ml``, from its saved form around the numbers."""
        width, path = self.width, shared_folder(spark, "machine")
        factors = DenseMatrix(width, size, learned[1 + width :].reshape(width, size).ravel(order="F").tolist())
        schema = StructType([StructField("intercept", DoubleType()), StructField("linear", VectorUDT()), StructField("factors", MatrixUDT())])
        row = (float(learned[0]), Vectors.dense(learned[1 : 1 + width].tolist()), factors)
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/data")
        whole = {
            "class": "org.apache.spark.ml.classification.FMClassificationModel", "timestamp": int(time.time() * 1000),
            "sparkVersion": spark.version, "uid": self.machine.uid,
            "paramMap": {p.name: v for p, v in self.machine._paramMap.items()},
            "defaultParamMap": {p.name: v for p, v in self.machine._defaultParamMap.items()}}
        spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        return FMClassificationModel.load(path)
