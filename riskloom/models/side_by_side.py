"""Independent fits at the same time, over one small table that is read once."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_folder
from .boosting import FITS

T = TypeVar("T")
PARTITION_CELLS = 1 << 22  # numbers of the training table in one partition


def training_table(df: DataFrame, purpose: str = "training-table") -> DataFrame:
    """``df`` written once in as few partitions as its size asks for, and kept in memory.

    A tree level is a job over the whole table: with a task per few rows the time goes into scheduling.
    Unpersist it after the fits.
    """
    written = materialize(df, purpose)
    cells = written.count() * len(df.columns)
    return written.coalesce(max(1, -(-cells // PARTITION_CELLS))).persist()


def _keep_checkpoints(spark: SparkSession) -> None:
    """Boosting cuts its growing lineage every few trees, but only into a checkpoint folder the context knows."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark, "fits"))


def side_by_side(spark: SparkSession, fits: dict[str, Callable[[], T]], at_once: int | None = None) -> dict[str, T]:
    """Results of the named fits, each run by a thread of its own, ``at_once`` of them at most (one per core).

    Each name is a scheduler pool: with ``spark.scheduler.mode`` FAIR, as ``build_session`` sets it, the jobs of a short fit
    don't wait for those of a long one. Results do not depend on the order. The first error is raised
    when the fits already begun have ended.
    """
    _keep_checkpoints(spark)
    context = spark.sparkContext

    def run(name: str, fit: Callable[[], T]) -> T:
        context.setLocalProperty("spark.scheduler.pool", name)
        context.setLocalProperty(FITS, str(limit))
        return fit()

    limit = max(1, min(len(fits), at_once or context.defaultParallelism))
    with ThreadPoolExecutor(limit) as threads:
        begun = {name: threads.submit(inheritable_thread_target(spark)(run), name, fit) for name, fit in fits.items()}
    return {name: done.result() for name, done in begun.items()}


def mean_scores(spark: SparkSession, folds: list, score: Callable, settings: list[dict], at_once: int | None = None) -> list[float]:
    """Mean of ``score(fold, setting)`` over ``folds`` for each setting, all pairs side by side."""
    fits = {f"{s}-{f}": lambda s=s, f=f: score(folds[f], settings[s]) for s in range(len(settings)) for f in range(len(folds))}
    found = side_by_side(spark, fits, at_once)
    return [sum(found[f"{s}-{f}"] for f in range(len(folds))) / len(folds) for s in range(len(settings))]


def fold_tables(df: DataFrame, fold: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """Training and validation table of each fold, from one written table."""
    whole = training_table(df, "folds")
    return [(whole.filter(F.col(fold) != f).drop(fold), whole.filter(F.col(fold) == f).drop(fold)) for f in range(folds)]
