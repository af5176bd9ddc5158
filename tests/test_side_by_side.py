"""Fits at the same time give what they give one after another."""

import threading

import pytest
from pyspark.sql import functions as F

from riskloom.models import side_by_side as sbs
from riskloom.models import tuning
from riskloom.models.estimators import fit_pd
from riskloom.plans import batch_scoring, training

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def frame(spark):
    base = spark.range(240).select(
        F.col("id").alias("borrower_id"), ((F.col("id") * 37) % 101 / 101.0).alias("a"), ((F.col("id") * 53) % 97 / 97.0).alias("b"))
    return base.withColumn("y", ((F.col("a") + F.col("b") * F.col("b")) > 0.9).cast("int")).cache()


def test_all_are_begun_and_named_by_their_pools(spark):
    both = threading.Barrier(3, timeout=60)

    def work(n):
        both.wait()  # passes only if all three run at once
        return n, spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.range(n).count()

    got = sbs.side_by_side(spark, {f"p{n}": lambda n=n: work(n) for n in range(3)}, at_once=3)
    assert got == {f"p{n}": (n, f"p{n}", n) for n in range(3)} and list(got) == ["p0", "p1", "p2"]
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert sbs.side_by_side(spark, {}) == {}


def test_one_at_a_time_and_errors(spark):
    running, most = [], []

    def work(n):
        running.append(n)
        most.append(len(running))
        running.remove(n)
        if n == 2:
            raise KeyError("no such column")
        return n

    fits = {str(n): lambda n=n: work(n) for n in range(4)}
    with pytest.raises(KeyError, match="no such column"):
        sbs.side_by_side(spark, fits, at_once=1)
    assert most == [1, 1, 1, 1]  # the others still ended


def test_training_table_has_few_partitions(spark, frame, monkeypatch):
    wide = frame.repartition(16)
    table = sbs.training_table(wide)
    assert table.rdd.getNumPartitions() == 1 and table.is_cached
    assert sorted(table.collect()) == sorted(wide.collect())
    monkeypatch.setattr(sbs, "PARTITION_CELLS", 100)
    assert sbs.training_table(wide).rdd.getNumPartitions() > 1
    assert sbs.training_table(frame.limit(0)).count() == 0


def test_models_equal_those_fitted_alone(spark, frame):
    kinds = {"boosted": {"maxIter": 3}, "logistic": {"max_iter": 20}, "boosted_balanced": {"maxIter": 2}}
    fits = {k: lambda k=k, p=p: fit_pd(k, frame, COLUMNS, "y", **p) for k, p in kinds.items()}
    together = sbs.side_by_side(spark, fits)
    for kind, params in kinds.items():
        alone = fit_pd(kind, frame, COLUMNS, "y", **params)
        both = together[kind].predict(alone.predict(frame, "p"), "q")
        assert both.where("abs(p - q) > 1e-12").count() == 0


def test_tuning_takes_the_best_mean_over_the_folds(spark, frame):
    settings = [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 6, "maxDepth": 4}, {"maxIter": 6, "maxDepth": 4}]
    assert tuning.tune_boosted(frame, COLUMNS, "y", settings) is settings[1]
    folds = [(frame, frame)] * 2
    scores = sbs.mean_scores(spark, folds, lambda fold, s: float(s["maxDepth"] + fold[0].count()), settings, at_once=2)
    assert scores == [241.0, 244.0, 244.0]


def test_folds_split_the_table(frame):
    found = sbs.fold_tables(frame.withColumn("fold", F.col("borrower_id") % 3), "fold", 3)
    for train, held in found:
        assert train.count() == 160 and held.count() == 80 and "fold" not in train.columns
        assert train.join(held, "borrower_id").count() == 0
