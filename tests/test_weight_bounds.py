"""The weight search by bounds finds what ranking every candidate finds."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.models import ensemble
from riskloom.operators.evaluate import rank_metrics


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, a double, b double, c double")


def made(seed, n=400, digits=3):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(draw.random() < 0.2)
        rows.append((y, *(round(min(1.0, max(0.0, draw.gauss(0.1 + s * y, 0.08))), digits) for s in (0.08, 0.05, 0.0))))
    return rows


def everything(df, grid):
    scored = {r["candidate"]: r["auc_roc"] for r in ensemble.weight_metrics(df, grid).collect()}
    return scored, grid[max(scored, key=lambda i: (scored[i], -i))]


@pytest.mark.parametrize("seed,digits,buckets", [(1, 3, 4096), (2, 1, 4096), (3, 3, 4)])
def test_same_winner_as_ranking_all(spark, monkeypatch, seed, digits, buckets):
    monkeypatch.setattr(ensemble, "BUCKETS", buckets)
    df, grid = frame(spark, made(seed, digits=digits)).cache(), ensemble.weight_grid(["a", "b", "c"], 5)
    scored, best = everything(df, grid)
    bounds = {r["candidate"]: r for r in ensemble.auc_bounds(df, grid).collect()}
    assert all(bounds[i]["lower"] <= v + 1e-12 and v <= bounds[i]["upper"] + 1e-12 for i, v in scored.items())
    left = ensemble.promising(df, grid)
    assert grid.index(best) in left and (buckets < 10 or len(left) < len(grid))
    assert ensemble.search_weights(df, ["a", "b", "c"], steps=5, refine=0) == pytest.approx(best)


def test_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    df = frame(spark, [(1, nan, 0.5, 0.1), (0, -inf, 0.2, 0.2), (1, inf, 2.0, 0.3), (0, 0.0, -1.0, 0.4), (1, None, 0.1, 0.5), (None, 1.0, 0.6, 0.6)])
    for model in "abc":
        grid = [{model: 1.0}]
        exact = ensemble.weight_metrics(df, grid).first()["auc_roc"]
        found = ensemble.auc_bounds(df, grid).first()
        assert found["lower"] - 1e-12 <= exact <= found["upper"] + 1e-12


def test_one_class_or_no_rows_give_equal_weights(spark):
    for rows in ([], [(1, 0.1, 0.2, 0.3), (1, 0.4, 0.5, 0.6)]):
        assert ensemble.search_weights(frame(spark, rows), ["a", "b", "c"]) == pytest.approx({m: 1 / 3 for m in "abc"})


def test_rows_of_one_file_are_counted_by_all_cores(spark, monkeypatch):
    """One task counted each row once per candidate; bounds and ranks of chunks are those of plain Spark."""
    monkeypatch.setattr(ensemble, "CHUNK", 50)
    rows = [*made(5), (1, None, 0.2, 0.1), (0, 0.4, 0.3, float("nan")), (None, 0.3, 0.3, 0.3)]
    df, grid = frame(spark, rows).coalesce(1), ensemble.weight_grid(["a", "b", "c"], 4)
    counted = ensemble._counts(df, grid, "label", "prob", lambda p: p)
    assert counted.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {r["n"] for r in counted.groupBy("candidate").agg(F.sum("rows").alias("n")).collect()} == {len(rows) - 1}
    fanned = df.select("label", F.inline(F.array(*[
        F.struct(F.lit(i).alias("candidate"), ensemble.combine(w).alias("prob")) for i, w in enumerate(grid)])))
    wanted = {r["candidate"]: r["auc_roc"] for r in rank_metrics(fanned, ["candidate"]).collect()}
    assert {r["candidate"]: r["auc_roc"] for r in ensemble.weight_metrics(df, grid).collect()} == wanted
    for r in ensemble.auc_bounds(df, grid).collect():
        assert r["lower"] <= wanted[r["candidate"]] + 1e-12 and wanted[r["candidate"]] <= r["upper"] + 1e-12
