"""Exact contributions of boosted trees against all coalitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from riskloom.models import leaf_paths as lp
from riskloom.models.estimators import fit_logistic, fit_pd

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(1)
    x = np.round(draw.normal(size=(300, 4)), 1)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + draw.normal(size=300) * 0.3 > 0).astype(int)
    rows = [(int(i), *map(float, r), int(t), float(r[0] + r[3] ** 2)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, z double").cache()


def by_coalitions(spark, model, rows, background):
    """Shapley values from the margins of every mixture of a row and a background row."""
    fields = ", ".join(f"{c} double" for c in COLUMNS)
    subsets = [s for k in range(5) for s in itertools.combinations(range(4), k)]
    asked = [
        (r, i, *[rows[r][f] if f in s else b[f] for f in range(4)])
        for r in range(len(rows)) for i, s in enumerate(subsets) for b in background]
    frame = spark.createDataFrame([tuple(v if isinstance(v, int) else float(v) for v in a) for a in asked], f"r int, s int, {fields}")
    worth = {(w.r, w.s): w.m for w in lp.margins(frame, model).groupBy("r", "s").agg(F.avg("margin").alias("m")).collect()}
    out = np.zeros((len(rows), 4))
    for r in range(len(rows)):
        for f in range(4):
            for i, s in enumerate(subsets):
                if f not in s:
                    share = math.factorial(len(s)) * math.factorial(3 - len(s)) / 24
                    more = subsets.index(tuple(sorted((*s, f))))
                    out[r, f] += share * (worth[r, more] - worth[r, i])
    return out


def explained(model, df, background):
    found = lp.tree_contributions(df, "id", COLUMNS, background, model).collect()
    ids = sorted({r.id for r in found})
    out = np.zeros((len(ids), 4))
    for r in found:
        out[ids.index(r.id), COLUMNS.index(r.feature)] = r.contribution
    return ids, out


@pytest.fixture(scope="module")
def boosted(frame):
    return fit_pd("boosted", frame, COLUMNS, "y", maxIter=12).model


def test_agrees_with_all_coalitions(spark, frame, boosted):
    some, background = frame.where("id < 6"), frame.where("id between 100 and 119")
    ids, got = explained(boosted, some, background)
    lines = {r.id: [r[c] for c in COLUMNS] for r in some.collect()}
    want = by_coalitions(spark, boosted, [lines[i] for i in ids], [[r[c] for c in COLUMNS] for r in background.collect()])
    assert np.allclose(got, want, atol=1e-9) and np.abs(got).max() > 0.1


def test_sums_are_margins_less_the_mean(frame, boosted):
    background = frame.where("id >= 250")
    ids, got = explained(boosted, frame, background)
    margin = {r.id: r.margin for r in lp.margins(frame, boosted).collect()}
    mean = lp.margins(background, boosted).agg(F.avg("margin")).first()[0]
    assert np.allclose(got.sum(axis=1), [margin[i] - mean for i in ids], atol=1e-9)


def test_regression_and_small_steps(frame, monkeypatch):
    trees = GBTRegressor(featuresCol="f", labelCol="z", maxIter=5, maxDepth=4, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="f"), trees]).fit(frame)
    background = frame.where("id < 40")
    _, whole = explained(model, frame.where("id < 50"), background)
    table = lp.LeafTable(lp.leaf_paths(frame.sparkSession, model).orderBy("tree", "leaf").collect(),
                         np.array([[r[c] for c in COLUMNS] for r in background.collect()]))
    monkeypatch.setattr(lp, "CELLS", 1)
    rows = np.array([[r[c] for c in COLUMNS] for r in frame.where("id < 50").orderBy("id").collect()])
    assert np.allclose(table.contributions(rows), whole)
    margin = [r.margin for r in lp.margins(frame.where("id < 50"), model).orderBy("id").collect()]
    mean = lp.margins(background, model).agg(F.avg("margin")).first()[0]
    assert np.allclose(whole.sum(axis=1), np.array(margin) - mean)


def test_missing_numbers_turn_right_as_in_the_model(spark, frame, boosted):
    odd = spark.createDataFrame(
        [(1, float("nan"), 0.1, None, 9e9), (2, None, None, None, None), (3, float("inf"), float("-inf"), 0.0, 0.0)],
        "id long, a double, b double, c double, d double")
    filled = odd.select("id", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in COLUMNS])
    background = frame.where("id < 30")
    ids, got = explained(boosted, odd, background)
    margin = {r.id: r.margin for r in lp.margins(filled, boosted).collect()}
    mean = lp.margins(background, boosted).agg(F.avg("margin")).first()[0]
    assert np.allclose(got.sum(axis=1), [margin[i] - mean for i in ids])


def test_a_row_like_every_background_row_has_no_contribution(frame, boosted):
    same = frame.where("id = 7")
    assert np.allclose(explained(boosted, same, same)[1], 0)


def test_limits(frame, boosted):
    with pytest.raises(ValueError, match="more than 5"):
        lp.tree_contributions(frame, "id", COLUMNS, frame, boosted, most_background=5)
    with pytest.raises(ValueError, match="empty"):
        lp.tree_contributions(frame, "id", COLUMNS, frame.limit(0), boosted)
    with pytest.raises(ValueError, match="boosted"):
        lp.tree_contributions(frame, "id", COLUMNS, frame.limit(3), fit_logistic(frame, COLUMNS, "y", max_iter=3).model)
    assert lp.tree_contributions(frame.limit(0), "id", COLUMNS, frame.limit(3), boosted).collect() == []


def test_numbers_on_edges_keep_the_margin(spark, frame, boosted):
    holes = frame.select("id", *COLUMNS).union(spark.createDataFrame([(900, float("nan"), 1e9, -1e9, 0.0)], "id long, a double, b double, c double, d double"))
    moved = lp.on_edges(holes, boosted, COLUMNS, ["a", "b", "c"])
    was, now = ({r.id: r for r in lp.margins(d, boosted).collect()} for d in (holes, moved))
    assert was.keys() == now.keys() and all(was[i].margin == now[i].margin and was[i].d == now[i].d for i in was)
    assert max(len({r[c] for r in now.values()}) for c in ("a", "b", "c")) <= 32


def test_worth_of_coalitions_is_asked_once_for_equal_members(spark, frame, monkeypatch):
    from suite import models

    names = list(models.FEATURES)
    rng = np.random.default_rng(5)
    made = [(i, *map(float, np.round(r, 1)), int(r[0] * r[1] + r[2] > 0)) for i, r in enumerate(rng.normal(size=(200, len(names))))]
    df = spark.createDataFrame(made, "borrower_id long, " + ", ".join(f"{c} double" for c in names) + ", y int").cache()
    model, background = fit_pd("boosted", df, names, "y", maxIter=6, maxDepth=3).model, df.where("borrower_id < 8").collect()
    same = [F.lit(background[0][c]).alias(c) for c in names[4:]]
    asked, real = [], lp.margins
    monkeypatch.setattr(lp, "margins", lambda d, m: asked.append(d.count()) or real(d, m))
    rows = df.where("borrower_id between 50 and 89").select("borrower_id", *models.FOUR)
    got = {(r.borrower_id, r.feature): r.wanted for r in models.coalition_contributions(spark, rows, background, same, model).collect()}
    assert len(asked) == 1 and asked[0] < 40 * 16 * 8 / 4
    drawn = df.where("borrower_id < 8").select(*models.FOUR, *same)
    found = lp.tree_contributions(rows.select("borrower_id", *models.FOUR, *same), "borrower_id", names, drawn, model).collect()
    for r in found:
        assert abs(r.contribution - got.get((r.borrower_id, r.feature), 0.0)) < 1e-9
    assert len(got) == 160 and max(abs(v) for v in got.values()) > 0.01


def test_kept_parts_and_rows_on_all_cores(spark, frame, boosted, monkeypatch):
    background = frame.where("id < 40")
    lines = [np.array([[r[c] for c in COLUMNS] for r in d.orderBy("id").collect()]) for d in (frame, background)]
    table = lp.LeafTable(lp.leaf_paths(spark, boosted).orderBy("tree", "leaf").collect(), lines[1])
    asked, real = [], table._parts
    monkeypatch.setattr(table, "_parts", lambda pairs: asked.append(len(pairs)) or real(pairs))
    kept = [table.contributions(lines[0]) for _ in range(2)]
    assert len(asked) == 1 and np.array_equal(*kept)  # the second time all are known
    monkeypatch.setattr(lp, "PARTS", 0)
    assert np.allclose(table.contributions(lines[0]), kept[0], atol=1e-12) and len(asked) == 2
    found = lp.tree_contributions(frame.coalesce(1), "id", COLUMNS, background, boosted)
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
