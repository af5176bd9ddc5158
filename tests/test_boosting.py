import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from riskloom.models import boosting, estimators
from riskloom.models.side_by_side import side_by_side

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    x[:, 3] = rng.integers(0, 5, 900)
    y = (rng.random(900) < 1 / (1 + np.exp(-1.5 * x[:, 0] + x[:, 1] * x[:, 3]))).astype(int)
    made = pd.DataFrame(x, columns=COLUMNS).assign(i=range(900), y=y, z=x[:, 0] ** 2 + x[:, 3], _weight=1.0 + 2.0 * y)
    return spark.createDataFrame(made).coalesce(1).cache()


def values(model, data, column):
    found = model.transform(data).orderBy("i").select(column).toPandas()[column]
    return np.array([v.toArray()[1] if hasattr(v, "toArray") else v for v in found])


def with_spark(pipeline):
    prepare, trees = pipeline.getStages()
    return Pipeline(stages=[prepare, trees.trees])


@pytest.mark.parametrize("weighted", [False, True])
def test_same_trees_as_spark_where_nothing_is_drawn(data, weighted):
    whole = {"subsamplingRate": 1.0, "featureSubsetStrategy": "all", "maxIter": 6, "maxDepth": 4, "minInstancesPerNode": 3}
    pipeline = estimators.boosted_classifier(COLUMNS, "y", weighted, **whole)
    made, wanted = (values(p.fit(data), data, "_margin") for p in (pipeline, with_spark(pipeline)))
    # Not all: sums in another order may tip equal gains.
    assert (np.abs(made - wanted) < 1e-9).mean() > 0.98
    assert np.corrcoef(made, wanted)[0, 1] > 0.999


def test_same_regression_as_spark(data):
    pipeline = estimators.boosted_regressor(COLUMNS, "z", maxIter=8, maxDepth=3)
    made, wanted = (values(p.fit(data), data, "_value") for p in (pipeline, with_spark(pipeline)))
    assert (np.abs(made - wanted) < 1e-9).mean() > 0.98


def test_several_tasks_grow_the_trees_of_one(data, monkeypatch):
    pipeline = estimators.boosted_regressor(COLUMNS, "z", maxIter=8, maxDepth=3)
    alone = values(pipeline.fit(data), data, "_value")
    monkeypatch.setattr(boosting, "TASK_CELLS", 1200)
    monkeypatch.setattr(boosting, "MESSAGE", 100)
    assert (np.abs(values(pipeline.fit(data), data, "_value") - alone) < 1e-9).mean() > 0.98


def test_draws_repeat_and_the_number_of_jobs_does_not_grow_with_trees(spark, data):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    jobs, found = [], []
    for trees in (3, 30, 30):
        pipeline = estimators.boosted_classifier(COLUMNS, "y", False, maxIter=trees, maxDepth=3)
        context.setJobGroup(f"boost-{len(jobs)}", "")
        found.append(values(pipeline.fit(data), data, "_margin"))
        jobs.append(len(tracker.getJobIdsForGroup(f"boost-{len(jobs)}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2
    assert np.array_equal(found[1], found[2]) and not np.array_equal(found[0], found[1])


def test_missing_numbers_and_bad_labels(data):
    pipeline = estimators.boosted_classifier(COLUMNS, "y", False, maxIter=2, maxDepth=2)
    holes = data.withColumn("a", F.when(F.col("i") % 3 > 0, F.col("a")))
    assert np.isfinite(values(pipeline.fit(holes), holes, "_margin")).all()
    for bad in (data.limit(0), data.withColumn("y", F.col("y") * 2)):
        with pytest.raises(ValueError):
            pipeline.fit(bad)


def test_feature_number():
    assert [boosting.feature_number(s, 14) for s in ("all", "0.8", "1.000", "3", "99")] == [14, 12, 14, 3, 14]
    with pytest.raises(ValueError):
        boosting.feature_number("some", 14)


def test_margins_of_held_rows_are_those_of_the_model(spark, data, tmp_path):
    prepare, trees = estimators.boosted_classifier(COLUMNS, "y", False, maxIter=7, maxDepth=4).getStages()
    held = F.col("i") % 3 == 0
    trees.write_margins(prepare.transform(data), held, str(tmp_path / "margins"))
    found = spark.read.parquet(str(tmp_path / "margins")).toPandas()["margin"]
    model = Pipeline(stages=[prepare, trees]).fit(data.where(~held))
    assert np.allclose(sorted(found), sorted(values(model, data.where(held), "_margin")), atol=1e-12)


def test_only_the_smaller_child_is_counted(monkeypatch):
    class Alone:
        number, context = 1, type("", (), {"partitionId": staticmethod(lambda: 0)})

        def total(self, numbers):
            return numbers

    rng, counted = np.random.default_rng(3), []
    x, settings = rng.normal(size=(4000, 4)), boosting.Settings(1, 5, 0.1, 1.0, 4, 32, 1, 0.0, 1, False, True)
    y, weight, real = x[:, 0] * x[:, 1] + x[:, 2], 1.0 + (x[:, 3] > 0), boosting.Forest._histograms

    def watched(self, codes, slot, *rest):
        counted.append(len(slot))
        return real(self, codes, slot, *rest)

    monkeypatch.setattr(boosting.Forest, "_histograms", watched)
    forest = boosting.Forest(x, y, weight, settings, Alone())
    nodes = next(forest.grow())
    assert counted[0] == 4000 and len(counted) == 5 and max(counted[1:]) <= 2000
    # Rows and weights of children add up to their parent's, as counted from the rows.
    inner = np.flatnonzero(nodes["left"] >= 0)
    left, right = nodes["left"][inner], nodes["left"][inner] + 1
    assert np.array_equal(nodes["rows"][left] + nodes["rows"][right], nodes["rows"][inner])
    both = np.array([forest.codes[f] <= c for f, c in zip(nodes["feature"][:1], nodes["cut"][:1])])[0]
    assert nodes["rows"][left[0]] == both.sum() and np.isclose(nodes["stats"][left[0], 0], forest.weight[both].sum())


def test_tasks_that_share_the_rows_do_not_wait_a_second_a_level(spark, data, monkeypatch, tmp_path):
    """48 levels, which took as many seconds by the exchange of a barrier stage; rows held back get the margins of one task."""
    monkeypatch.setattr(boosting, "ADDED", 5)
    settings = {"maxIter": 12, "maxDepth": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    prepare, trees = estimators.boosted_classifier(COLUMNS, "y", True, **settings).getStages()
    prepared, held, found = prepare.transform(data), F.col("i") % 3 == 0, []
    for cells in (boosting.TASK_CELLS, 1200):
        monkeypatch.setattr(boosting, "TASK_CELLS", cells)
        begun = time.monotonic()
        trees.write_margins(prepared, held, str(tmp_path / str(cells)))
        found.append(spark.read.parquet(str(tmp_path / str(cells))).toPandas().sort_values(["label", "margin"]).to_numpy())
    assert time.monotonic() - begun < 40
    assert found[0].shape == found[1].shape == (300, 2) and set(found[1][:, 0]) == {0.0, 1.0}
    assert (np.abs(found[0] - found[1]) < 1e-9).all(axis=1).mean() > 0.98


def test_features_counted_at_once_have_the_histograms_of_each(monkeypatch):
    """Also: rows left out of a tree's draw come to their leaf with the others, no tree is walked again for the margins."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(9000, 3)), rng.integers(0, 5, (9000, 2)), rng.random((9000, 9)) < 0.3, np.ones(9000)]).astype(float)
    y, weight = (x[:, 0] * x[:, 1] + x[:, 3] + x[:, 7] > 1.5).astype(float), rng.integers(1, 4, 9000).astype(float)
    settings = boosting.Settings(4, 5, 0.1, 0.7, 12, 32, 2, 0.0, 7, True, True)
    forest = boosting.Forest(x, y, weight, settings, boosting.Peers())
    assert sorted(sum(forest.bundles, [])) == list(range(15)) and len(forest.bundles) < 7
    slot, picked, value = rng.integers(0, 3, 6000), np.sort(rng.choice(9000, 6000, replace=False)), rng.normal(size=6000)
    alone = forest._histograms(forest.codes, slot, value, weight[picked], 3, picked)
    together = forest._histograms(forest.codes, slot, value, weight[picked], 3, picked, forest.packed)
    for a, b in zip(alone, together, strict=True):
        assert np.allclose(a[:, forest.held], b[:, forest.held], atol=1e-9)
    assert np.array_equal(alone[0][:, forest.held], together[0][:, forest.held])

    walked, real = [], boosting._ends
    monkeypatch.setattr(boosting, "_ends", lambda *a: walked.append(1) or real(*a))
    grown = list(forest.grow())
    assert not walked
    wanted = sum(forest.step(tree) * boosting._values(nodes, forest.codes) for tree, nodes in enumerate(grown))
    assert np.allclose(forest.margin, wanted, atol=1e-12)


def test_a_fit_among_many_deals_no_rows(spark, data, monkeypatch, tmp_path):
    """The table stays where it is; 60 fits would write it out 60 times."""
    prepare, trees = estimators.boosted_classifier(COLUMNS, "y", False, maxIter=2, maxDepth=2).getStages()
    monkeypatch.setattr(type(data), "repartition", lambda *a: 1 / 0)
    trees.write_margins(prepare.transform(data), F.col("i") % 3 == 0, str(tmp_path / "margins"))
    assert spark.read.parquet(str(tmp_path / "margins")).count() == 300


def test_a_fit_beside_others_is_one_task_where_a_lone_one_is_dealt(spark, data, monkeypatch):
    pipeline, dealt, real = estimators.boosted_regressor(COLUMNS, "z", maxIter=2, maxDepth=2), [], boosting.BoostedTrees._dealt
    monkeypatch.setattr(boosting.BoostedTrees, "_dealt", lambda *a: dealt.append(1) or real(*a))
    monkeypatch.setattr(boosting, "TASK_CELLS", 1200)
    side_by_side(spark, {"a": lambda: pipeline.fit(data), "b": lambda: pipeline.fit(data)})
    assert not dealt and 49_000_000 <= boosting.BESIDE_CELLS
    side_by_side(spark, {"a": lambda: pipeline.fit(data)})
    assert len(dealt) == 1
