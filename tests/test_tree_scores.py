import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.models import estimators, tree_scores


def rows(spark, number=400):
    rng = np.random.default_rng(2)
    made = pd.DataFrame({"i": range(number), "a": rng.normal(size=number), "b.c": rng.integers(0, 4, number), "d": rng.random(number) < 0.4})
    made["y"] = ((made["a"] + made["b.c"] * made["d"] + rng.normal(size=number)) > 1).astype(int)
    made["z"] = made["a"] ** 2 + made["d"]
    holes = F.when(F.col("i") % 7 > 0, F.when(F.col("i") % 11 > 0, F.col("a")).otherwise(float("nan")))
    return spark.createDataFrame(made).withColumn("a", holes).cache()


def test_probabilities_and_values_are_those_of_transform_and_need_none(spark, monkeypatch):
    data = rows(spark)
    plain = data.withColumnRenamed("b.c", "b_c")
    columns = ["a", "b_c", "d"]
    model = estimators.fit_boosted(plain, columns, "y", maxIter=9, maxDepth=4)
    sized = estimators.fit_direct_lgd(plain, columns, "z", maxIter=9, maxDepth=3)
    wanted = model.model.transform(plain).select("i", vector_to_array("_probability")[1].alias("p")).orderBy("i").toPandas()["p"]
    value = sized.model.transform(plain).select("i", "_value").orderBy("i").toPandas()["_value"]
    monkeypatch.setattr(type(model.model), "transform", lambda *a: 1 / 0)
    found = sized.predict(model.predict(plain, "p"), "v").orderBy("i").toPandas()
    assert np.abs(found["p"] - wanted).max() < 1e-12
    assert np.abs(found["v"] - value.clip(0, 1)).max() < 1e-12
    assert list(found.columns) == [*plain.columns, "p", "v"]


def test_trees_of_one_leaf_and_splits_by_category():
    one = tree_scores.read_trees(["  Tree 0 (weight 1.0):", "    Predict: -0.25", "  Tree 1 (weight 0.1):", "    Predict: 1.0E-3"], 2)
    assert np.allclose(one.margins([np.zeros(3), np.zeros(3)]), -0.25 + 1e-4)
    assert len(one.margins([np.zeros(0), np.zeros(0)])) == 0
    assert tree_scores.read_trees(["  Tree 0 (weight 1.0):", "    If (feature 0 in {1.0})"], 1) is None


def test_many_rows_go_down_in_parts(monkeypatch):
    lines = ["Tree 0 (weight 2.0):", " If (feature 1 <= 0.5)", "  If (feature 0 <= -1.0E-2)", "   Predict: 1.0", "  Else (feature 0 > -1.0E-2)",
             "   Predict: 2.0", " Else (feature 1 > 0.5)", "  Predict: 4.0"]
    monkeypatch.setattr(tree_scores, "ROWS", 2)
    trees = tree_scores.read_trees(lines, 2)
    found = trees.margins([np.array([-0.01, 0.0, np.nan, -5.0, 9.0]), np.array([0.5, 0.5, 0.0, np.nan, 0.6])])
    assert found.tolist() == [2.0, 4.0, 4.0, 8.0, 8.0]
