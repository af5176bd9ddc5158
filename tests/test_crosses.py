import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.models import crosses, estimators

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = (rng.random(600) < 1 / (1 + np.exp(1.5 - x[:, 0] - 2 * x[:, 1] * x[:, 2]))).astype(int)
    return spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(y=y, i=range(600))).coalesce(2).cache()


def prepared(df):
    return VectorAssembler(inputCols=COLUMNS, outputCol="x").transform(df)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    x, y, w, now = rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float), rng.integers(1, 4, 40).astype(float), rng.normal(size=10)

    def loss(p):
        v = p[4:].reshape(3, 2)
        margin = np.array([p[0] + r @ p[1:4] + sum((v[i] @ v[j]) * r[i] * r[j] for i in range(3) for j in range(i)) for r in x])
        return (w * (np.log1p(np.exp(margin)) - y * margin)).sum()

    found = crosses.gradient(x, y, w, now[0], now[1:4], now[4:].reshape(3, 2))
    steps = 1e-6 * np.eye(10)
    assert np.allclose(found[:-1], [(loss(now + s) - loss(now - s)) / 2e-6 for s in steps], atol=1e-4) and found[-1] == w.sum()


def test_linear_terms_are_those_of_spark_where_no_factor_is_drawn(data):
    """Without factors to begin with, nothing is drawn and they stay zero: both take the same steps. Weights are copies."""
    machine = FMClassifier(featuresCol="x", labelCol="y", factorSize=2, initStd=1e-300, maxIter=30, stepSize=0.1, seed=1)
    weighted = prepared(data).withColumn("w", F.col("y") * 2 + 1)
    wanted = machine.fit(weighted.withColumn("copy", F.explode(F.sequence(F.lit(1), "w"))))
    found = crosses.WeightedMachine(machine, 3, "w").fit(weighted)
    assert np.allclose(found.linear.toArray(), wanted.linear.toArray(), atol=1e-9) and np.isclose(found.intercept, wanted.intercept, atol=1e-9)


def test_crosses_are_learned_saved_and_loaded(data, tmp_path, monkeypatch):
    monkeypatch.setattr(crosses, "BLOCK", 70)
    monkeypatch.setattr(crosses, "BLOCKS_CELLS", 600)
    model = estimators.fit_crosses(data, COLUMNS, "y", factors=3, max_iter=60)
    scored = model.predict(data).toPandas().sort_values("i")
    order = scored["pd"].rank()
    ones = scored["y"] == 1
    auc = (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.8  # 0.7 without the cross of b and c
    model.save(str(tmp_path / "m"))
    loaded = estimators.Classifier.load(str(tmp_path / "m"))
    assert np.array_equal(loaded.predict(data).toPandas().sort_values("i")["pd"], scored["pd"])
    with pytest.raises(ValueError):
        estimators.fit_crosses(data.withColumn("y", F.col("y") * 2), COLUMNS, "y")
