import math

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import evaluate, monitor

from .conftest import rows


def sample(seed, ties):
    rng = np.random.default_rng(seed)
    p = rng.random(700)
    if ties:
        p = np.round(p, 1)
    return pd.DataFrame({"model": "m", "label": (rng.random(700) < p).astype(int), "prob": p})


def auc(pdf):
    pos, neg = pdf.prob[pdf.label == 1].to_numpy(), pdf.prob[pdf.label == 0].to_numpy()
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    return wins / (len(pos) * len(neg))


def cuts(pdf):
    """(threshold, tpr - fpr) from the highest threshold down, starting above every score."""
    out = [(math.inf, 0.0)]
    p, n = (pdf.label == 1).sum(), (pdf.label == 0).sum()
    for t in sorted(pdf.prob.unique(), reverse=True):
        hit = pdf[pdf.prob >= t].label
        out.append((t, (hit == 1).sum() / p - (hit == 0).sum() / n))
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_metrics_against_brute_force(spark, ties):
    pdf = sample(5, ties)
    found = rows(evaluate.evaluate_pd(spark.createDataFrame(pdf), ["model"], groups=1))[0]
    assert found["auc_roc"] == pytest.approx(auc(pdf))
    assert found["gini"] == pytest.approx(2 * auc(pdf) - 1)
    assert found["ks_statistic"] == pytest.approx(max(abs(j) for _, j in cuts(pdf)))
    best = max(cuts(pdf), key=lambda c: round(c[1], 12))
    assert found["optimal_threshold"] == best[0]
    pred = (pdf.prob >= best[0]).astype(int)
    assert found["tp"] == ((pred == 1) & (pdf.label == 1)).sum()
    assert found["fn"] + found["tp"] + found["tn"] + found["fp"] == len(pdf)
    clipped = pdf.prob.clip(2.2e-16, 1 - 2.2e-16)
    want = -(pdf.label * np.log(clipped) + (1 - pdf.label) * np.log(1 - clipped)).mean()
    assert found["log_loss"] == pytest.approx(want)
    assert found["brier_score"] == pytest.approx(((pdf.prob - pdf.label) ** 2).mean())


def test_threshold_above_every_score(spark):
    df = spark.createDataFrame([("m", 1, 0.1), ("m", 0, 0.9)], "model string, label int, prob double")
    assert rows(evaluate.best_threshold(df, ["model"]))[0]["optimal_threshold"] == math.inf


def test_one_class_gives_null_rank_metrics(spark):
    df = spark.createDataFrame([("m", 0, 0.1), ("m", 0, 0.9)], "model string, label int, prob double")
    found = rows(evaluate.rank_metrics(df, ["model"]))[0]
    assert found["auc_roc"] is None and found["gini"] is None


@pytest.mark.parametrize("ties", [False, True])
def test_deciles_match_quantile_cut(spark, ties):
    pdf = sample(9, ties)
    pdf["decile"] = pd.qcut(pdf.prob, 10, labels=False, duplicates="drop") + 1
    want = pdf.groupby("decile").agg(n=("label", "size"), d=("label", "sum"), low=("prob", "min"), high=("prob", "max"))
    found = evaluate.decile_table(spark.createDataFrame(pdf[["model", "label", "prob"]]), ["model"]).toPandas()
    found = found.set_index("decile").sort_index()
    assert list(found.index) == list(want.index)
    assert list(found["count"]) == list(want.n) and list(found.default_count) == list(want.d)
    assert np.allclose(found.min_pd, want.low) and np.allclose(found.max_pd, want.high)


def test_deciles_of_equal_and_few_scores(spark):
    same = spark.createDataFrame([("m", i % 2, 0.5) for i in range(20)], "model string, label int, prob double")
    assert [(r["decile"], r["count"]) for r in rows(evaluate.decile_table(same, ["model"]))] == [(1, 20)]
    few = spark.createDataFrame([(1, 0.1), (0, 0.2), (1, 0.3)], "label int, prob double")
    assert sorted(r["decile"] for r in rows(evaluate.decile_table(few, []))) == [1, 2, 3]


def test_errors_without_positive_rows(spark):
    df = spark.createDataFrame([(0.0, 0.3)], "y double, p double")
    assert rows(evaluate.lgd_errors(df, [], "y", "p")) == [{"mae": 0.0, "rmse": 0.0, "r2": 0.0}]
    assert rows(evaluate.ead_errors(df, [], "y", "p")) == [{"mae": 0.0, "rmse": 0.0, "mape": 0.0}]


def test_lgd_r2(spark):
    df = spark.createDataFrame([(0.2, 0.3), (0.6, 0.5), (0.0, 0.9)], "y double, p double")
    found = rows(evaluate.lgd_errors(df, [], "y", "p"))[0]
    assert found["mae"] == pytest.approx(0.1) and found["r2"] == pytest.approx(1 - 0.02 / 0.08)


def test_report(spark):
    cells = spark.createDataFrame([(50, 10, 5, 35)], "tn long, fp long, fn long, tp long")
    found = rows(evaluate.classification_report(cells, []), "class")
    assert found["1"]["precision"] == pytest.approx(35 / 45) and found["1"]["recall"] == pytest.approx(35 / 40)
    assert found["0"]["f1"] == pytest.approx(100 / 115) and found["accuracy"]["f1"] == pytest.approx(0.85)
    assert found["macro avg"]["support"] == 100


def test_degradation(spark):
    history = spark.createDataFrame([(1, 0.80), (2, 0.60), (3, 0.76)], "t int, auc_roc double")
    assert rows(monitor.degradation(history, "t"))[0]["degraded"] is False
    assert rows(monitor.degradation(history.filter("t < 3"), "t"))[0]["degraded"] is True
    assert rows(monitor.degradation(history.filter("t = 2"), "t"))[0]["degraded"] is False
