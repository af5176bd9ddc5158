import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.models import ensemble, estimators, shapley, tuning
from riskloom.operators import evaluate
from riskloom.plans import batch_scoring, training
from suite.views import LONG_REFERENCE, table

from .conftest import rows

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    p = 1 / (1 + np.exp(-(-2 + 1.5 * x[:, 0] - x[:, 1])))
    y = (rng.random(600) < p).astype(int)
    pdf = pd.DataFrame(x, columns=COLUMNS).assign(borrower_id=range(600), y=y, loss=np.where(y == 1, 0.3 + 0.1 * x[:, 2], 0))
    return spark.createDataFrame(pdf).cache()


def auc(model, data):
    scored = model.predict(data, "prob").select(F.lit("m").alias("model"), F.col("y").alias("label"), "prob")
    return rows(evaluate.rank_metrics(scored, ["model"], groups=1))[0]["auc_roc"]


@pytest.mark.parametrize("kind,params", [("logistic", {}), ("boosted_balanced", {"maxIter": 3, "maxDepth": 2}), ("crosses", {"max_iter": 15})])
def test_fit_and_round_trip(spark, data, tmp_path, kind, params):
    model = estimators.fit_pd(kind, data, COLUMNS, "y", **params)
    assert auc(model, data) > 0.6
    model.save(str(tmp_path / kind))
    again = estimators.Classifier.load(str(tmp_path / kind))
    both = [m.predict(data.limit(50), "p").orderBy("borrower_id").toPandas().p for m in (model, again)]
    assert np.array_equal(both[0], both[1]) and both[0].between(0, 1).all()


def test_unknown_model(data):
    with pytest.raises(ValueError):
        estimators.fit_pd("oracle", data, COLUMNS, "y")


def test_balanced_weights(data):
    weighted = data.withColumn("w", estimators.weight_column(data, "y"))
    sums = weighted.groupBy("y").agg(F.sum("w").alias("w")).toPandas().w
    assert sums.iloc[0] == pytest.approx(300) and sums.iloc[1] == pytest.approx(300)


def test_loss_and_exposure(data):
    lgd = estimators.fit_two_stage_lgd(data, COLUMNS, "loss", maxIter=3)
    assert lgd.predict(data).agg(F.min("lgd"), F.max("lgd")).first()[0] >= 0
    none = estimators.fit_two_stage_lgd(data.withColumn("loss", F.when(F.col("borrower_id") < 5, 0.4).otherwise(0.0)), COLUMNS, "loss")
    assert none.severity is None
    few = estimators.fit_exposure(data.limit(8).withColumn("f", F.lit(0.5)), COLUMNS, "f")
    assert few.conversion is None
    priced = few.predict(data.limit(1).select(*COLUMNS, F.lit(100.0).alias("d"), F.lit(500.0).alias("l")), "d", "l")
    assert rows(priced)[0]["ead"] == 400.0


def test_ensemble_search(spark, tmp_path):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    pdf = pd.DataFrame({"label": y, "good": np.clip(y * 0.4 + rng.random(400) * 0.6, 0, 1), "noise": rng.random(400)})
    df = spark.createDataFrame(pdf)
    weights = ensemble.search_weights(df, ["good", "noise"], steps=5, refine=2)
    assert sum(weights.values()) == pytest.approx(1.0) and weights["good"] > 0.7
    ensemble.save_weights(spark, {"good": 0.6, "noise": 0.2, "gone": 0.2}, str(tmp_path / "w"))
    assert ensemble.load_weights(spark, str(tmp_path / "w"), ["good", "noise"]) == {"good": pytest.approx(0.75), "noise": pytest.approx(0.25)}
    assert len(ensemble.weight_grid(["a", "b", "c"], 10)) == 66
    with pytest.raises(ValueError):
        ensemble.normalised({"a": 0.0})


def test_temperature(spark):
    rng = np.random.default_rng(4)
    margin = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-margin))).astype(int)
    sharp = 1 / (1 + np.exp(-3 * margin))
    df = spark.createDataFrame(pd.DataFrame({"label": y, "prob": sharp}))
    assert tuning.fit_temperature(df) == pytest.approx(3.0, rel=0.15)


def test_sampled_contributions_add_up(spark):
    weights = {"a": 2.0, "b": -1.0, "c": 0.5}
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, -1.0, 0.0, 4.0)], "k int, a double, b double, c double")
    background = spark.createDataFrame([(0.5, 0.5, 0.5)], "a double, b double, c double")
    linear = sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0))
    found = rows(shapley.sampled_contributions(df, "k", COLUMNS, background, lambda d: d.withColumn("prob", linear), 3))
    for r in found:
        own = {1: {"a": 1.0, "b": 2.0, "c": 3.0}, 2: {"a": -1.0, "b": 0.0, "c": 4.0}}[r["k"]][r["feature"]]
        assert r["value"] == own and r["contribution"] == pytest.approx(weights[r["feature"]] * (own - 0.5))
    product = F.col("a") * F.col("b") + F.col("c")
    found = rows(shapley.sampled_contributions(df, "k", COLUMNS, background, lambda d: d.withColumn("prob", product), 4))
    total = {k: sum(r["contribution"] for r in found if r["k"] == k) for k in (1, 2)}
    assert total[1] == pytest.approx(5.0 - 0.75) and total[2] == pytest.approx(4.0 - 0.75)


def test_sampled_contributions_ask_no_prediction_twice(spark):
    df = spark.range(6).select("id", *[(F.col("id") * n + 0.5 * n).alias(c) for n, c in enumerate(COLUMNS, 1)])
    background, asked = spark.createDataFrame([(0.5, -1.0, 2.0), (1.0, 0.0, 3.0)], "a double, b double, c double").coalesce(1), []

    def predict(d):
        asked.append(d.count())
        return d.withColumn("prob", F.col("a") * F.col("b") - F.col("c") * F.col("a"))

    found = rows(shapley.sampled_contributions(df, "id", COLUMNS, background, predict, 5))
    assert sorted(asked) == [2, 6, 6 * 5 * 2] and len(found) == 18
    # The same draws, with every pair of predictions asked for itself.
    other, lines = rows(background), {r["id"]: r for r in rows(df)}
    hashes = df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "id", "s", F.pmod(F.xxhash64("id", "s"), F.lit(2)).alias("row"), F.array(*[F.xxhash64("id", "s", F.lit(i)) for i in range(3)]).alias("turn"))
    wanted = {}
    for h in hashes.collect():
        mixed = dict(other[h.row])
        for i in sorted(range(3), key=lambda i: h.turn[i]):
            before = mixed["a"] * mixed["b"] - mixed["c"] * mixed["a"]
            mixed[COLUMNS[i]] = lines[h.id][COLUMNS[i]]
            change = mixed["a"] * mixed["b"] - mixed["c"] * mixed["a"] - before
            wanted[h.id, COLUMNS[i]] = wanted.get((h.id, COLUMNS[i]), 0.0) + change / 5
    assert all(r["contribution"] == pytest.approx(wanted[r["id"], r["feature"]]) and r["value"] == lines[r["id"]][r["feature"]] for r in found)
    alone = rows(shapley.sampled_contributions(df, "id", ["a"], background.select("a"), lambda d: d.withColumn("prob", 2 * F.col("a")), 3), "id")
    assert len(alone) == 6 and all(-2.0 <= 2 * r["value"] - r["contribution"] <= 2.0 for r in alone.values())


def test_training_and_batch_scoring(spark, tmp_path):
    inputs = [table(spark, FOLDER, n) for n in ("borrowers", "long_transactions", "payments")]
    small = {"maxIter": 2, "maxDepth": 2}
    run = training.train(*inputs, LONG_REFERENCE, kinds=("logistic", "boosted_balanced"),
                         params={"logistic": {"max_iter": 20}, "boosted_balanced": small, "lgd": small, "ead": small, "fraud": small})
    metrics = rows(run.pd_metrics, "model")
    assert set(metrics) == {"logistic", "boosted_balanced", "ensemble"} and metrics["ensemble"]["auc_roc"] > 0.5
    assert sum(run.weights.values()) == pytest.approx(1.0)
    assert {r["split"] for r in rows(run.splits)} == {"train", "validation", "test"}
    run.save(str(tmp_path / "run"))
    again = rows(training.reevaluate(str(tmp_path / "run"), run.matrix, ["logistic", "boosted_balanced"]), "model")
    assert again["logistic"]["auc_roc"] == pytest.approx(metrics["logistic"]["auc_roc"])

    scorer = batch_scoring.Scorer(run.features, run.pd_models, run.weights, run.lgd, run.ead, run.fraud)
    applications = inputs[0].withColumn("application_id", F.col("borrower_id"))
    scored, rejected = batch_scoring.score_applications(applications, scorer)
    assert scored.count() + rejected.count() == applications.count()
    few = scored.orderBy("application_id").limit(3).withColumn("decision", F.lit("declined"))
    notices = rows(batch_scoring.declined_reasons(scorer.matrix(applications), few, scorer, run.background, model="boosted_balanced"))
    assert len(notices) == 3 and any(n["adverse_action_reasons"] for n in notices)
    replies = batch_scoring.responses(scored)
    assert rows(batch_scoring.batch_summary(replies))[0]["total_processed"] == scored.count()
    decisions = {r["decision"] for r in rows(scored)}
    assert decisions <= {"approved", "declined", "manual_review"}

    loaded = batch_scoring.Scorer.load(spark, str(tmp_path / "run"))
    again, _ = batch_scoring.score_applications(applications, loaded)
    assert sorted(map(str, again.collect())) == sorted(map(str, scored.collect()))
    more = training.add_challenger(run, "crosses", steps=4, max_iter=10)
    assert set(more.weights) == {"logistic", "boosted_balanced", "crosses"} and sum(more.weights.values()) == pytest.approx(1.0)
    challenger = more.pd_models["crosses"]
    assert 0.1 <= challenger.temperature <= 10
    challenger.save(str(tmp_path / "challenger"))
    assert estimators.Classifier.load(str(tmp_path / "challenger")).temperature == challenger.temperature


def test_background_beyond_its_bound_raises(spark):
    background = spark.range(20).select(F.col("id").cast("double").alias("a"))
    df = spark.createDataFrame([("k", 1.0)], "k string, a double")
    with pytest.raises(ValueError, match="most_background"):
        shapley.sampled_contributions(df, "k", ["a"], background, lambda d: d.withColumn("prob", F.col("a")), 2, most_background=10)


def test_model_queries_run_at_the_operators_own_settings(spark, monkeypatch):
    from unittest.mock import MagicMock

    import suite.models as m
    from suite.registry import QUERIES

    made = {}
    for module, name in [(m.estimators, "fit_pd"), (m.estimators, "fit_two_stage_lgd"), (m.estimators, "fit_direct_lgd"), (m.estimators, "fit_exposure"),
                         (m.estimators, "fit_fraud"), (m.tuning, "tune_boosted"), (m.training, "train"), (m.training, "add_challenger"),
                         (m.shapley, "background_sample"), (m.shapley, "sampled_contributions"), (m.batch_scoring, "declined_reasons")]:
        made[name] = MagicMock()
        monkeypatch.setattr(module, name, made[name])
    monkeypatch.setattr(m.batch_scoring, "score_applications", lambda *a, **k: (MagicMock(), None))
    for name in ("_frame", "table", "materialize", "_reached", "training_table"):
        monkeypatch.setattr(m, name, MagicMock())
    monkeypatch.setattr(m, "side_by_side", lambda spark, fits: {name: fit() for name, fit in fits.items()})
    monkeypatch.setattr(m.batch_scoring, "responses", MagicMock())
    monkeypatch.setattr(m.batch_scoring, "Scorer", MagicMock())
    made["tune_boosted"].return_value = {}
    session = MagicMock()
    for name in ("fit_pd_boosted", "fit_pd_boosted_balanced", "fit_lgd_two_stage", "fit_lgd_direct", "fit_exposure", "fit_fraud", "tuned_settings",
                 "sampled_contributions", "training_run", "training_run_with_challenger", "batch_score_with_reasons"):
        QUERIES[name](session, name)
    for name, mock in made.items():
        assert mock.called, name
        for call in mock.call_args_list:
            assert not set(call.kwargs) - {"steps"}, (name, call.kwargs)
    assert all(len(c.args) == 3 for c in made["tune_boosted"].call_args_list + made["background_sample"].call_args_list)
    assert all(len(c.args) == 5 for c in made["sampled_contributions"].call_args_list)
