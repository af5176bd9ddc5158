"""Model fitting, calibration, search and the end-to-end jobs.

Fits are checked by floors of their metrics, contributions by their sums and by all coalitions; the rest is plain SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.models import ensemble, estimators, leaf_paths, shapley, tuning
from riskloom.models.side_by_side import side_by_side, training_table
from riskloom.operators import evaluate, profile, split
from riskloom.plans import batch_scoring, training
from riskloom.session import materialize, shared_folder, spread

from .evaluation import _OWN_EAD, _SPLIT, MODELS
from .explanation import FEATURES
from .registry import query, rounded
from .views import LONG_REFERENCE, table, with_views

TEMPERATURES = [0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0]

_LOGIT = "ln(least(greatest(rough_pd, 1e-7), 1 - 1e-7) / (1 - least(greatest(rough_pd, 1e-7), 1 - 1e-7)))"


@query(
    "temperature_losses",
    with_views(
        ["scored"],
        f"""
WITH t AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in TEMPERATURES)}]) AS temperature),
q AS (SELECT temperature, is_default AS y, least(greatest(1 / (1 + exp(-{_LOGIT} / temperature)), 1e-7), 1 - 1e-7) AS q
  FROM scored CROSS JOIN t)
SELECT temperature, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS nll FROM q GROUP BY temperature""",
    ),
)
def _(spark, folder):
    return rounded(tuning.temperature_losses(table(spark, folder, "scored"), TEMPERATURES, "is_default", "rough_pd"))


@query(
    "calibrated_probability",
    with_views(["scored"], f"SELECT borrower_id, round(1 / (1 + exp(-{_LOGIT} / 1.5)), 6) AS pd FROM scored"),
)
def _(spark, folder):
    return rounded(
        table(spark, folder, "scored").select("borrower_id", tuning.calibrated(F.col("rough_pd"), 1.5).alias("pd"))
    )


_GRID_LOSS = f"""
WITH t AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in TEMPERATURES)}]) AS temperature),
q AS (SELECT temperature, is_default AS y, least(greatest(1 / (1 + exp(-{_LOGIT} / temperature)), 1e-7), 1 - 1e-7) AS q
  FROM scored CROSS JOIN t),
l AS (SELECT temperature, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS nll FROM q GROUP BY temperature)
SELECT round(max(nll) FILTER (temperature = 1), 6) AS uncalibrated, true AS not_above_grid FROM l"""


@query("fitted_temperature", with_views(["scored"], _GRID_LOSS))
def _(spark, folder):
    """The loss of the fitted temperature is below that of every temperature of the grid."""
    scored = table(spark, folder, "scored")
    best = tuning.fit_temperature(scored, "is_default", "rough_pd")
    losses = tuning.temperature_losses(scored, [*TEMPERATURES, best], "is_default", "rough_pd")
    fitted = F.abs(F.col("temperature") - best) < 1e-12
    return rounded(losses.agg(
        F.max(F.when(F.col("temperature") == 1.0, F.col("nll"))).alias("uncalibrated"),
        (F.min(F.when(fitted, F.col("nll"))) <= F.min("nll") + 1e-9).alias("not_above_grid"),
    ))


@query(
    "exposure_without_model",
    with_views(["scored"], f"SELECT borrower_id, round({_OWN_EAD}, 6) AS ead FROM scored"),
)
def _(spark, folder):
    scored = table(spark, folder, "scored")
    model = estimators.ExposureModel(None)
    predicted = model.predict(scored, "current_credit_balance", "total_credit_limit")
    return rounded(predicted.select("borrower_id", "ead"))


_MADE: dict[tuple, object] = {}


def _once(name: str, spark, folder: str, make):
    """Build per session and folder once: several queries look at the same fitted models."""
    key = (name, spark.sparkContext.applicationId, folder)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _frame(spark, folder):
    """Profile features, labels and a split, written once for the fits."""
    return _once("frame", spark, folder, lambda: _make_frame(spark, folder))


def _make_frame(spark, folder):
    borrowers = table(spark, folder, "borrowers")
    kept = ["is_default", "is_fraud", "lgd_value", "ead_value", "current_credit_balance", "total_credit_limit"]
    filled = profile.borrower_features(borrowers, keep=kept).select(
        "borrower_id", *kept, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES]
    )
    return materialize(split.stratified_split(filled, "is_default"), "frame")


def _test_scores(spark, folder, kind):
    frame = _frame(spark, folder)
    train = frame.filter("split = 'train'")
    model = _boosted(spark, folder, FEATURES) if kind == "boosted" else estimators.fit_pd(kind, train, FEATURES, "is_default")
    scored = model.predict(frame.filter("split = 'test'"), "prob")
    return scored.select("borrower_id", F.col("is_default").alias("label"), "prob")


def _reached(scores, kind: str, floor: float):
    """One row: rows scored, all probabilities in [0, 1], and the floors of AUC and KS reached."""
    metrics = evaluate.evaluate_pd(scores.withColumn("model", F.lit(kind)), ["model"])
    counts = scores.agg(F.count("prob").alias("rows"), F.every(F.col("prob").between(0.0, 1.0)).alias("in_unit"))
    return metrics.join(F.broadcast(counts), F.lit(True)).select(
        "model", "rows", "in_unit", (F.col("auc_roc") >= floor).alias("auc_reached"),
        (F.col("ks_statistic") > KS_FLOOR).alias("ks_reached"))


KS_FLOOR = 0.10
_REACHED = """
SELECT '{kind}' AS model, sum(floor(n * 0.2 + 0.5))::BIGINT AS rows, true AS in_unit, true AS auc_reached, true AS ks_reached
FROM (SELECT count(*) AS n FROM borrowers GROUP BY is_default)"""

for _kind, _floor in [("logistic", 0.55), ("boosted", 0.60), ("boosted_balanced", 0.60), ("crosses", 0.55)]:

    @query(f"fit_pd_{_kind}", with_views(["borrowers"], _REACHED.format(kind=_kind)))
    def _(spark, folder, kind=_kind, floor=_floor):
        return _reached(_test_scores(spark, folder, kind), kind, floor)


@query("fit_lgd_two_stage")
def _(spark, folder):
    frame = _frame(spark, folder)
    model = estimators.fit_two_stage_lgd(frame.filter("split = 'train'"), FEATURES, "lgd_value")
    return model.predict(frame.filter("split = 'test'")).select("borrower_id", "lgd_value", "lgd")


@query("fit_lgd_direct")
def _(spark, folder):
    frame = _frame(spark, folder)
    model = estimators.fit_direct_lgd(frame.filter("split = 'train'"), FEATURES, "lgd_value")
    return model.predict(frame.filter("split = 'test'"), "lgd").select("borrower_id", "lgd_value", "lgd")


@query("fit_exposure")
def _(spark, folder):
    drawn, limit = "current_credit_balance", "total_credit_limit"
    factor = profile.conversion_label(F.col("ead_value"), F.col(drawn), F.col(limit))
    frame = _frame(spark, folder).withColumn("conversion", factor)
    model = estimators.fit_exposure(frame.filter("split = 'train'"), FEATURES, "conversion")
    return model.predict(frame.filter("split = 'test'"), drawn, limit).select("borrower_id", "ead_value", "ead")


@query("fit_fraud")
def _(spark, folder):
    frame = _frame(spark, folder)
    model = estimators.fit_fraud(frame.filter("split = 'train'"), FEATURES, "is_fraud")
    return model.predict(frame.filter("split = 'test'"), "fraud_score").select("borrower_id", "is_fraud", "fraud_score")


@query("model_round_trip", with_views(["borrowers"], "SELECT borrower_id, true AS equal FROM borrowers"))
def _(spark, folder):
    """A saved and loaded model gives every borrower the same probability."""
    frame = _frame(spark, folder)
    model = estimators.fit_pd("logistic", frame.filter("split = 'train'"), FEATURES, "is_default")
    path = shared_folder(spark, "model")
    model.save(path)
    both = estimators.Classifier.load(path).predict(model.predict(frame, "made"), "loaded")
    return both.select("borrower_id", (F.col("made") == F.col("loaded")).alias("equal"))


@query(
    "challenger_embeddings",
    with_views(["borrowers"], "SELECT borrower_id, 8 AS dimensions, true AS finite FROM borrowers"),
)
def _(spark, folder):
    """Every borrower has a place in the challenger's factor space."""
    frame = _frame(spark, folder)
    model = estimators.fit_pd("crosses", frame.filter("split = 'train'"), FEATURES, "is_default")
    placed = estimators.cross_embeddings(model, frame.select("borrower_id", *FEATURES))
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return placed.select("borrower_id", F.size("embedding").alias("dimensions"), finite.alias("finite"))


_CALIBRATED = f"""
SELECT round(least(count(*) FILTER (is_default = 0) / (count(*) FILTER (is_default = 1) + 1), 50), 6) AS weight,
       true AS not_worse, true AS in_unit
FROM ({_SPLIT}) s WHERE split = 'train'"""


@query("calibrated_challenger", with_views(["borrowers"], _CALIBRATED))
def _(spark, folder):
    """The challenger's positive weight, and its validation loss after calibration against that before."""
    frame = _frame(spark, folder)
    train, validation = frame.filter("split = 'train'"), frame.filter("split = 'validation'")
    raw = estimators.fit_pd("crosses", train, FEATURES, "is_default")
    model = tuning.with_temperature(raw, validation, "is_default")
    both = model.predict(raw.predict(validation, "before"), "after")
    y, weight = F.col("is_default"), split.class_weights(train, "is_default").filter("is_default = 1")

    def loss(name: str):
        p = F.least(F.greatest(F.col(name), F.lit(1e-7)), F.lit(1 - 1e-7))
        return F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))

    found = both.agg((loss("after") <= loss("before") + 1e-9).alias("not_worse"), F.every(F.col("after").between(0, 1)).alias("in_unit"))
    return rounded(found.join(weight.select(F.col("capped_weight").alias("weight")), F.lit(True)))


@query("tuned_settings")
def _(spark, folder):
    frame = _frame(spark, folder).filter("split = 'train'")
    best = tuning.tune_boosted(frame, FEATURES, "is_default")
    return spark.createDataFrame([(k, float(v)) for k, v in best.items()], "parameter string, value double")


@query("searched_ensemble_weights")
def _(spark, folder):
    scored = materialize(table(spark, folder, "scored").select("is_default", *MODELS), "scores")
    return ensemble.weights_table(spark, ensemble.search_weights(scored, MODELS, "is_default"))


def _boosted(spark, folder, columns):
    """The boosted default model of the training part, fitted once per session."""

    def make():
        part = training_table(_frame(spark, folder).filter("split = 'train'").select("is_default", *columns))
        return side_by_side(spark, {"boosted": lambda: estimators.fit_pd("boosted", part, columns, "is_default")})["boosted"]

    return _once(f"boosted {' '.join(columns)}", spark, folder, make)


_EXPLAINED = f"SELECT borrower_id, true AS {{}} FROM ({_SPLIT}) s WHERE split = 'test'"


@query("exact_contributions", with_views(["borrowers"], _EXPLAINED.format("additive")))
def _(spark, folder):
    """Of every borrower of the test part: the contributions add up to the margin less the background's mean margin."""
    frame, model = _frame(spark, folder), _boosted(spark, folder, FEATURES).model
    test = frame.filter("split = 'test'")
    background = materialize(shapley.background_sample(frame.filter("split = 'train'"), "borrower_id", FEATURES), "background")
    found = leaf_paths.tree_contributions(test, "borrower_id", FEATURES, background, model)
    sums = found.groupBy("borrower_id").agg(F.sum("contribution").alias("total"), F.count("feature").alias("features"))
    mean = leaf_paths.margins(background, model).agg(F.avg("margin").alias("mean"))
    margin = leaf_paths.margins(test.select("borrower_id", *FEATURES), model).join(F.broadcast(mean), F.lit(True))
    near = F.abs(F.col("margin") - F.col("mean") - F.col("total")) < 1e-9
    return margin.join(sums, "borrower_id").select(
        "borrower_id", (near & (F.col("features") == len(FEATURES))).alias("additive"))


FOUR = FEATURES[:4]


def coalition_contributions(spark, rows, background, same, model):
    """``(borrower_id, feature, wanted)``: Shapley values of the four features from the worth of all 16 coalitions.

    The margin is the same for all values between two edges of the trees, so values are first put on the edge above. Of
    each coalition a worth is asked once for all rows that agree in its members, and each mixture is predicted once.
    """
    snapped = leaf_paths.on_edges(rows.select("borrower_id", *FOUR), model, FEATURES, FOUR)
    fields = ", ".join(f"{c} double" for c in FOUR)
    drawn = spark.createDataFrame([tuple(r[c] for c in FOUR) for r in background], fields)
    times = leaf_paths.on_edges(drawn, model, FEATURES, FOUR).groupBy(*FOUR).count().collect()
    others = spark.createDataFrame(
        [(at, r["count"], *[r[c] for c in FOUR]) for at, r in enumerate(times)], "other int, times long, " + fields.replace(" double", "_other double"))
    member = [F.col("coalition").bitwiseAND(F.lit(1 << at)) != 0 for at in range(4)]
    own = [F.when(inside, F.col(c)).alias(f"{c}_own") for inside, c in zip(member, FOUR, strict=True)]
    given = snapped.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("borrower_id", "coalition", *own)
    given, owned = materialize(given, "coalitions"), [f"{c}_own" for c in FOUR]
    # Where all members are the row's, the other row has no part in it.
    needed = (F.col("coalition") < 15) | (F.col("other") == 0)
    asked = materialize(given.select("coalition", *owned).distinct().join(F.broadcast(others), needed).select(
        "coalition", "times", *owned, *[F.coalesce(f"{c}_own", f"{c}_other").alias(c) for c in FOUR]), "mixtures")
    once = asked.select(*FOUR).distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    predicted = materialize(leaf_paths.margins(once.select(*FOUR, *same), model).select(*FOUR, "margin"), "margins")
    worth = materialize(asked.join(predicted, FOUR).groupBy("coalition", *owned).agg(
        (F.sum(F.col("margin") * F.col("times")) / F.sum("times")).alias("worth")), "worth")
    equal = [given[c].eqNullSafe(worth[c]) for c in ("coalition", *owned)]
    both = given.join(worth, equal).select("borrower_id", given["coalition"], "worth")
    shares, terms = [1 / 4, 1 / 12, 1 / 12, 1 / 4], []
    for at, c in enumerate(FOUR):
        signed = [shares[s.bit_count() - (s >> at & 1)] * (1 if s >> at & 1 else -1) for s in range(16)]
        factor = F.get(F.array(*map(F.lit, signed)), F.col("coalition"))
        terms.append(F.sum(factor * F.col("worth")).alias(c))
    return both.groupBy("borrower_id").agg(*terms).unpivot("borrower_id", FOUR, "feature", "wanted")


@query("exact_contributions_by_coalitions", with_views(["borrowers"], _EXPLAINED.format("equal")))
def _(spark, folder):
    """Where rows differ in four features only, their contributions equal those from the worth of all 16 coalitions."""
    frame, model = _frame(spark, folder), _boosted(spark, folder, FEATURES).model
    background = shapley.background_sample(frame.filter("split = 'train'"), "borrower_id", FEATURES, 40).collect()
    same = [F.lit(background[0][c]).alias(c) for c in FEATURES[4:]]
    test = frame.filter("split = 'test'").select("borrower_id", *FOUR)
    drawn = spark.createDataFrame([tuple(r[c] for c in FOUR) for r in background], ", ".join(f"{c} double" for c in FOUR))
    found = leaf_paths.tree_contributions(
        test.select("borrower_id", *FOUR, *same), "borrower_id", FEATURES, drawn.select(*FOUR, *same), model)

    wanted = coalition_contributions(spark, test, background, same, model)
    both = found.join(wanted, ["borrower_id", "feature"], "left")
    near = F.max(F.abs(F.col("contribution") - F.coalesce("wanted", F.lit(0.0)))) < 1e-9
    return both.groupBy("borrower_id").agg((near & (F.count("feature") == len(FEATURES))).alias("equal"))


@query("sampled_contributions")
def _(spark, folder):
    frame = _frame(spark, folder)
    train = frame.filter("split = 'train'")
    model = _boosted(spark, folder, FEATURES)
    background = shapley.background_sample(train, "borrower_id", FEATURES)
    return shapley.sampled_contributions(
        frame.filter("split = 'test'"), "borrower_id", FEATURES, background, lambda df: model.predict(df, "prob")
    )


def _run(spark, folder):
    inputs = [table(spark, folder, n) for n in ("borrowers", "long_transactions", "payments")]
    return _once("run", spark, folder, lambda: training.train(*inputs, LONG_REFERENCE))


@query("training_run")
def _(spark, folder):
    return _run(spark, folder).pd_metrics


@query("training_run_with_challenger")
def _(spark, folder):
    run = training.add_challenger(_run(spark, folder), "crosses")
    return run.pd_metrics


@query("reevaluated_models")
def _(spark, folder):
    run = _run(spark, folder)
    path = shared_folder(spark, "models")
    run.save(path)
    return training.reevaluate(path, run.matrix, list(training.PD_KINDS))


@query(
    "scores_of_a_loaded_run",
    with_views(["borrowers"], "SELECT borrower_id, true AS equal FROM borrowers"),
)
def _(spark, folder):
    """A run is trained, saved and loaded by its path; every score equals that of the run in hand."""
    run = _run(spark, folder)
    path = shared_folder(spark, "run")
    run.save(path)
    applications = table(spark, folder, "borrowers").withColumn("application_id", F.col("borrower_id"))
    made = batch_scoring.Scorer(run.features, run.pd_models, run.weights, run.lgd, run.ead, run.fraud)
    scores = [
        batch_scoring.score_applications(applications, s, use_balance=True)[0]
        for s in (made, batch_scoring.Scorer.load(spark, path))
    ]
    names = [c for c, t in scores[0].dtypes if t in ("double", "int", "string") and c != "application_id"]
    packed = [s.select("application_id", F.struct(*names).alias(n)) for n, s in zip(("a", "b"), scores, strict=True)]
    both = applications.select("application_id").join(packed[0], "application_id", "left")
    both = both.join(packed[1], "application_id", "left")  # quarantined applications have no score in either
    return both.select(F.col("application_id").alias("borrower_id"), F.col("a").eqNullSafe(F.col("b")).alias("equal"))


@query("batch_score_with_reasons")
def _(spark, folder):
    run = _run(spark, folder)
    scorer = batch_scoring.Scorer(run.features, run.pd_models, run.weights, run.lgd, run.ead, run.fraud)
    applications = table(spark, folder, "borrowers").withColumn("application_id", F.col("borrower_id"))
    scored, _ = batch_scoring.score_applications(applications, scorer, use_balance=True)
    scored = materialize(scored, "scores")
    notices = batch_scoring.declined_reasons(scorer.matrix(spread(applications)), scored, scorer, run.background)
    return batch_scoring.responses(scored, notices)
