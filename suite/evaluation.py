"""Splits, weights, decisions and model metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import decision, evaluate, profile, split

from .registry import query, rounded
from .views import table, with_views

_RANKED = """
SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY h, borrower_id) AS r, count(*) OVER (PARTITION BY {by}) AS n
FROM (SELECT *, ('0x' || substr(md5(borrower_id || ':42'), 1, 8))::BIGINT AS h FROM borrowers) q"""
_SPLIT = f"""SELECT *, CASE WHEN r <= floor(n * 0.2 + 0.5) THEN 'test'
  WHEN r <= floor(n * 0.2 + 0.5) + floor(n * 0.15 + 0.5) THEN 'validation' ELSE 'train' END AS split
FROM ({_RANKED.format(by='is_default')}) z"""


@query("stratified_split", with_views(["borrowers"], f"SELECT borrower_id, is_default, split FROM ({_SPLIT}) s"))
def _(spark, folder):
    borrowers = table(spark, folder, "borrowers").select("borrower_id", "is_default")
    return split.stratified_split(borrowers, "is_default")


@query(
    "split_summary",
    with_views(
        ["borrowers"],
        f"SELECT split, count(*) AS rows, round(avg(is_default), 6) AS default_rate FROM ({_SPLIT}) s GROUP BY split",
    ),
)
def _(spark, folder):
    borrowers = table(spark, folder, "borrowers").select("borrower_id", "is_default")
    return rounded(split.split_summary(split.stratified_split(borrowers, "is_default"), "is_default"))


@query(
    "stratified_folds",
    with_views(
        ["borrowers"],
        f"SELECT borrower_id, is_default, ((r - 1) % 3)::INT AS fold FROM ({_RANKED.format(by='is_default')}) s",
    ),
)
def _(spark, folder):
    borrowers = table(spark, folder, "borrowers").select("borrower_id", "is_default")
    return split.fold_column(borrowers, "is_default")


@query(
    "sample_rows",
    with_views(
        ["borrowers"],
        f"SELECT borrower_id, state FROM ({_RANKED.format(by='true')}) s WHERE r <= 500",
    ),
)
def _(spark, folder):
    return split.sample_rows(table(spark, folder, "borrowers").select("borrower_id", "state"), 500)


@query(
    "class_weights",
    with_views(
        ["borrowers"],
        """
WITH c AS (SELECT count(*) AS n, sum(is_default) AS pos FROM borrowers)
SELECT is_default, count(*) AS rows, round(max(n) / (2 * count(*)), 6) AS balanced_weight,
  round(CASE WHEN is_default = 1 THEN least((max(n) - max(pos)) / (max(pos) + 1), 50) ELSE 1 END, 6) AS capped_weight
FROM borrowers CROSS JOIN c GROUP BY is_default""",
    ),
)
def _(spark, folder):
    return rounded(split.class_weights(table(spark, folder, "borrowers"), "is_default"))


@query(
    "weighted_rows",
    with_views(
        ["borrowers"],
        """SELECT borrower_id, is_default,
  round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY is_default)), 6) AS weight FROM borrowers""",
    ),
)
def _(spark, folder):
    borrowers = table(spark, folder, "borrowers").select("borrower_id", "is_default")
    return rounded(split.with_class_weight(borrowers, "is_default"))


_CLIPPED = "least(greatest(pd, 1e-6), 1 - 1e-6)"
_POINTS = f"trunc(least(greatest(575 - 55 * ln({_CLIPPED} / (1 - {_CLIPPED})), 300), 850))::INT"
SCORE_SQL = f"""
SELECT *, pd * lgd * ead AS expected_loss,
  CASE WHEN fraud_flag THEN 'manual_review' WHEN credit_score < 550 THEN 'declined'
    WHEN credit_score < 620 THEN 'manual_review' ELSE 'approved' END AS decision
FROM (SELECT borrower_id, state, pd, lgd, fraud_score, fraud_score > 0.5 AS fraud_flag, {_POINTS} AS credit_score,
  CASE WHEN pd < 0.05 THEN 'low' WHEN pd < 0.15 THEN 'medium' WHEN pd < 0.30 THEN 'high' ELSE 'very_high' END
    AS risk_tier,
  {{ead}} AS ead FROM scored) z"""
_OWN_EAD = (
    "least(greatest(current_credit_balance + 0.75 * greatest(total_credit_limit - current_credit_balance, 0),"
    " current_credit_balance), total_credit_limit)"
)
_SCORE_LIST = """borrower_id, round(pd, 6) AS pd, round(lgd, 6) AS lgd, round(ead, 6) AS ead,
  round(expected_loss, 6) AS expected_loss, credit_score, risk_tier, fraud_score, fraud_flag, decision"""


def scored_applications(spark, folder, keep=("borrower_id",)):
    return decision.score_frame(
        table(spark, folder, "scored"),
        drawn="current_credit_balance",
        limit="total_credit_limit",
        keep=list(keep),
    )


@query("score_batch", with_views(["scored"], f"SELECT {_SCORE_LIST} FROM ({SCORE_SQL.format(ead=_OWN_EAD)}) s"))
def _(spark, folder):
    return rounded(scored_applications(spark, folder))


@query(
    "score_batch_default_exposure",
    with_views(["scored"], f"SELECT {_SCORE_LIST} FROM ({SCORE_SQL.format(ead='7500::DOUBLE')}) s"),
)
def _(spark, folder):
    return rounded(decision.score_frame(table(spark, folder, "scored"), keep=["borrower_id"]))


@query(
    "decisions_by_tier",
    with_views(
        ["scored"],
        f"""SELECT risk_tier, decision, count(*) AS applications, round(avg(pd), 9) AS avg_pd,
  round(sum(expected_loss), 4) AS expected_loss, round(avg(credit_score), 6) AS avg_score
FROM ({SCORE_SQL.format(ead=_OWN_EAD)}) s GROUP BY ROLLUP (risk_tier, decision)""",
    ),
)
def _(spark, folder):
    rolled = decision.portfolio_rollup(scored_applications(spark, folder), ["risk_tier", "decision"])
    return rolled.select(
        "risk_tier",
        "decision",
        "applications",
        F.round("avg_pd", 9).alias("avg_pd"),
        F.round("expected_loss", 4).alias("expected_loss"),
        F.round("avg_score", 6).alias("avg_score"),
    )


@query(
    "exposure_label",
    with_views(["borrowers"], "SELECT borrower_id, ead_value AS exposure FROM borrowers"),
)
def _(spark, folder):
    factor = F.col("borrower_id") * 73 % 50 / F.lit(1e2)
    label = profile.exposure_label(F.col("current_credit_balance"), F.col("total_credit_limit"), factor)
    return table(spark, folder, "borrowers").select("borrower_id", label.alias("exposure"))


@query(
    "conversion_label",
    with_views(
        ["borrowers"],
        """SELECT borrower_id, round(CASE WHEN total_credit_limit > current_credit_balance THEN
  least(greatest((ead_value - current_credit_balance) / (total_credit_limit - current_credit_balance), 0), 1)
  ELSE 0 END, 6) AS conversion FROM borrowers""",
    ),
)
def _(spark, folder):
    label = profile.conversion_label(F.col("ead_value"), F.col("current_credit_balance"), F.col("total_credit_limit"))
    return rounded(table(spark, folder, "borrowers").select("borrower_id", label.alias("conversion")))


MODELS = ["pd", "challenger_pd", "rough_pd"]
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS model, is_default AS label, {m} AS prob FROM scored" for m in MODELS)
STEPS_SQL = f"""
WITH long AS ({_LONG}),
d AS (SELECT model, prob, sum(label) AS pos, count(*) - sum(label) AS neg FROM long GROUP BY ALL),
steps AS (SELECT *, sum(pos) OVER up AS pc, sum(neg) OVER up AS nc, sum(pos) OVER tot AS p, sum(neg) OVER tot AS n
  FROM d WINDOW up AS (PARTITION BY model ORDER BY prob ROWS UNBOUNDED PRECEDING), tot AS (PARTITION BY model)),
best AS (SELECT model, max_by(prob, ((p - pc + pos) * n - (n - nc + neg) * p, prob)) AS cut FROM steps GROUP BY model)"""


def long_scores(spark, folder):
    return evaluate.models_long(table(spark, folder, "scored"), MODELS, "is_default")


@query(
    "rank_metrics",
    with_views(
        ["scored"],
        f"""{STEPS_SQL}
SELECT model, round(sum(neg * (p - pc + pos / 2)) / max(p * n), 6) AS auc_roc,
  round(2 * (sum(neg * (p - pc + pos / 2)) / max(p * n)) - 1, 6) AS gini,
  round(max(abs(pc / p - nc / n)), 6) AS ks_statistic
FROM steps GROUP BY model""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.rank_metrics(long_scores(spark, folder), ["model"], groups=len(MODELS)))


@query(
    "loss_metrics",
    with_views(
        ["scored"],
        f"""WITH long AS ({_LONG})
SELECT model, round(avg(CASE WHEN label = 1 THEN -ln(prob) ELSE -ln(1 - prob) END), 6) AS log_loss,
  round(avg((prob - label) * (prob - label)), 6) AS brier_score FROM long GROUP BY model""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.loss_metrics(long_scores(spark, folder), ["model"]))


@query(
    "roc_points",
    with_views(
        ["scored"],
        f"""{STEPS_SQL}
SELECT model, prob AS threshold, round((p - pc + pos) / p, 6) AS tpr, round((n - nc + neg) / n, 6) AS fpr FROM steps""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.roc_points(long_scores(spark, folder), ["model"], groups=len(MODELS)))


@query(
    "best_threshold",
    with_views(["scored"], f"{STEPS_SQL} SELECT model, cut AS optimal_threshold FROM best"),
)
def _(spark, folder):
    return evaluate.best_threshold(long_scores(spark, folder), ["model"], groups=len(MODELS))


_CELLS = """cells AS (SELECT model, count(*) FILTER (label = 0 AND prob < cut) AS tn,
  count(*) FILTER (label = 0 AND prob >= cut) AS fp, count(*) FILTER (label = 1 AND prob < cut) AS fn,
  count(*) FILTER (label = 1 AND prob >= cut) AS tp FROM long JOIN best USING (model) GROUP BY model)"""


@query("confusion_matrix", with_views(["scored"], f"{STEPS_SQL}, {_CELLS} SELECT * FROM cells"))
def _(spark, folder):
    predicted = evaluate.with_predictions(long_scores(spark, folder), ["model"], groups=len(MODELS))
    return evaluate.confusion(predicted, ["model"])


@query(
    "classification_report",
    with_views(
        ["scored"],
        f"""{STEPS_SQL}, {_CELLS},
per AS (SELECT model, '0' AS class, tn AS hit, tn + fn AS said, tn + fp AS support FROM cells
  UNION ALL SELECT model, '1', tp, tp + fp, tp + fn FROM cells),
m AS (SELECT model, class, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
  coalesce(2 * hit / nullif(said + support, 0), 0) AS f1, support, hit FROM per),
every AS (SELECT model, class, precision, recall, f1, support FROM m
UNION ALL SELECT model, 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support),
  sum(support) FROM m GROUP BY model
UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m GROUP BY model
UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM m GROUP BY model)
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  support::BIGINT AS support FROM every""",
    ),
)
def _(spark, folder):
    predicted = evaluate.with_predictions(long_scores(spark, folder), ["model"], groups=len(MODELS))
    return rounded(evaluate.classification_report(evaluate.confusion(predicted, ["model"]), ["model"]))


@query(
    "decile_table",
    with_views(
        ["scored"],
        f"""WITH long AS ({_LONG}),
edges AS (SELECT model, list_distinct(quantile_cont(prob, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e
  FROM long GROUP BY model),
placed AS (SELECT *, greatest(1, len(list_filter(e, lambda x: x < prob)))::INT AS decile FROM long JOIN edges USING (model))
SELECT model, decile, count(*) AS count, sum(label)::BIGINT AS default_count, round(avg(label), 6) AS default_rate,
  round(avg(prob), 6) AS avg_predicted_pd, round(min(prob), 6) AS min_pd, round(max(prob), 6) AS max_pd
FROM placed GROUP BY model, decile""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.decile_table(long_scores(spark, folder), ["model"], groups=len(MODELS)))


def metrics_sql(long: str) -> str:
    """All metrics per ``model`` of ``long``, SQL for rows of model, label and prob."""
    return f"""{STEPS_SQL.replace(_LONG, long)}, {_CELLS},
ranks AS (SELECT model, sum(neg * (p - pc + pos / 2)) / max(p * n) AS auc, max(abs(pc / p - nc / n)) AS ks
  FROM steps GROUP BY model),
losses AS (SELECT model, avg(CASE WHEN label = 1 THEN -ln(prob) ELSE -ln(1 - prob) END) AS ll,
  avg((prob - label) * (prob - label)) AS brier FROM long GROUP BY model),
metrics AS (SELECT model, round(auc, 6) AS auc_roc, round(2 * auc - 1, 6) AS gini, round(ks, 6) AS ks_statistic,
  round(ll, 6) AS log_loss, round(brier, 6) AS brier_score, cut AS optimal_threshold, tn, fp, fn, tp,
  auc >= 0.70 AS passed
FROM ranks JOIN losses USING (model) JOIN best USING (model) JOIN cells USING (model))"""


@query("evaluate_models", with_views(["scored"], f"{metrics_sql(_LONG)} SELECT * FROM metrics"))
def _(spark, folder):
    metrics = evaluate.evaluate_pd(long_scores(spark, folder), ["model"], groups=len(MODELS))
    return rounded(evaluate.performance_gate(metrics))


@query(
    "lgd_errors",
    with_views(
        ["scored"],
        """SELECT round(avg(abs(lgd_value - lgd)), 6) AS mae, round(sqrt(avg((lgd_value - lgd) ** 2)), 6) AS rmse,
  round(1 - sum((lgd_value - lgd) ** 2) / (var_pop(lgd_value) * count(*)), 6) AS r2 FROM scored WHERE lgd_value > 0""",
    ),
)
def _(spark, folder):
    return rounded(evaluate.lgd_errors(table(spark, folder, "scored"), [], "lgd_value", "lgd"))


@query(
    "ead_errors",
    with_views(
        ["scored"],
        f"""WITH s AS (SELECT ead_value AS y, {_OWN_EAD} AS p FROM scored WHERE ead_value > 0)
SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
  round(avg(abs(y - p) / greatest(y, 1)), 4) AS mape FROM s""",
    ),
)
def _(spark, folder):
    exposed = table(spark, folder, "scored").withColumn(
        "ead", decision.exposure(F.lit(0.75), F.col("current_credit_balance"), F.col("total_credit_limit"))
    )
    return rounded(evaluate.ead_errors(exposed, [], "ead_value", "ead"), 4)
