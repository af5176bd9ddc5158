"""Drift, fairness, performance, service metrics and shadow comparison."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskloom.operators import drift, evaluate, fairness, monitor, rank_history, shadow
from riskloom.operators.profile import CREDIT_FEATURES, PROFILE_FEATURES, RATIO_FEATURES, borrower_features
from riskloom.plans import drift_report
from riskloom.session import shared_folder

from .evaluation import MODELS, metrics_sql
from .features import CREDIT_SQL, PROFILE_SQL, RATIO_SQL
from .registry import query, rounded
from .views import table, with_views

COLUMNS = [*PROFILE_FEATURES, *CREDIT_FEATURES, *RATIO_FEATURES]


def _draw(salt: str) -> str:
    return f"(('0x' || substr(md5(borrower_id || ':{salt}'), 1, 8))::BIGINT / 4294967296)"


def _between(low: float, high: float, salt: str) -> str:
    return f"({low}::DOUBLE + {_draw(salt)} * ({high}::DOUBLE - {low}::DOUBLE))"


# The whole distribution function of Poisson(1), as far as doubles tell it from 1.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(17)]
_E, _D, _S = drift.SCENARIOS
STRESS_SQL = {
    _E: f"""annual_income * {_between(0.75, 0.95, _E + ':income')} AS annual_income,
  least(greatest(credit_utilization_ratio * {_between(1.1, 1.6, _E + ':use')}, 0), 2) AS credit_utilization_ratio,
  least(greatest(debt_to_income_ratio * {_between(1.1, 1.4, _E + ':debt')}, 0), 5) AS debt_to_income_ratio,
  number_of_delinquencies + ({' + '.join(f"({_draw(_E + ':delinquency')} >= {x!r}::DOUBLE)::INT"
                                       for x in _POISSON)}) AS number_of_delinquencies""",
    _D: f"""least(greatest(age - floor({_between(3, 10, _D + ':age')}), 18), 100)::INT AS age,
  CASE WHEN employment_length_years IS NOT NULL THEN
    least(greatest(employment_length_years * {_between(0.3, 0.8, _D + ':job')}, 0), 40) END AS employment_length_years,
  trunc(least(greatest(account_age_months * {_between(0.3, 0.7, _D + ':account')}, 1), 500))::INT
    AS account_age_months""",
    _S: f"""requested_loan_amount * {_between(1.1, 1.4, _S + ':loan')} AS requested_loan_amount,
  current_credit_balance * {_between(1.05, 1.3, _S + ':balance')} AS current_credit_balance""",
}


def _long(source: str) -> str:
    wide = f"SELECT borrower_id, {PROFILE_SQL}, {CREDIT_SQL}, {RATIO_SQL} FROM {source}"
    return (
        f"(UNPIVOT (SELECT borrower_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in COLUMNS)} FROM ({wide}) w)"
        f" ON {', '.join(COLUMNS)} INTO NAME feature VALUE value)"
    )


_BIN = "(" + " + ".join(f"(value >= low + {k} * width)::INT" for k in range(1, 10)) + ")"
_REFERENCE = f"""ref AS (SELECT * FROM {_long('borrowers')}),
ranges AS (SELECT feature, min(value) - (CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END)::DOUBLE AS low,
  max(value) + (CASE WHEN min(value) = max(value) THEN 0.5 ELSE 0 END)::DOUBLE AS high FROM ref GROUP BY feature),
spans AS (SELECT *, (high - low) / 10 AS width FROM ranges),
spine AS (SELECT feature, low, high, width, bin::INT AS bin FROM spans, range(10) r(bin)),
ref_counts AS (SELECT feature, {_BIN} AS bin, count(*) AS n FROM ref JOIN spans USING (feature) GROUP BY ALL),
shares AS (SELECT feature, bin, low, high, width, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY feature)
  AS share FROM spine LEFT JOIN ref_counts USING (feature, bin))"""


def _psi(scenarios: list[str]) -> str:
    current = " UNION ALL ".join(
        f"SELECT '{s}' AS scenario, feature, value FROM"
        f" {_long('(SELECT * REPLACE (' + STRESS_SQL[s] + ') FROM borrowers)')} x"
        for s in scenarios
    )
    return f"""{_REFERENCE},
cur AS ({current}),
cur_counts AS (SELECT scenario, feature, {_BIN} AS bin, count(*) AS n FROM cur JOIN spans USING (feature)
  WHERE value BETWEEN low AND high GROUP BY ALL),
names AS (SELECT DISTINCT scenario FROM cur),
cur_shares AS (SELECT scenario, feature, bin, share, coalesce(n, 0)
    / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY scenario, feature), 1) AS c
  FROM shares CROSS JOIN names LEFT JOIN cur_counts USING (scenario, feature, bin)),
psi AS (SELECT scenario, feature, sum((greatest(c, 1e-6) - greatest(share, 1e-6))
    * ln(greatest(c, 1e-6) / greatest(share, 1e-6))) AS psi FROM cur_shares GROUP BY ALL),
drift AS (SELECT scenario, feature, round(psi, 4) AS psi,
  CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'warning' ELSE 'alert' END AS status FROM psi)"""


def _features(spark, folder):
    return borrower_features(table(spark, folder, "borrowers"))


def _stress_drift(spark, folder):
    borrowers = table(spark, folder, "borrowers")
    sets = {s: borrower_features(drift.stressed_borrowers(borrowers, s)) for s in drift.SCENARIOS}
    return drift_report.compare_sets(drift_report.store_reference(_features(spark, folder), COLUMNS), sets, COLUMNS)


@query(
    "reference_distribution",
    with_views(
        ["borrowers"],
        f"WITH {_REFERENCE} SELECT feature, bin, round(low, 6) AS low, round(high, 6) AS high,"
        " round(width, 6) AS width, round(share, 6) AS share FROM shares",
    ),
)
def _(spark, folder):
    return rounded(drift.reference_bins(_features(spark, folder), COLUMNS))


@query("feature_drift", with_views(["borrowers"], f"WITH {_psi(list(drift.SCENARIOS))} SELECT * FROM drift"))
def _(spark, folder):
    return _stress_drift(spark, folder)


@query(
    "drift_report",
    with_views(
        ["borrowers"],
        f"""WITH {_psi(list(drift.SCENARIOS))}
SELECT scenario, CASE WHEN bool_or(status = 'alert') THEN 'alert' WHEN bool_or(status = 'warning') THEN 'warning'
  ELSE 'stable' END AS overall_status, count(*) FILTER (status <> 'stable') AS n_features_drifted,
  count(*) AS n_features_total FROM drift GROUP BY scenario""",
    ),
)
def _(spark, folder):
    return drift_report.report(_stress_drift(spark, folder))


_SAMPLE = """(SELECT * FROM borrowers QUALIFY row_number() OVER (ORDER BY
  ('0x' || substr(md5(borrower_id || ':42'), 1, 8))::BIGINT, borrower_id) <= 500)"""


@query(
    "drift_baseline_sample",
    with_views(
        ["borrowers"],
        f"""WITH {_REFERENCE},
cur_counts AS (SELECT feature, {_BIN} AS bin, count(*) AS n FROM {_long(_SAMPLE)} c JOIN spans USING (feature)
  WHERE value BETWEEN low AND high GROUP BY ALL),
cur_shares AS (SELECT feature, bin, share, coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY feature), 1)
  AS c FROM shares LEFT JOIN cur_counts USING (feature, bin)),
psi AS (SELECT feature, sum((greatest(c, 1e-6) - greatest(share, 1e-6))
    * ln(greatest(c, 1e-6) / greatest(share, 1e-6))) AS psi FROM cur_shares GROUP BY ALL)
SELECT feature, round(psi, 4) AS psi,
  CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'warning' ELSE 'alert' END AS status FROM psi""",
    ),
)
def _(spark, folder):
    from riskloom.operators.split import sample_rows

    borrowers = table(spark, folder, "borrowers")
    reference = drift_report.store_reference(borrower_features(borrowers), COLUMNS)
    return drift.drift_table(borrower_features(sample_rows(borrowers, 500)), reference, COLUMNS)


_RATES = """rates AS (SELECT employment_type, avg((pred = 0)::INT) AS approval_rate,
  coalesce(avg(pred) FILTER (label = 1), 0) AS tpr, coalesce(avg(pred) FILTER (label = 0), 0) AS fpr,
  count(*) AS rows FROM (SELECT employment_type, is_default AS label, (pd >= 0.2)::INT AS pred FROM scored) p
  WHERE employment_type IS NOT NULL GROUP BY employment_type)"""


def _rates(spark, folder):
    scored = table(spark, folder, "scored").select("employment_type", F.col("is_default").alias("label"), "pd")
    predicted = evaluate.with_predictions(scored, [], prob="pd", threshold=0.2)
    return fairness.group_rates(predicted, "employment_type", "label", "pred")


@query(
    "fairness_group_rates",
    with_views(
        ["scored"],
        f"""WITH {_RATES} SELECT employment_type, round(approval_rate, 6) AS approval_rate, round(tpr, 6) AS tpr,
  round(fpr, 6) AS fpr, rows FROM rates""",
    ),
)
def _(spark, folder):
    return rounded(_rates(spark, folder))


@query(
    "demographic_parity",
    with_views(
        ["scored"],
        f"""WITH {_RATES} SELECT round(max(approval_rate) - min(approval_rate), 6) AS max_disparity,
  max(approval_rate) - min(approval_rate) < 0.10 AS passed FROM rates""",
    ),
)
def _(spark, folder):
    return rounded(fairness.demographic_parity(_rates(spark, folder)))


@query(
    "equalized_odds",
    with_views(
        ["scored"],
        f"""WITH {_RATES} SELECT round(max(tpr) - min(tpr), 6) AS tpr_disparity,
  round(max(fpr) - min(fpr), 6) AS fpr_disparity, max(tpr) - min(tpr) < 0.10 AS passed FROM rates""",
    ),
)
def _(spark, folder):
    return rounded(fairness.equalized_odds(_rates(spark, folder)))


@query(
    "impact_ratios",
    with_views(
        ["scored"],
        f"""WITH {_RATES} SELECT o.employment_type || '_vs_employed' AS pair,
  round(o.approval_rate / p.approval_rate, 6) AS ratio
FROM rates o JOIN rates p ON p.employment_type = 'employed' AND o.employment_type <> 'employed'""",
    ),
)
def _(spark, folder):
    return rounded(fairness.impact_ratios(_rates(spark, folder), "employment_type", "employed"))


_REPORT = """SELECT {cols} max(approval_rate) - min(approval_rate) AS max_disparity, max(tpr) - min(tpr) AS tpr_disparity,
  max(fpr) - min(fpr) AS fpr_disparity, min(approval_rate) FILTER (employment_type <> 'employed')
  / max(approval_rate) FILTER (employment_type = 'employed') AS min_ratio FROM rates {group}"""


@query(
    "disparate_impact",
    with_views(
        ["scored"],
        f"""WITH {_RATES}, f AS ({_REPORT.format(cols='', group='')})
SELECT round(min_ratio, 6) AS min_ratio, min_ratio >= 0.80 AS passed FROM f""",
    ),
)
def _(spark, folder):
    return rounded(fairness.disparate_impact(_rates(spark, folder), "employment_type", "employed"))


@query(
    "fairness_report",
    with_views(
        ["scored"],
        f"""WITH {_RATES}, f AS ({_REPORT.format(cols='', group='')})
SELECT round(max_disparity, 6) AS max_disparity, round(tpr_disparity, 6) AS tpr_disparity,
  round(fpr_disparity, 6) AS fpr_disparity, round(min_ratio, 6) AS min_ratio, max_disparity < 0.10 AS parity_passed,
  tpr_disparity < 0.10 AS odds_passed, min_ratio >= 0.80 AS impact_passed FROM f""",
    ),
)
def _(spark, folder):
    return rounded(fairness.fairness_report(_rates(spark, folder), "employment_type", "employed"))


_BATCH = "(borrower_id % 4)::INT"
_HISTORY_RATES = _RATES.replace("SELECT employment_type, avg", "SELECT batch, employment_type, avg").replace(
    "(SELECT employment_type, is_default", f"(SELECT {_BATCH} AS batch, employment_type, is_default"
).replace("GROUP BY employment_type)", "GROUP BY batch, employment_type)")


def _fairness_history(spark, folder):
    scored = table(spark, folder, "scored").select(
        (F.col("borrower_id") % 4).cast("int").alias("batch"),
        "employment_type",
        F.col("is_default").alias("label"),
        "pd",
    )
    predicted = evaluate.with_predictions(scored, [], prob="pd", threshold=0.2)
    rates = fairness.group_rates(predicted, "employment_type", "label", "pred", by=["batch"])
    return fairness.fairness_report(rates, "employment_type", "employed", by=["batch"])


@query(
    "bias_warnings",
    with_views(
        ["scored"],
        f"""WITH {_HISTORY_RATES}, f AS ({_REPORT.format(cols='batch,', group='GROUP BY batch')}),
last AS (SELECT * FROM f QUALIFY row_number() OVER (ORDER BY batch DESC) = 1)
SELECT 'Demographic parity check failed' AS warning FROM last WHERE max_disparity >= 0.10
UNION ALL SELECT 'Disparate impact ratio below 0.80 threshold' FROM last WHERE min_ratio < 0.80""",
    ),
)
def _(spark, folder):
    return fairness.bias_warnings(_fairness_history(spark, folder), "batch")


_PERF = f"""
WITH l AS (SELECT {_BATCH} AS batch, is_default AS label, pd AS prob FROM scored),
d AS (SELECT batch, prob, sum(label) AS pos, count(*) - sum(label) AS neg FROM l GROUP BY ALL),
s AS (SELECT *, sum(pos) OVER u AS pc, sum(neg) OVER u AS nc, sum(pos) OVER t AS p, sum(neg) OVER t AS n FROM d
  WINDOW u AS (PARTITION BY batch ORDER BY prob ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY batch)),
h AS (SELECT batch, sum(neg * (p - pc + pos / 2)) / max(p * n) AS auc, max(abs(pc / p - nc / n)) AS ks FROM s
  GROUP BY batch)"""


def _performance(spark, folder):
    scored = table(spark, folder, "scored").select(
        (F.col("borrower_id") % 4).cast("int").alias("batch"),
        F.col("is_default").alias("label"),
        F.col("pd").alias("prob"),
    )
    return monitor.performance_history(scored, "batch")


_BATCHES = f"SELECT {_BATCH} AS model, is_default AS label, pd AS prob FROM scored"


@query(
    "performance_history",
    with_views(
        ["scored"], metrics_sql(_BATCHES) + " SELECT model AS batch, * EXCLUDE (model, passed) FROM metrics"
    ),
)
def _(spark, folder):
    return rounded(_performance(spark, folder))


_UNIONS = {"first_half": ["0", "1"], "second_half": ["2", "3"], "all": ["0", "1", "2", "3"], "newest": ["3"]}
_UNITED = " UNION ALL ".join(
    f"SELECT '{name}' AS model, is_default AS label, pd AS prob FROM scored WHERE {_BATCH} IN ({', '.join(parts)})"
    for name, parts in _UNIONS.items()
)


@query(
    "performance_of_united_batches",
    with_views(
        ["scored"], metrics_sql(_UNITED) + ' SELECT model AS "union", * EXCLUDE (model, passed) FROM metrics'
    ),
)
def _(spark, folder):
    """Batches are added one by one, one of them twice; unions are measured without their rows."""
    path = shared_folder(spark, "rank-history")
    scored = table(spark, folder, "scored").select(
        (F.col("borrower_id") % 4).cast("int").alias("batch"), F.col("is_default").alias("label"), F.col("pd").alias("prob")
    )
    for batch in ("0", "1", "2", "3", "1"):
        rank_history.add_batch(scored.where(F.col("batch") == int(batch)), path, batch)
    return rounded(rank_history.united_metrics(spark, path, _UNIONS))


@query(
    "performance_degradation",
    with_views(
        ["scored"],
        _PERF
        + """ SELECT count(*) AS batches, round(min_by(auc, batch), 6) AS first_value,
  round(max_by(auc, batch), 6) AS last_value, min_by(auc, batch) - max_by(auc, batch) > 0.05 AS degraded FROM h""",
    ),
)
def _(spark, folder):
    return rounded(monitor.degradation(_performance(spark, folder), "batch"))


@query(
    "request_counts",
    with_views(["requests"], "SELECT endpoint, status, count(*) AS requests FROM requests GROUP BY ALL"),
)
def _(spark, folder):
    return monitor.request_counts(table(spark, folder, "requests"))


@query(
    "latency_histogram",
    with_views(
        ["requests"],
        """
WITH b AS (SELECT * FROM (VALUES ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25),
  ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('+Inf', 1e300)) t(le, bound)),
s AS (SELECT endpoint, round(sum(latency_seconds), 6) AS latency_sum, count(*) AS latency_count FROM requests
  GROUP BY endpoint)
SELECT endpoint, latency_sum, latency_count, le, (SELECT count(*) FROM requests r WHERE r.endpoint = s.endpoint
  AND r.latency_seconds <= b.bound::DOUBLE) AS requests FROM s CROSS JOIN b""",
    ),
)
def _(spark, folder):
    return rounded(monitor.latency_histogram(table(spark, folder, "requests")))


@query(
    "latest_gauges",
    with_views(
        ["requests"],
        """SELECT endpoint, status, max_by(latency_seconds, (requested_at, request_id)) AS latency_seconds
FROM requests GROUP BY ALL""",
    ),
)
def _(spark, folder):
    log = table(spark, folder, "requests").withColumn("at", F.struct("requested_at", "request_id"))
    return monitor.latest_gauge(log, ["endpoint", "status"], "latency_seconds", "at")


@query(
    "service_metrics",
    with_views(
        ["requests"],
        """SELECT count(*) AS total_requests, round(sum(latency_seconds * 1000) / greatest(count(*), 1), 2)
  AS avg_latency_ms, round(count(*) FILTER (status <> '200') / greatest(count(*), 1), 4) AS error_rate FROM requests""",
    ),
)
def _(spark, folder):
    return monitor.service_metrics(table(spark, folder, "requests"))


_CLIP = {c: f"least(greatest({c}, 1e-6), 1 - 1e-6)" for c in ("pd", "challenger_pd")}
_PTS = {c: f"trunc(least(greatest(575 - 55 * ln({x} / (1 - {x})), 300), 850))::INT" for c, x in _CLIP.items()}


def _decision(score: str) -> str:
    return (
        f"CASE WHEN fraud_score > 0.5 THEN 'manual_review' WHEN {score} < 550 THEN 'declined'"
        f" WHEN {score} < 620 THEN 'manual_review' ELSE 'approved' END"
    )


SHADOW_SQL = f"""
WITH s AS (SELECT *, {_PTS['pd']} AS champion_score, {_PTS['challenger_pd']} AS challenger_score FROM scored
  WHERE ('0x' || substr(md5(borrower_id || ':shadow'), 1, 8))::BIGINT / 4294967296 < 0.8),
log AS (SELECT borrower_id AS application_id, pd AS champion_pd, challenger_pd, champion_score, challenger_score,
  {_decision('champion_score')} AS champion_decision, {_decision('challenger_score')} AS challenger_decision,
  round(borrower_id % 40 / 8 + 3, 2) AS champion_latency_ms, round(borrower_id % 24 / 8 + 4, 2)
    AS challenger_latency_ms FROM s),
logged AS (SELECT *, champion_decision = challenger_decision AS agreement FROM log)"""


def shadow_rows(spark, folder):
    applications = (
        table(spark, folder, "scored")
        .withColumnRenamed("borrower_id", "application_id")
        .withColumn("champion_ms", F.col("application_id") % 40 / 8 + 3)
        .withColumn("challenger_ms", F.col("application_id") % 24 / 8 + 4)
    )
    return shadow.shadow_log(
        applications, "pd", "challenger_pd", traffic=0.8, latencies=("champion_ms", "challenger_ms")
    )


@query("shadow_log", with_views(["scored"], SHADOW_SQL + " SELECT * FROM logged"))
def _(spark, folder):
    return shadow_rows(spark, folder).drop("timestamp")


@query(
    "shadow_comparison_report",
    with_views(
        ["scored"],
        SHADOW_SQL
        + """,
r AS (SELECT count(*) AS n, avg(agreement::INT) AS agree, corr(champion_pd, challenger_pd) AS c,
  avg(challenger_pd - champion_pd) AS gap, avg(challenger_score - champion_score) AS points,
  avg(champion_latency_ms) AS m1, avg(challenger_latency_ms) AS m2, count(*) FILTER (NOT agreement) AS apart,
  count(*) FILTER (challenger_decision = 'approved' AND champion_decision <> 'approved') AS up,
  count(*) FILTER (challenger_decision = 'declined' AND champion_decision <> 'declined') AS down FROM logged)
SELECT 'active' AS status, n AS n_comparisons, round(agree, 4) AS decision_agreement_rate, round(c, 4) AS pd_correlation,
  round(gap, 6) AS pd_mean_difference, round(points, 2) AS credit_score_mean_difference,
  round(m1, 2) AS champion_avg_latency_ms, round(m2, 2) AS challenger_avg_latency_ms, apart AS disagreements,
  up AS challenger_more_lenient, down AS challenger_more_strict, apart - up - down AS other,
  CASE WHEN agree >= 0.95 AND c >= 0.98 THEN 'SAFE TO PROMOTE: High agreement, strong correlation.'
    WHEN agree >= 0.90 THEN 'REVIEW NEEDED: Good agreement but check disagreement cases.'
    WHEN agree >= 0.80 THEN 'CAUTION: Moderate disagreement. Run longer before promoting.'
    ELSE 'DO NOT PROMOTE: Significant behavioral differences detected.' END AS recommendation FROM r""",
    ),
)
def _(spark, folder):
    return shadow.comparison_report(shadow_rows(spark, folder))


@query(
    "shadow_recent",
    with_views(
        ["scored", "recent_transactions"],
        """
WITH log AS (SELECT transaction_id AS application_id, timestamp,
  round(0.01 + amount / 1000, 6) AS champion_pd FROM recent_transactions)
SELECT application_id, champion_pd FROM log ORDER BY timestamp DESC, application_id DESC LIMIT 20""",
    ),
)
def _(spark, folder):
    log = table(spark, folder, "recent_transactions").select(
        F.col("transaction_id").alias("application_id"),
        "timestamp",
        F.round(0.01 + F.col("amount") / 1000, 6).alias("champion_pd"),
    )
    return shadow.recent_comparisons(log).drop("timestamp")


@query(
    "single_model_challenger",
    with_views(["scored"], "SELECT borrower_id, round(challenger_pd, 6) AS pd FROM scored"),
)
def _(spark, folder):
    from riskloom.models.ensemble import combine

    scored = table(spark, folder, "scored")
    return rounded(scored.select("borrower_id", combine({m: 1.0 if m == "challenger_pd" else 0.0 for m in MODELS}).alias("pd")))
