"""Contributions and adverse-action reasons of a linear model."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import explain, profile
from riskloom.operators.scale import fit_scaling
from riskloom.session import computed_once

from .features import CREDIT_SQL, PROFILE_SQL, RATIO_SQL
from .evaluation import SCORE_SQL, _OWN_EAD, scored_applications
from .registry import query, rounded
from .views import table, with_views

# Coefficients of a linear model on scaled features.
COEFFICIENTS = {
    "age": 0.31,
    "log_annual_income": -0.52,
    "employment_length_years": -0.17,
    "account_age_months": -0.23,
    "profile_completeness_score": -0.11,
    "credit_utilization_ratio": 0.83,
    "existing_credit_lines": 0.07,
    "months_since_last_delinquency": 0.19,
    "number_of_delinquencies": 0.61,
    "debt_to_income_ratio": 0.73,
    "loan_to_income_ratio": 0.29,
    "balance_to_income_ratio": 0.13,
    "utilization_x_dti": 0.41,
    "income_stability_proxy": -0.05,
}
FEATURES = list(COEFFICIENTS)
_FILLED = ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in FEATURES)
_BASE = f"""
WITH own AS (SELECT borrower_id, {PROFILE_SQL}, {CREDIT_SQL}, {RATIO_SQL} FROM borrowers),
filled AS (SELECT borrower_id, {_FILLED} FROM own),
long AS (UNPIVOT filled ON {", ".join(FEATURES)} INTO NAME feature VALUE value),
stats AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd FROM long GROUP BY feature),
coef AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {w}::DOUBLE)" for f, w in COEFFICIENTS.items())}) t(feature, w)),
contrib AS (SELECT borrower_id, feature, value, w * (value - mean) / sd AS c FROM long JOIN stats USING (feature)
  JOIN coef USING (feature)),
placed AS (SELECT borrower_id, feature, value, c, CASE WHEN c > 0 THEN 'increases_risk' ELSE 'decreases_risk' END
  AS direction, row_number() OVER (PARTITION BY borrower_id ORDER BY abs(c) DESC, feature) AS place FROM contrib)"""
_CODED = {f: c for f, c in explain.REASON_CODES.items() if f not in explain.PROTECTED_FEATURES}
_REASONS = f"""{_BASE},
codes AS (SELECT * FROM (VALUES {", ".join(f"('{f}', '{c}', '{d}')" for f, (c, d) in _CODED.items())})
  t(feature, code, description)),
reasons AS (SELECT borrower_id, code, description, feature, abs(c) AS impact,
    row_number() OVER (PARTITION BY borrower_id ORDER BY place) AS slot
  FROM placed JOIN codes USING (feature) WHERE direction = 'increases_risk' QUALIFY slot <= 4)"""


def _filled(borrowers):
    return profile.borrower_features(borrowers).select(
        "borrower_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES]
    )


def _explained(spark, folder):
    filled = _filled(table(spark, folder, "borrowers"))
    return explain.linear_contributions(filled, COEFFICIENTS, fit_scaling(filled, FEATURES))


@query(
    "linear_contributions",
    with_views(
        ["borrowers"],
        _BASE + " SELECT borrower_id, feature, round(value, 6) AS value, round(c, 6) AS contribution, direction FROM placed",
    ),
)
def _(spark, folder):
    rows = explain.contribution_rows(_explained(spark, folder), "borrower_id")
    return rounded(rows.drop("place"))


@query(
    "global_importance",
    with_views(
        ["borrowers"], _BASE + " SELECT feature, round(avg(abs(c)), 6) AS importance FROM placed GROUP BY feature"
    ),
)
def _(spark, folder):
    return rounded(explain.global_importance(_explained(spark, folder), FEATURES))


def _listed(column: str, condition: str, n: int):
    return with_views(
        ["borrowers"],
        _BASE
        + f""", chosen AS (SELECT *, row_number() OVER (PARTITION BY borrower_id ORDER BY place) AS slot FROM placed
  WHERE {condition} QUALIFY slot <= {n})
SELECT borrower_id, slot::INT AS place, feature, round(c, 6) AS contribution FROM chosen""",
    )


def _factors(spark, folder, column, n=explain.MAX_LISTED):
    local = explain.local_explanation(_explained(spark, folder), "borrower_id", n)
    return rounded(explain.contribution_rows(local, "borrower_id", column).drop("value", "direction"))


@query("top_risk_factors", _listed("top_risk_factors", "direction = 'increases_risk'", 5))
def _(spark, folder):
    return _factors(spark, folder, "top_risk_factors")


@query("top_protective_factors", _listed("top_protective_factors", "direction = 'decreases_risk'", 5))
def _(spark, folder):
    return _factors(spark, folder, "top_protective_factors")


@query("explanation_listing", _listed("feature_contributions", "true", 20))
def _(spark, folder):
    return _factors(spark, folder, "feature_contributions", 20)


@query(
    "adverse_action_reasons",
    with_views(
        ["borrowers"],
        _REASONS + " SELECT borrower_id, code, description, feature, round(impact, 6) AS impact_score FROM reasons",
    ),
)
def _(spark, folder):
    reasoned = explain.adverse_reasons(_explained(spark, folder))
    return rounded(explain.reason_rows(reasoned, "borrower_id"))


@query(
    "adverse_action_notices_for_declined",
    with_views(
        ["borrowers", "scored"],
        f"""{_REASONS},
decided AS ({SCORE_SQL.format(ead=_OWN_EAD)})
SELECT borrower_id, string_agg(code || ': ' || description, '; ' ORDER BY slot) AS notice
FROM reasons WHERE borrower_id IN (SELECT borrower_id FROM decided WHERE decision = 'declined') GROUP BY borrower_id""",
    ),
)
def _(spark, folder):
    filled = _filled(table(spark, folder, "borrowers"))
    decided = scored_applications(spark, folder).select("borrower_id", "decision")
    owed = filled.join(explain.declined_only(decided).select("borrower_id"), "borrower_id", "left_semi")
    explained = explain.linear_contributions(owed, COEFFICIENTS, fit_scaling(filled, FEATURES))
    notices = explain.notice(explain.adverse_reasons(explained), "borrower_id")
    lines = F.transform("adverse_action_reasons", lambda r: F.concat(r["code"], F.lit(": "), r["reason"]))
    written = computed_once(notices.select("borrower_id", F.array_join(lines, "; ").alias("notice")))
    return written.filter("notice <> ''")


@query(
    "reason_code_usage",
    with_views(
        ["borrowers"],
        _REASONS
        + """ SELECT feature, code, description AS reason, (SELECT count(*) FROM reasons r WHERE r.code = codes.code)
  AS applications FROM codes""",
    ),
)
def _(spark, folder):
    reasoned = explain.adverse_reasons(_explained(spark, folder))
    used = explain.reason_rows(reasoned, "borrower_id").groupBy("code").agg(F.count(F.lit(1)).alias("applications"))
    listed = explain.reason_codes(spark).join(used, "code", "left")
    return listed.select("feature", "code", "reason", F.coalesce("applications", F.lit(0)).alias("applications"))
