"""Standardisers, stores and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.models import ensemble
from riskloom.operators import drift
from riskloom.operators.profile import borrower_features
from riskloom.session import materialize, shared_folder
from riskloom.sources import sinks, snapshot, standardize, store, tables

from .evaluation import _OWN_EAD, MODELS, SCORE_SQL, scored_applications
from .monitoring import _RATES as RATES_SQL
from .monitoring import COLUMNS, _features, _psi, _rates
from .registry import query, rounded
from .views import table, with_views

# A raw file of the first layout, derived from the customers.
_GMC = """SELECT c_custkey AS record, (c_custkey % 13 = 0)::INT AS dlq,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 300) / 1e2 END AS util, 20 + (c_custkey % 60)::INT AS age,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 3)::INT END AS n30,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey % 700) / 1e2 END AS debt,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1e3 + c_acctbal END AS income,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE (c_custkey % 20)::INT END AS lines,
  CASE WHEN c_custkey % 7 = 1 THEN NULL ELSE (c_custkey % 2)::INT END AS n90,
  CASE WHEN c_custkey % 7 = 2 THEN NULL ELSE (c_custkey % 4 = 3)::INT END AS n60 FROM customer"""


def _raw_gmc(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        k.alias("record"),
        (k % 13 == 0).cast("int").alias("SeriousDlqin2yrs"),
        F.when(k % 11 != 0, k % 300 / F.lit(1e2)).alias("RevolvingUtilizationOfUnsecuredLines"),
        (20 + k % 60).cast("int").alias("age"),
        F.when(k % 7 != 0, (k % 3).cast("int")).alias("NumberOfTime30-59DaysPastDueNotWorse"),
        F.when(k % 17 != 0, k % 700 / F.lit(1e2)).alias("DebtRatio"),
        F.when(k % 5 != 0, 1e3 + F.col("c_acctbal")).alias("MonthlyIncome"),
        F.when(k % 19 != 0, (k % 20).cast("int")).alias("NumberOfOpenCreditLinesAndLoans"),
        F.when(k % 7 != 1, (k % 2).cast("int")).alias("NumberOfTimes90DaysLate"),
        F.lit(None).cast("int").alias("NumberRealEstateLoansOrLines"),
        F.when(k % 7 != 2, (k % 4 == 3).cast("int")).alias("NumberOfTime60-89DaysPastDueNotWorse"),
        F.lit(None).cast("int").alias("NumberOfDependents"),
    )


_GMC_COLUMNS = ["borrower_id", "age", "annual_income", "existing_credit_lines", "credit_utilization_ratio",
                "number_of_delinquencies", "debt_to_income_ratio", "is_default"]
_GMC_SQL = f"""
SELECT printf('gmc-%06d', record) AS borrower_id, age, round(coalesce(income, 4500) * 12, 6) AS annual_income,
  coalesce(lines, 5) AS existing_credit_lines, round(least(greatest(coalesce(util, 0.5), 0), 2), 6)
  AS credit_utilization_ratio, (coalesce(n30, 0) + coalesce(n60, 0) + coalesce(n90, 0))::INT AS number_of_delinquencies,
  round(least(greatest(coalesce(debt, 0.3), 0), 5), 6) AS debt_to_income_ratio, dlq AS is_default FROM ({_GMC}) g"""


@query("standardize_give_me_credit", _GMC_SQL)
def _(spark, folder):
    return rounded(standardize.standardize_give_me_credit(_raw_gmc(spark, folder)).select(*_GMC_COLUMNS))


@query("raw_csv_round_trip", _GMC_SQL)
def _(spark, folder):
    path = shared_folder(spark, "raw-csv")
    _raw_gmc(spark, folder).write.option("header", True).option("nullValue", "NA").csv(path)
    raw = tables.read_raw_csv(spark, path, standardize.GIVE_ME_CREDIT_SCHEMA)
    return rounded(standardize.standardize_give_me_credit(raw).select(*_GMC_COLUMNS))


def _u(name: str) -> str:
    """A draw of the standardised layouts, of ``record`` with seed 42."""
    return f"(('0x' || substr(md5(record || ':42:{name}'), 1, 8))::BIGINT / 4294967296)"


def _between(name: str, low: float, high: float) -> str:
    return f"({low}::DOUBLE + {_u(name)} * {high - low}::DOUBLE)"


def _choice(name: str, shares: dict[str, float]) -> str:
    names, reached, cases = list(shares), 0.0, []
    for n in names[:-1]:
        reached += shares[n]
        cases.append(f"WHEN {_u(name)} < {reached}::DOUBLE THEN '{n}'")
    return f"CASE {' '.join(cases)} ELSE '{names[-1]}' END"


def _state(count: int) -> str:
    return f"{standardize.STATES[:count]}[floor({_between('state', 0, count)})::INT + 1]"


_EXPOSURE = f"""round(least(greatest(current_credit_balance + {_u('conversion')} ** 4
  * greatest(total_credit_limit - current_credit_balance, 0), current_credit_balance), total_credit_limit), 2)"""
_DRAWN = f"""floor({_between('account', 6, 180)})::INT AS account_age_months,
  round({_between('complete', 0.6, 1.0)}, 2) AS profile_completeness_score,
  {_choice('device', standardize.DEVICE_SHARES)} AS device_type, ({_u('fraud')} < 0.015::DOUBLE)::INT AS is_fraud,
  CASE WHEN is_default = 1 THEN round({_u('loss')} ** 2, 4) ELSE 0 END AS lgd_value, {_EXPOSURE} AS ead_value"""


@query(
    "standardize_drawn_attributes",
    f"""WITH g AS ({_GMC}), own AS ({_GMC_SQL.replace('SELECT printf', 'SELECT record, printf', 1)}),
mapped AS (SELECT *, round(least(greatest(-5 * ln(1 - {_u('job')}), 0), 40), 1) AS employment_length_years,
  {_choice('employment', standardize.EMPLOYMENT_SHARES)} AS employment_type,
  {_choice('home', standardize.HOME_SHARES)} AS home_ownership,
  CASE WHEN number_of_delinquencies > 0 THEN floor({_between('since', 1, 60)}) END AS months_since_last_delinquency,
  {_choice('purpose', standardize.PURPOSE_SHARES)} AS loan_purpose, {_state(20)} AS state,
  round(annual_income * {_between('limit', 0.3, 1.5)}, 2) AS total_credit_limit,
  round(annual_income * {_between('loan', 0.1, 0.5)}, 2) AS requested_loan_amount FROM own),
used AS (SELECT *, round(total_credit_limit * {_u('use')} ** 2.5, 2) AS current_credit_balance FROM mapped)
SELECT * EXCLUDE (record), {_DRAWN} FROM used""",
)
def _(spark, folder):
    return rounded(standardize.standardize_give_me_credit(_raw_gmc(spark, folder)))


_CLUB_SQL = """
WITH raw AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN '< 1 year'
    WHEN c_custkey % 9 = 2 THEN '10+ years' WHEN c_custkey % 9 = 3 THEN 'n/a' ELSE (c_custkey % 9) || ' years' END AS job,
  CASE c_custkey % 4 WHEN 0 THEN 'MORTGAGE' WHEN 1 THEN 'RENT' WHEN 2 THEN 'OWN' ELSE 'ANY' END AS home,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey % 150)::DOUBLE END AS util,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_custkey % 40)::DOUBLE END AS dti,
  CASE c_custkey % 6 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'small_business' WHEN 2 THEN 'educational'
    WHEN 3 THEN 'home_improvement' WHEN 4 THEN 'debt_consolidation' ELSE 'wedding' END AS purpose,
  CASE c_custkey % 5 WHEN 0 THEN 'Charged Off' WHEN 1 THEN 'Late (31-120 days)' WHEN 2 THEN 'Default'
    ELSE 'Fully Paid' END AS status FROM customer)
SELECT printf('lc-%06d', k) AS borrower_id, coalesce(nullif(regexp_extract(job, '(\\d+)', 1), '')::DOUBLE, 3)
  AS employment_length_years, CASE home WHEN 'MORTGAGE' THEN 'mortgage' WHEN 'OWN' THEN 'own' ELSE 'rent' END
  AS home_ownership, round(least(greatest(coalesce(util, 50) / 100, 0), 2), 6) AS credit_utilization_ratio,
  round(least(greatest(coalesce(dti, 15) / 100, 0), 5), 6) AS debt_to_income_ratio,
  CASE purpose WHEN 'credit_card' THEN 'debt_consolidation' WHEN 'small_business' THEN 'business'
    WHEN 'educational' THEN 'education' WHEN 'wedding' THEN 'personal' ELSE purpose END AS loan_purpose,
  (status <> 'Fully Paid')::INT AS is_default FROM raw"""


def _raw_club(spark, folder, *more):
    k = F.col("c_custkey")
    years = F.concat((k % 9).cast("string"), F.lit(" years"))
    job = F.when(k % 9 == 1, "< 1 year").when(k % 9 == 2, "10+ years").when(k % 9 == 3, "n/a").otherwise(years)
    homes = F.array(*[F.lit(x) for x in ("MORTGAGE", "RENT", "OWN", "ANY")])
    uses = F.array(
        *[
            F.lit(x)
            for x in ("credit_card", "small_business", "educational", "home_improvement", "debt_consolidation", "wedding")
        ]
    )
    status = F.array(
        *[F.lit(x) for x in ("Charged Off", "Late (31-120 days)", "Default", "Fully Paid", "Fully Paid")]
    )
    return table(spark, folder, "customer").select(
        k.alias("id"),
        F.when(k % 9 != 0, job).alias("emp_length"),
        F.get(homes, (k % 4).cast("int")).alias("home_ownership"),
        F.when(k % 6 != 0, (k % 150).cast("double")).alias("revol_util"),
        F.when(k % 10 != 0, (k % 40).cast("double")).alias("dti"),
        F.get(uses, (k % 6).cast("int")).alias("purpose"),
        F.get(status, (k % 5).cast("int")).alias("loan_status"),
        *more,
    )


@query("standardize_lending_club", _CLUB_SQL)
def _(spark, folder):
    return rounded(
        standardize.standardize_lending_club(_raw_club(spark, folder)).select(
            "borrower_id",
            "employment_length_years",
            "home_ownership",
            "credit_utilization_ratio",
            "debt_to_income_ratio",
            "loan_purpose",
            "is_default",
        )
    )


# More fields of the second layout, in words that both engines read alike.
_CLUB_FIELDS = {
    "annual_inc": "CASE WHEN {k} % 8 <> 0 THEN CAST(20000 + {k} * 31 % 70000 AS DOUBLE) END",
    "open_acc": "CASE WHEN {k} % 21 <> 0 THEN CAST({k} % 30 AS INT) END",
    "total_rev_hi_lim": "CASE WHEN {k} % 12 <> 0 THEN CAST(1000 + {k} * 7 % 60000 AS DOUBLE) END",
    "revol_bal": "CASE WHEN {k} % 14 <> 0 THEN CAST({k} * 11 % 40000 AS DOUBLE) END",
    "mths_since_last_delinq": "CASE WHEN {k} % 2 = 0 THEN CAST({k} % 80 AS DOUBLE) END",
    "delinq_2yrs": "CASE WHEN {k} % 15 <> 0 THEN CAST({k} % 4 AS INT) END",
    "loan_amnt": "CASE WHEN {k} % 16 <> 0 THEN CAST(1000 + {k} * 13 % 34000 AS DOUBLE) END",
}
_FIELDS_SQL = ", ".join(f"{text.format(k='k')} AS {name}" for name, text in _CLUB_FIELDS.items())


@query(
    "standardize_lending_club_all_columns",
    f"""WITH own AS (SELECT *, substr(borrower_id, 4)::BIGINT AS record, substr(borrower_id, 4)::BIGINT AS k FROM ({_CLUB_SQL}) c),
fields AS (SELECT *, {_FIELDS_SQL} FROM own),
mapped AS (SELECT * EXCLUDE (k, {', '.join(_CLUB_FIELDS)}), floor({_between('age', 22, 70)})::INT AS age,
  coalesce(annual_inc, 60000) AS annual_income, coalesce(open_acc, 8) AS existing_credit_lines,
  coalesce(total_rev_hi_lim, 30000) AS total_credit_limit, coalesce(revol_bal, 10000) AS current_credit_balance,
  mths_since_last_delinq AS months_since_last_delinquency, coalesce(delinq_2yrs, 0) AS number_of_delinquencies,
  coalesce(loan_amnt, 15000) AS requested_loan_amount, {_state(4)} AS state,
  {_choice('employment', standardize.CLUB_EMPLOYMENT_SHARES)} AS employment_type FROM fields)
SELECT * EXCLUDE (record), {_DRAWN} FROM mapped""",
)
def _(spark, folder):
    more = [F.expr(text.format(k="c_custkey")).alias(name) for name, text in _CLUB_FIELDS.items()]
    return rounded(standardize.standardize_lending_club(_raw_club(spark, folder, *more)))


@query(
    "feature_store_version",
    with_views(
        ["borrowers"],
        "SELECT borrower_id, round(credit_utilization_ratio, 6) AS credit_utilization_ratio FROM borrowers",
    ),
)
def _(spark, folder):
    path = shared_folder(spark, "features")
    features = table(spark, folder, "borrowers").select("borrower_id", "credit_utilization_ratio")
    store.save_version(features, path, "a")
    store.save_version(features.limit(0), path, "b")
    return rounded(store.load_version(spark, path, "a"))


@query(
    "feature_store_metadata",
    with_views(
        ["borrowers"],
        """SELECT c AS "column", t AS dtype, 2 AS n_columns, (SELECT count(*) FROM borrowers) AS n_rows
FROM (VALUES ('borrower_id', 'bigint'), ('credit_utilization_ratio', 'double')) v(c, t)""",
    ),
)
def _(spark, folder):
    path = shared_folder(spark, "features")
    features = table(spark, folder, "borrowers").select("borrower_id", "credit_utilization_ratio")
    store.save_version(features, path)
    return store.version_metadata(spark, path)


_NOW = "2024-01-30 12:00:00"


@query(
    "serving_snapshot",
    f"""SELECT user_id AS borrower_id, value AS last_amount, event_type AS last_event FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1 AND ts + INTERVAL 86400 SECOND
  > TIMESTAMP '{_NOW}'""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("borrower_id"),
        F.col("value").alias("last_amount"),
        F.col("event_type").alias("last_event"),
        "ts",
    )
    entries = store.snapshot_entries(events, "borrower_id", "ts", 86400)
    latest = store.latest_entries(entries, _NOW, "borrower_id")
    return store.read_features(latest, "borrower_id", "last_amount double, last_event string")


_LATEST_SQL = f"""SELECT user_id AS borrower_id, value AS last_amount, event_type AS last_event FROM events {{where}}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1 AND ts + INTERVAL 86400 SECOND
  > TIMESTAMP '{_NOW}'"""
_LAST = "last_amount double, last_event string"


def _kept_snapshot(spark, folder) -> str:
    """Four writes, the third of them twice, folded on the way."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("borrower_id"),
        F.col("value").alias("last_amount"),
        F.col("event_type").alias("last_event"),
        "ts",
    )
    path = shared_folder(spark, "snapshot")
    for batch in (0, 1, 2, 2, 3):
        part = events.where(F.pmod(F.xxhash64("ts"), F.lit(4)) == batch)
        entries = store.snapshot_entries(part, "borrower_id", "ts", 86400)
        snapshot.add_batch(entries, batch, path, "borrower_id", now=_NOW, buckets=8, compact_after=2)
    return path


@query("serving_snapshot_merged", _LATEST_SQL.format(where=""))
def _(spark, folder):
    kept = snapshot.read(spark, _kept_snapshot(spark, folder), "borrower_id", _NOW)
    return store.read_features(kept, "borrower_id", _LAST)


@query("serving_point_read", _LATEST_SQL.format(where="WHERE user_id IN (SELECT max(user_id) FROM events UNION SELECT min(user_id) FROM events)"))
def _(spark, folder):
    """The features of two borrowers: their buckets are opened, no others."""
    ends = table(spark, folder, "events").agg(F.min("user_id"), F.max("user_id")).first()
    asked = [k for k in ends if k is not None]
    kept = snapshot.read(spark, _kept_snapshot(spark, folder), "borrower_id", _NOW, keys=asked)
    return store.read_features(kept, "borrower_id", _LAST)


@query(
    "latest_row_per_borrower",
    "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def _(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return store.latest_rows(events, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "scoring_results_sink",
    with_views(
        ["scored"],
        f"""SELECT borrower_id AS application_id, borrower_id, credit_score, round(pd, 6) AS pd_value,
  round(lgd, 6) AS lgd_value, round(ead, 6) AS ead_value, round(expected_loss, 6) AS expected_loss, fraud_score, decision,
  '1.0.1' AS model_version, DATE '2024-02-01' AS day FROM ({SCORE_SQL.format(ead=_OWN_EAD)}) s""",
    ),
)
def _(spark, folder):
    path = shared_folder(spark, "scores")
    scored = scored_applications(spark, folder, ("borrower_id",)).withColumn("application_id", F.col("borrower_id"))
    sinks.append_scores(scored, path, "1.0.0", "2024-01-31 00:00:00")
    sinks.append_scores(scored, path, "1.0.1", "2024-02-01 00:00:00")
    return rounded(sinks.read_results(spark, path, since="2024-02-01").drop("scored_at"))


@query(
    "drift_metrics_sink",
    with_views(
        ["borrowers"],
        f"""WITH {_psi([drift.SCENARIOS[0]])}
SELECT feature AS feature_name, psi AS psi_value, status, DATE '2024-01-31' AS day FROM drift""",
    ),
)
def _(spark, folder):
    path = shared_folder(spark, "drift")
    reference = drift.reference_bins(_features(spark, folder), COLUMNS)
    stressed = borrower_features(drift.stressed_borrowers(table(spark, folder, "borrowers"), drift.SCENARIOS[0]))
    sinks.append_drift(drift.drift_table(stressed, reference, COLUMNS), path, "2024-01-31 00:00:00")
    return sinks.read_results(spark, path).drop("recorded_at")


@query(
    "fairness_metrics_sink",
    with_views(
        ["scored"],
        f"""WITH {RATES_SQL}
SELECT employment_type AS group_name, metric_name, round(value, 6) AS value, DATE '2024-01-31' AS day
FROM (UNPIVOT (SELECT employment_type, approval_rate, tpr, fpr FROM rates) ON approval_rate, tpr, fpr
  INTO NAME metric_name VALUE value)""",
    ),
)
def _(spark, folder):
    path = shared_folder(spark, "fairness")
    sinks.append_fairness(_rates(spark, folder), "employment_type", path, "2024-01-31 00:00:00")
    return rounded(sinks.read_results(spark, path).drop("recorded_at"))


@query(
    "ensemble_average",
    with_views(
        ["scored"], "SELECT borrower_id, round((3 * pd + 1 * challenger_pd) / 4, 9) AS ensemble_pd FROM scored"
    ),
)
def _(spark, folder):
    scored = table(spark, folder, "scored")
    return rounded(
        scored.select("borrower_id", ensemble.combine({"pd": 3.0, "challenger_pd": 1.0}).alias("ensemble_pd")), 9
    )


@query(
    "ensemble_weights_reloaded",
    with_views(
        ["scored"],
        """SELECT borrower_id, round(pd * (5.0 / 8) + challenger_pd * (3.0 / 8), 9) AS ensemble_pd FROM scored""",
    ),
)
def _(spark, folder):
    path = shared_folder(spark, "weights")
    ensemble.save_weights(spark, {"pd": 0.5, "challenger_pd": 0.3, "absent_model": 0.2}, path)
    weights = ensemble.load_weights(spark, path, MODELS)
    return rounded(table(spark, folder, "scored").select("borrower_id", ensemble.combine(weights).alias("ensemble_pd")), 9)


_GRID = ensemble.weight_grid(MODELS)
_GRID_VALUES = ", ".join(f"({i}, {w['pd']}, {w['challenger_pd']}, {w['rough_pd']})" for i, w in enumerate(_GRID))


_GRID_AUC = f"""WITH grid AS (SELECT * FROM (VALUES {_GRID_VALUES}) t(candidate, a, b, c)),
p AS (SELECT candidate, is_default AS label, a::DOUBLE * pd + b::DOUBLE * challenger_pd + c::DOUBLE * rough_pd AS prob
  FROM scored CROSS JOIN grid),
d AS (SELECT candidate, prob, sum(label) AS pos, count(*) - sum(label) AS neg FROM p GROUP BY ALL),
s AS (SELECT *, sum(pos) OVER u AS pc, sum(pos) OVER t AS pa, sum(neg) OVER t AS na FROM d
  WINDOW u AS (PARTITION BY candidate ORDER BY prob ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY candidate)),
m AS (SELECT candidate, sum(neg * (pa - pc + pos / 2)) / max(pa * na) AS auc_roc FROM s GROUP BY candidate)"""


@query(
    "ensemble_weight_grid",
    with_views(["scored"], f"{_GRID_AUC} SELECT candidate, round(auc_roc, 5) AS auc_roc FROM m"),
)
def _(spark, folder):
    return rounded(ensemble.weight_metrics(table(spark, folder, "scored"), _GRID, "is_default"), 5)


@query(
    "ensemble_weight_bounds",
    with_views(["scored"], f"{_GRID_AUC} SELECT candidate, round(auc_roc, 5) AS auc_roc, true AS within FROM m"),
)
def _(spark, folder):
    """The bounds from bucket counts enclose the exact AUC of every candidate."""
    scored = materialize(table(spark, folder, "scored").select("is_default", *MODELS), "scores")
    exact = ensemble.weight_metrics(scored, _GRID, "is_default").join(ensemble.auc_bounds(scored, _GRID, "is_default"), "candidate")
    within = (F.col("lower") <= F.col("auc_roc") + 1e-12) & (F.col("auc_roc") <= F.col("upper") + 1e-12)
    return rounded(exact.select("candidate", "auc_roc", within.alias("within")), 5)


_WINNER = f"""{_GRID_AUC},
w AS (SELECT a::DOUBLE AS pd, b::DOUBLE AS challenger_pd, c::DOUBLE AS rough_pd FROM m JOIN grid USING (candidate)
  ORDER BY auc_roc DESC, candidate LIMIT 1)
SELECT model, round(weight, 6) AS weight FROM (UNPIVOT w ON pd, challenger_pd, rough_pd INTO NAME model VALUE weight)"""


@query("ensemble_weight_winner", with_views(["scored"], _WINNER))
def _(spark, folder):
    """The best of all weights of the grid, found by bounds first."""
    scored = materialize(table(spark, folder, "scored").select("is_default", *MODELS), "scores")
    return rounded(ensemble.weights_table(spark, ensemble.search_weights(scored, MODELS, "is_default", refine=0)))
