"""Assembly, encoding, imputation and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import assemble, encode, profile, registry, split
from riskloom.operators.payments import PAYMENT_FEATURES
from riskloom.operators.transactions import TRANSACTION_FEATURES
from riskloom.session import materialize

from .evaluation import _RANKED
from .features import CREDIT_SQL, PROFILE_SQL, RATIO_SQL, _payment_sql, _transaction_sql
from .registry import FINER, query, rounded
from .views import LONG_REFERENCE, table, with_views

VOCABULARY = {
    "employment_type": ["employed", "retired", "self_employed", "unemployed"],
    "home_ownership": ["mortgage", "own", "rent"],
    "loan_purpose": ["business", "debt_consolidation", "education", "home_improvement", "personal"],
    "device_type": ["desktop", "mobile", "tablet"],
}
NUMERIC = [
    *profile.PROFILE_FEATURES,
    *profile.CREDIT_FEATURES,
    *TRANSACTION_FEATURES,
    *PAYMENT_FEATURES,
    *profile.RATIO_FEATURES,
]
MATRIX_VIEWS = ["borrowers", "long_transactions", "payments"]

RAW_CTES = f"""
WITH own AS (SELECT borrower_id, is_default, employment_type, home_ownership, loan_purpose, device_type, state,
  {PROFILE_SQL}, {CREDIT_SQL}, {RATIO_SQL} FROM borrowers),
txn AS ({_transaction_sql("long_transactions", LONG_REFERENCE, None)}),
pay AS ({_payment_sql(None)}),
raw AS (SELECT own.* REPLACE (coalesce(months_since_last_delinquency, -1) AS months_since_last_delinquency),
    (months_since_last_delinquency IS NOT NULL)::INT::DOUBLE AS has_delinquency,
    txn.* EXCLUDE (borrower_id), pay.* EXCLUDE (borrower_id)
  FROM own LEFT JOIN txn USING (borrower_id) LEFT JOIN pay USING (borrower_id))"""
_ONE_HOT_SQL = ",\n".join(
    f"coalesce(({c} = '{v}')::INT, 0)::DOUBLE AS {c}_{v}" for c, values in VOCABULARY.items() for v in values
)
_MEDIAN_CTE = "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC) + " FROM raw)"
_FILLED_SQL = ",\n".join(
    f"round(coalesce(raw.{c}::DOUBLE, med.{c}::DOUBLE, 0), {FINER.get(c, 6)}) AS {c}" for c in NUMERIC
)


def matrix_sql(select_state: str) -> str:
    return with_views(
        MATRIX_VIEWS,
        f"""{RAW_CTES}, {_MEDIAN_CTE},
means AS (SELECT state, avg(is_default) AS state_mean FROM borrowers GROUP BY state)
SELECT borrower_id, {_FILLED_SQL}, {_ONE_HOT_SQL}, {select_state} AS state_encoded, has_delinquency
FROM raw CROSS JOIN med LEFT JOIN means USING (state)""",
    )


def _inputs(spark, folder):
    return [table(spark, folder, name) for name in MATRIX_VIEWS]


def _raw(spark, folder):
    return materialize(assemble.raw_features(*_inputs(spark, folder), LONG_REFERENCE), "raw-features")


@query("feature_matrix", matrix_sql("round(state_mean, 6)"))
def _(spark, folder):
    matrix, _ = assemble.feature_matrix(*_inputs(spark, folder), LONG_REFERENCE, label="is_default")
    return rounded(matrix)


@query("feature_matrix_without_label", matrix_sql("0.08::DOUBLE"))
def _(spark, folder):
    matrix, _ = assemble.feature_matrix(*_inputs(spark, folder), LONG_REFERENCE)
    return rounded(matrix)


@query(
    "feature_medians",
    with_views(
        MATRIX_VIEWS,
        f"""{RAW_CTES}, {_MEDIAN_CTE}
SELECT feature, round(median, 6) AS median FROM (UNPIVOT (SELECT {", ".join(f"{c}::DOUBLE AS {c}" for c in NUMERIC)}
  FROM med) ON {", ".join(NUMERIC)} INTO NAME feature VALUE median)""",
    ),
)
def _(spark, folder):
    raw = encode.flag_delinquency(_raw(spark, folder))
    return rounded(encode.feature_medians(raw, NUMERIC))


@query("feature_medians_approximate")
def _(spark, folder):
    raw = encode.flag_delinquency(_raw(spark, folder))
    return rounded(encode.feature_medians(raw, NUMERIC, approximate=True))


@query("one_hot", with_views(["borrowers"], f"SELECT borrower_id, {_ONE_HOT_SQL} FROM borrowers"))
def _(spark, folder):
    borrowers = table(spark, folder, "borrowers").select("borrower_id", *VOCABULARY)
    rows = encode.category_values(borrowers).collect()
    vocabulary = {c: sorted(r["value"] for r in rows if r["feature"] == c) for c in VOCABULARY}
    return encode.one_hot(borrowers, vocabulary)


@query(
    "category_values",
    with_views(
        ["borrowers"],
        " UNION ALL ".join(
            f"SELECT DISTINCT '{c}' AS feature, {c} AS value FROM borrowers WHERE {c} IS NOT NULL" for c in VOCABULARY
        ),
    ),
)
def _(spark, folder):
    return encode.category_values(table(spark, folder, "borrowers"))


@query(
    "state_target_encoding",
    with_views(
        ["borrowers"],
        """SELECT borrower_id, round(avg(is_default) OVER (PARTITION BY state), 6) AS state_encoded FROM borrowers""",
    ),
)
def _(spark, folder):
    borrowers = table(spark, folder, "borrowers")
    means = encode.state_means(borrowers, "is_default")
    return rounded(encode.encode_state(borrowers.select("borrower_id", "state"), means))


@query(
    "state_encoding_out_of_fold",
    with_views(
        ["borrowers"],
        f"""WITH f AS (SELECT borrower_id, state, is_default, (r - 1) % 3 AS fold FROM ({_RANKED.format(by='is_default')}) z)
SELECT a.borrower_id, round(coalesce(avg(b.is_default), 0.08), 6) AS state_encoded
FROM f a LEFT JOIN f b ON a.state = b.state AND a.fold <> b.fold GROUP BY a.borrower_id""",
    ),
)
def _(spark, folder):
    """Each borrower's state mean comes from the other two of three stratified folds."""
    borrowers = split.fold_column(table(spark, folder, "borrowers").select("borrower_id", "state", "is_default"), "is_default")
    return rounded(encode.encode_state_out_of_fold(borrowers, "is_default").select("borrower_id", "state_encoded"))


@query(
    "delinquency_flag",
    with_views(
        ["borrowers"],
        """SELECT borrower_id, coalesce(months_since_last_delinquency, -1) AS months_since_last_delinquency,
  (months_since_last_delinquency IS NOT NULL)::INT::DOUBLE AS has_delinquency FROM borrowers""",
    ),
)
def _(spark, folder):
    borrowers = table(spark, folder, "borrowers").select("borrower_id", "months_since_last_delinquency")
    return encode.flag_delinquency(borrowers)


@query(
    "application_features_aligned",
    with_views(
        ["borrowers"],
        f"""
WITH filled AS (SELECT * REPLACE (coalesce(CASE WHEN borrower_id % 4 = 0 THEN NULL ELSE credit_utilization_ratio END,
    current_credit_balance / greatest(total_credit_limit, 1)) AS credit_utilization_ratio) FROM borrowers),
own AS (SELECT borrower_id, employment_type, home_ownership, loan_purpose, device_type,
  {PROFILE_SQL}, {CREDIT_SQL}, {RATIO_SQL} FROM filled)
SELECT borrower_id AS application_id, {", ".join(
    f"round(coalesce({c}, {'-1' if c.startswith('months') else '0'}), 6) AS {c}"
    for c in [*profile.PROFILE_FEATURES, *profile.CREDIT_FEATURES, *profile.RATIO_FEATURES])},
  {", ".join(f"0::DOUBLE AS {c}" for c in [*TRANSACTION_FEATURES, *PAYMENT_FEATURES])},
  {_ONE_HOT_SQL}, 0.08::DOUBLE AS state_encoded,
  (months_since_last_delinquency IS NOT NULL)::INT::DOUBLE AS has_delinquency
FROM own""",
    ),
)
def _(spark, folder):
    hidden = F.when(F.col("borrower_id") % 4 != 0, F.col("credit_utilization_ratio"))
    applications = (
        table(spark, folder, "borrowers")
        .withColumn("credit_utilization_ratio", hidden)
        .withColumnRenamed("borrower_id", "application_id")
    )
    columns = [
        *NUMERIC,
        *[f"{c}_{v}" for c, values in VOCABULARY.items() for v in values],
        "state_encoded",
        "has_delinquency",
    ]
    model = encode.FeatureModel(VOCABULARY, {}, columns)
    return rounded(model.transform(profile.application_features(applications), ["application_id"]))


@query(
    "cross_features",
    with_views(
        ["borrowers"],
        f"""SELECT borrower_id, round(credit_utilization_ratio * debt_to_income_ratio, 6) AS utilization_x_dti_cross,
  round(log_annual_income * loan_to_income_ratio, 6) AS income_x_loan_cross,
  round(number_of_delinquencies * credit_utilization_ratio, 6) AS delinquency_x_utilization_cross
FROM (SELECT borrower_id, {PROFILE_SQL}, {CREDIT_SQL}, {RATIO_SQL} FROM borrowers) a""",
    ),
)
def _(spark, folder):
    return rounded(profile.cross_features(profile.borrower_features(table(spark, folder, "borrowers"))))


@query(
    "clean_and_drop_targets",
    with_views(
        ["borrowers"],
        """SELECT borrower_id, coalesce(annual_income, 0) AS annual_income,
  coalesce(employment_length_years, 0) AS employment_length_years FROM borrowers""",
    ),
)
def _(spark, folder):
    picked = table(spark, folder, "borrowers").select(
        "borrower_id", "annual_income", "employment_length_years", "is_default", "is_fraud", "lgd_value", "ead_value"
    )
    return assemble.clean(assemble.drop_targets(picked))


@query(
    "labels_by_key",
    with_views(
        ["borrowers"],
        f"""SELECT borrower_id, round(credit_utilization_ratio, 6) AS credit_utilization_ratio, is_default, is_fraud,
  round(lgd_value, 6) AS lgd_value, round(ead_value, 6) AS ead_value FROM borrowers""",
    ),
)
def _(spark, folder):
    borrowers = table(spark, folder, "borrowers")
    features = profile.credit_features(borrowers).select("borrower_id", "credit_utilization_ratio")
    assemble.require_labels(features, borrowers)
    return rounded(assemble.with_labels(features, borrowers))


@query(
    "feature_coverage_by_group",
    with_views(
        MATRIX_VIEWS,
        f"""{RAW_CTES},
filled AS (UNPIVOT (SELECT {", ".join(f"count({c}) AS {c}" for c in NUMERIC)} FROM raw)
  ON {", ".join(NUMERIC)} INTO NAME name VALUE filled_rows),
groups AS (SELECT * FROM (VALUES {", ".join(f"('{d[0]}', '{d[3]}')" for d in registry.DEFINITIONS)}) t(name, "group"))
SELECT "group", count(*) AS features, sum(filled_rows)::BIGINT AS filled_values
FROM groups LEFT JOIN filled USING (name) GROUP BY "group" """,
    ),
)
def _(spark, folder):
    raw = encode.flag_delinquency(_raw(spark, folder))
    covered = registry.registered_columns(raw, registry.feature_registry(spark))
    return covered.groupBy("group").agg(
        F.count(F.lit(1)).alias("features"), F.sum("filled_rows").alias("filled_values")
    )


@query("feature_scaling", with_views(
    ["borrowers"],
    """
WITH s AS (SELECT avg(total_credit_limit) AS m1, stddev_pop(total_credit_limit) AS s1,
  avg(debt_to_income_ratio) AS m2, stddev_pop(debt_to_income_ratio) AS s2 FROM borrowers)
SELECT borrower_id, round((total_credit_limit - m1) / s1, 6) AS total_credit_limit,
  round((debt_to_income_ratio - m2) / s2, 6) AS debt_to_income_ratio FROM borrowers CROSS JOIN s""",
))
def _(spark, folder):
    from riskloom.operators.scale import fit_scaling, scale

    borrowers = table(spark, folder, "borrowers").select("borrower_id", "total_credit_limit", "debt_to_income_ratio")
    columns = ["total_credit_limit", "debt_to_income_ratio"]
    return rounded(scale(borrowers, fit_scaling(borrowers, columns)))
