"""Table validation and quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import quality
from riskloom.sources.schemas import BORROWER_COLUMNS, EMPLOYMENT_TYPES, PAYMENT_COLUMNS, TRANSACTION_COLUMNS

from .registry import query
from .views import table, with_views


def _check(name: str, passed: str, details: str, source: str) -> str:
    return f"SELECT '{name}' AS \"check\", {passed} AS passed, {details} AS details FROM {source}"


_SCHEMA = "SELECT 'schema' AS \"check\", true AS passed, 'Missing columns: ' AS details"
_BORROWER_SQL = " UNION ALL ".join(
    [
        _check("min_rows", "count(*) >= 1000", "printf('Got %d rows, need 1000', count(*))", "borrowers"),
        _SCHEMA,
        _check(
            "borrower_id_unique",
            "count(*) = count(DISTINCT borrower_id)",
            "printf('Duplicate borrower_ids: %d', count(*) - count(DISTINCT borrower_id))",
            "borrowers",
        ),
        *[
            _check(
                f"null_{c}",
                f"avg(({c} IS NULL)::INT) <= 0.05",
                f"printf('{c}: %.3f null fraction', avg(({c} IS NULL)::INT))",
                "borrowers",
            )
            for c in quality.REQUIRED_BORROWER_COLUMNS
        ],
        _check("age_range", "bool_and(coalesce(age BETWEEN 18 AND 100, false))", "'Age out of [18, 100]'", "borrowers"),
        _check("income_positive", "bool_and(coalesce(annual_income > 0, false))", "'Negative income found'", "borrowers"),
        _check(
            "utilization_range",
            "bool_and(coalesce(credit_utilization_ratio BETWEEN 0 AND 2, false))",
            "'Utilization out of [0, 2.0]'",
            "borrowers",
        ),
        _check(
            "default_rate",
            "avg(is_default) BETWEEN 0.01 AND 0.30",
            "printf('Default rate %.3f outside [0.01, 0.30]', avg(is_default))",
            "borrowers",
        ),
        _check(
            "employment_type_valid",
            f"bool_and(coalesce(employment_type IN {tuple(EMPLOYMENT_TYPES)}, false))",
            "printf('Rows with an invalid employment type: %d (values: %s)', count(*) FILTER"
            f" (NOT coalesce(employment_type IN {tuple(EMPLOYMENT_TYPES)}, false)),"
            " (SELECT coalesce(string_agg(v, ', ' ORDER BY v), '') FROM (SELECT DISTINCT coalesce(employment_type, 'null')"
            f" AS v FROM borrowers WHERE NOT coalesce(employment_type IN {tuple(EMPLOYMENT_TYPES)}, false)) d))",
            "borrowers",
        ),
    ]
)


@query("validate_borrowers", with_views(["borrowers"], _BORROWER_SQL))
def _(spark, folder):
    return quality.validate_borrowers(table(spark, folder, "borrowers"))


_INTEGRITY = (
    "SELECT 'referential_integrity' AS \"check\", count(*) = 0 AS passed,"
    " printf('%d unknown borrower_ids', count(*)) AS details FROM (SELECT DISTINCT borrower_id FROM {t}"
    " WHERE borrower_id NOT IN (SELECT borrower_id FROM known)) u"
)


@query(
    "validate_transactions",
    with_views(
        ["long_transactions", "borrowers"],
        "WITH known AS (SELECT borrower_id FROM borrowers WHERE borrower_id % 50 <> 7) "
        + " UNION ALL ".join(
            [
                _SCHEMA,
                _check("amount_positive", "bool_and(amount > 0)", "'Non-positive amounts found'", "long_transactions"),
                _INTEGRITY.format(t="long_transactions"),
            ]
        ),
    ),
)
def _(spark, folder):
    known = table(spark, folder, "borrowers").filter(F.col("borrower_id") % 50 != 7)
    return quality.validate_transactions(table(spark, folder, "long_transactions"), known)


@query(
    "unknown_borrowers_in_transactions",
    with_views(
        ["long_transactions", "borrowers"],
        """SELECT DISTINCT t.borrower_id FROM long_transactions t
ANTI JOIN (SELECT borrower_id FROM borrowers WHERE borrower_id % 50 <> 7) b ON t.borrower_id = b.borrower_id""",
    ),
)
def _(spark, folder):
    known = table(spark, folder, "borrowers").filter(F.col("borrower_id") % 50 != 7)
    return quality.unknown_keys(table(spark, folder, "long_transactions"), known, "borrower_id")


@query(
    "validate_payments",
    with_views(
        ["payments", "borrowers"],
        "WITH known AS (SELECT borrower_id FROM borrowers) "
        + " UNION ALL ".join(
            [
                _SCHEMA,
                *[
                    _check(f"{c}_non_negative", f"bool_and({c} >= 0)", f"'Negative {c}'", "payments")
                    for c in ("amount_due", "amount_paid", "days_past_due")
                ],
                _INTEGRITY.format(t="payments"),
            ]
        ),
    ),
)
def _(spark, folder):
    return quality.validate_payments(table(spark, folder, "payments"), table(spark, folder, "borrowers"))


@query(
    "validate_features",
    with_views(
        ["borrowers"],
        """
WITH f AS (SELECT borrower_id, CASE WHEN borrower_id % 100 = 0 THEN 'inf'::DOUBLE ELSE annual_income END AS income,
  0.08::DOUBLE AS state_encoded FROM borrowers)
SELECT 'no_infinities' AS "check", count(*) FILTER (isinf(income)) = 0 AS passed,
  printf('%d infinite values found', count(*) FILTER (isinf(income))) AS details FROM f
UNION ALL SELECT 'no_zero_variance', true, 'Zero variance columns: state_encoded' FROM f
  HAVING min(state_encoded) = max(state_encoded)""",
    ),
)
def _(spark, folder):
    income = F.when(F.col("borrower_id") % 100 == 0, F.lit(float("inf"))).otherwise(F.col("annual_income"))
    features = table(spark, folder, "borrowers").select(
        "borrower_id", income.alias("income"), F.lit(0.08).alias("state_encoded")
    )
    return quality.validate_features(features)


@query(
    "invalid_employment_values",
    with_views(
        ["borrowers"],
        f"""SELECT employment_type, count(*) AS rows FROM borrowers
WHERE NOT coalesce(employment_type IN {tuple(EMPLOYMENT_TYPES)}, false) GROUP BY employment_type""",
    ),
)
def _(spark, folder):
    return quality.invalid_values(table(spark, folder, "borrowers"), "employment_type", EMPLOYMENT_TYPES)


@query(
    "validation_overall",
    with_views(
        ["borrowers"],
        f"""SELECT bool_and(passed) AS passed, count(*) AS checks, count(*) FILTER (NOT passed) AS failed
FROM ({_BORROWER_SQL}) c""",
    ),
)
def _(spark, folder):
    return quality.overall(quality.validate_borrowers(table(spark, folder, "borrowers")))


_APPLICATION_CASES = [
    ("annual_income", "annual_income > 0"),
    ("employment_length_years", "employment_length_years >= 0"),
    ("profile_completeness_score", "profile_completeness_score BETWEEN 0 AND 1"),
    ("employment_type", "employment_type IS NOT NULL"),
]


def _applications(spark, folder):
    return table(spark, folder, "borrowers").withColumn("application_id", F.col("borrower_id"))


@query(
    "valid_applications",
    with_views(
        ["borrowers"],
        "SELECT borrower_id AS application_id FROM borrowers WHERE "
        + " AND ".join(f"coalesce({c}, false)" for _, c in _APPLICATION_CASES),
    ),
)
def _(spark, folder):
    valid, _ = quality.split_valid(_applications(spark, folder), quality.application_rules())
    return valid.select("application_id")


@query(
    "quarantined_applications",
    with_views(
        ["borrowers"],
        "SELECT * FROM (SELECT borrower_id AS application_id, concat_ws(',', "
        + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _APPLICATION_CASES)
        + ") AS reasons FROM borrowers) q WHERE reasons <> ''",
    ),
)
def _(spark, folder):
    _, rejected = quality.split_valid(_applications(spark, folder), quality.application_rules())
    return rejected.select("application_id", F.concat_ws(",", "violations").alias("reasons"))


def _reasons_sql(view: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS reason, count(*) FILTER (NOT coalesce({c}, false)) AS rows FROM {view}) r"
        " WHERE rows > 0"
        for n, c in rules.items()
    )


@query(
    "borrower_violations",
    with_views(
        ["borrowers"],
        _reasons_sql(
            "borrowers",
            {
                **dict(_APPLICATION_CASES[:3]),
                "employment_type": f"employment_type IN {tuple(EMPLOYMENT_TYPES)}",
                "state": "length(state) = 2",
            },
        ),
    ),
)
def _(spark, folder):
    return quality.violation_counts(table(spark, folder, "borrowers"), quality.borrower_rules())


@query(
    "transaction_violations",
    with_views(
        ["recent_transactions"],
        "WITH t AS (SELECT * REPLACE (amount - 2 AS amount) FROM recent_transactions) "
        + _reasons_sql("t", {"amount": "amount > 0"}),
    ),
)
def _(spark, folder):
    shifted = table(spark, folder, "recent_transactions").withColumn("amount", F.col("amount") - 2)
    return quality.violation_counts(shifted, quality.transaction_rules())


@query(
    "payment_violations",
    with_views(
        ["payments"],
        "WITH p AS (SELECT * REPLACE (days_past_due - 1 AS days_past_due) FROM payments) "
        + _reasons_sql("p", {"days_past_due": "days_past_due >= 0"}),
    ),
)
def _(spark, folder):
    shifted = table(spark, folder, "payments").withColumn("days_past_due", F.col("days_past_due") - 1)
    return quality.violation_counts(shifted, quality.payment_rules())


@query("standard_columns", with_views(["borrowers"], f"SELECT {', '.join(BORROWER_COLUMNS)} FROM borrowers"))
def _(spark, folder):
    return table(spark, folder, "borrowers").select(*BORROWER_COLUMNS)


@query(
    "load_all_tables",
    with_views(
        ["borrowers", "long_transactions", "payments"],
        f"""SELECT 'borrowers' AS name, count(*) AS rows, {len(BORROWER_COLUMNS)} AS columns FROM borrowers
UNION ALL SELECT 'transactions', count(*), {len(TRANSACTION_COLUMNS)} FROM long_transactions
UNION ALL SELECT 'payments', count(*), {len(PAYMENT_COLUMNS)} FROM payments""",
    ),
)
def _(spark, folder):
    from riskloom.session import shared_folder
    from riskloom.sources.tables import read_bundle, write_bundle

    bundle = {
        "borrowers": table(spark, folder, "borrowers"),
        "transactions": table(spark, folder, "long_transactions"),
        "payments": table(spark, folder, "payments"),
    }
    path = shared_folder(spark, "bundle")
    write_bundle(bundle, path)
    counts = None
    for name, df in read_bundle(spark, path, schemas={n: d.schema for n, d in bundle.items()}).items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts
