"""Lending tables derived from the driver's tables.

Each view is one SQL text that Spark and DuckDB read alike: ``{name}`` stands for a source
table. Numbers that carry a fraction are written as 5e-1 so that both engines type them as
double.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RECENT_REFERENCE = "2024-01-31"
LONG_REFERENCE = "2001-08-01"

BORROWERS = """
SELECT k AS borrower_id, age, annual_income, employment_length_years, employment_type, home_ownership,
  existing_credit_lines, total_credit_limit, current_credit_balance, credit_utilization_ratio,
  months_since_last_delinquency, number_of_delinquencies, debt_to_income_ratio, requested_loan_amount,
  loan_purpose, state, account_age_months, profile_completeness_score, device_type, is_default, is_fraud,
  CASE WHEN is_default = 1 THEN 1e-1 + ((k * 71) % 80) / 1e2 ELSE 0e0 END AS lgd_value,
  round(least(greatest(current_credit_balance
      + ((k * 73) % 50) / 1e2 * greatest(total_credit_limit - current_credit_balance, 0e0),
      current_credit_balance), total_credit_limit), 2) AS ead_value
FROM (
  SELECT *,
    CASE WHEN 22e-1 * credit_utilization_ratio + 18e-1 * debt_to_income_ratio
        + 45e-2 * number_of_delinquencies - coalesce(annual_income, 6e4) / 6e4
        + ((k * 15485863) % 1000) * 16e-4 > 36e-1 THEN 1 ELSE 0 END AS is_default,
    CASE WHEN (device_type = 'tablet' AND credit_utilization_ratio > 7e-1) OR k % 211 = 0
        THEN 1 ELSE 0 END AS is_fraud
  FROM (
    SELECT *, current_credit_balance / total_credit_limit AS credit_utilization_ratio,
      CASE WHEN number_of_delinquencies > 0 THEN CAST((k * 41) % 60 AS DOUBLE) END
        AS months_since_last_delinquency
    FROM (
      SELECT *, total_credit_limit * ((k * 37) % 104) / 1e2 AS current_credit_balance
      FROM (
        SELECT c.c_custkey AS k, n.n_name AS state,
          CAST(18 + (c.c_custkey * 7919) % 60 AS INT) AS age,
          CASE WHEN c.c_custkey % 101 = 0 THEN NULL
            ELSE 18e3 + 4e0 * c.c_acctbal + (c.c_custkey * 104729) % 90000 END AS annual_income,
          CASE WHEN c.c_custkey % 53 = 2 THEN NULL
            ELSE ((c.c_custkey * 31) % 400) / 1e1 END AS employment_length_years,
          CASE WHEN c.c_custkey % 97 = 5 THEN NULL WHEN (c.c_custkey * 13) % 20 < 13 THEN 'employed'
            WHEN (c.c_custkey * 13) % 20 < 16 THEN 'self_employed'
            WHEN (c.c_custkey * 13) % 20 < 18 THEN 'unemployed' ELSE 'retired' END AS employment_type,
          CASE WHEN (c.c_custkey * 17) % 10 < 2 THEN 'own' WHEN (c.c_custkey * 17) % 10 < 6 THEN 'mortgage'
            ELSE 'rent' END AS home_ownership,
          CAST(1 + (c.c_custkey * 11) % 20 AS INT) AS existing_credit_lines,
          CAST(1000 + (c.c_custkey * 7127) % 49000 AS DOUBLE) AS total_credit_limit,
          CAST(CASE WHEN (c.c_custkey * 29) % 10 < 6 THEN 0 ELSE (c.c_custkey * 29) % 10 - 5 END AS INT)
            AS number_of_delinquencies,
          ((c.c_custkey * 53) % 90) / 1e2 AS debt_to_income_ratio,
          CAST(1000 + (c.c_custkey * 6151) % 39000 AS DOUBLE) AS requested_loan_amount,
          CASE (c.c_custkey * 19) % 5 WHEN 0 THEN 'debt_consolidation' WHEN 1 THEN 'home_improvement'
            WHEN 2 THEN 'business' WHEN 3 THEN 'education' ELSE 'personal' END AS loan_purpose,
          CAST(6 + (c.c_custkey * 43) % 174 AS INT) AS account_age_months,
          CASE WHEN c.c_custkey % 67 = 3 THEN NULL
            ELSE 6e-1 + ((c.c_custkey * 59) % 41) / 1e2 END AS profile_completeness_score,
          CASE WHEN (c.c_custkey * 61) % 20 < 11 THEN 'mobile' WHEN (c.c_custkey * 61) % 20 < 18 THEN 'desktop'
            ELSE 'tablet' END AS device_type
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
      ) a
    ) b
  ) d
) e
"""

RECENT_TRANSACTIONS = """
SELECT event_id AS transaction_id, user_id AS borrower_id, ts AS timestamp, value AS amount,
  CASE event_type WHEN 'purchase' THEN 'grocery' WHEN 'view' THEN 'restaurant' WHEN 'click' THEN 'online'
    WHEN 'signup' THEN 'travel' ELSE 'gas' END AS merchant_category,
  event_id % 9 = 0 AS is_international,
  CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'online' ELSE 'in_store' END AS channel,
  event_id % 17 = 0 AS is_declined
FROM {events}
"""

LONG_TRANSACTIONS = """
SELECT o_orderkey AS transaction_id, o_custkey AS borrower_id, o_orderdate AS timestamp, o_totalprice AS amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'grocery' WHEN '2-HIGH' THEN 'restaurant' WHEN '3-MEDIUM' THEN 'online'
    WHEN '4-NOT SPECIFIED' THEN 'travel' ELSE 'utilities' END AS merchant_category,
  o_orderkey % 11 = 0 AS is_international,
  CASE o_orderkey % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'online' ELSE 'in_store' END AS channel,
  o_orderkey % 13 = 0 AS is_declined
FROM {orders}
"""

PAYMENTS = """
SELECT borrower_id, due_date + days_past_due * INTERVAL '1' DAY AS payment_date, due_date, amount_due,
  CASE WHEN payment_status = 'missed' THEN 0e0 ELSE amount_due * (1 - discount) END AS amount_paid,
  days_past_due, payment_status
FROM (
  SELECT *, CASE WHEN days_past_due = 0 THEN 'on_time'
      WHEN days_past_due > 30 AND discount < 25e-3 THEN 'missed' ELSE 'late' END AS payment_status
  FROM (
    SELECT o.o_custkey AS borrower_id, l.l_shipdate AS due_date, l.l_extendedprice AS amount_due,
      l.l_discount AS discount,
      CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN l.l_quantity
        WHEN l.l_returnflag = 'A' AND l.l_quantity > 45 THEN l.l_quantity - 45 ELSE 0 END AS INT) AS days_past_due
    FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  ) a
) b
"""

SCORED = """
SELECT borrower_id, state, employment_type, age, is_default, current_credit_balance, total_credit_limit,
  lgd_value, ead_value,
  round(1 / (1 + exp(-(-4e0 + 2e0 * credit_utilization_ratio + 18e-1 * debt_to_income_ratio
    + 4e-1 * number_of_delinquencies + ((borrower_id * 7727) % 100) / 1e2))), 6) AS pd,
  round(1 / (1 + exp(-(-39e-1 + 21e-1 * credit_utilization_ratio + 16e-1 * debt_to_income_ratio
    + 4e-1 * number_of_delinquencies + ((borrower_id * 7727) % 100) / 1e2))), 6) AS challenger_pd,
  round(1 / (1 + exp(-(-4e0 + 5e0 * debt_to_income_ratio + ((borrower_id * 3571) % 100) / 5e1))), 2) AS rough_pd,
  round(1e-1 + ((borrower_id * 71) % 90) / 1e2 * 8e-1, 4) AS lgd,
  round(((borrower_id * 15485863) % 1000) / 1e3 * (3e-1 + credit_utilization_ratio * 5e-1), 6) AS fraud_score
FROM {borrowers}
"""

REQUESTS = """
SELECT event_id AS request_id, ts AS requested_at, event_type AS endpoint, user_id AS client_id,
  CASE WHEN event_id % 23 = 0 THEN '500' WHEN event_id % 7 = 0 THEN '422' ELSE '200' END AS status,
  value / 1e2 AS latency_seconds
FROM {events}
"""

_TEXTS = {
    "borrowers": (BORROWERS, ["customer", "nation"]),
    "recent_transactions": (RECENT_TRANSACTIONS, ["events"]),
    "long_transactions": (LONG_TRANSACTIONS, ["orders"]),
    "payments": (PAYMENTS, ["lineitem", "orders"]),
    "scored": (SCORED, ["borrowers"]),
    "requests": (REQUESTS, ["events"]),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table or, for a derived name, the view over it."""
    if name not in _TEXTS:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    text, sources = _TEXTS[name]
    return spark.sql(text, **{s: table(spark, folder, s) for s in sources})


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the named views as common table expressions, for DuckDB."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in _TEXTS or name in ordered:
            return
        for source in _TEXTS[name][1]:
            need(source)
        ordered.append(name)

    for name in names:
        need(name)
    views = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', _TEXTS[n][0]).strip()})" for n in ordered]
    body = body.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(views) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(views) + "\n" + body
