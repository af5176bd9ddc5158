"""Notices of declined rows: what is worked out, how often, and for which rows."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from riskloom.operators import explain
from riskloom.session import computed_once

from .conftest import rows


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def counted(spark, result):
    """A column function that gives ``result(n)``, and the counter of its calls."""
    calls = spark.sparkContext.accumulator(0)

    def call(n):
        calls.add(1)
        return result(n)

    return F.udf(call, "double"), calls


def test_a_decision_is_worked_out_once_per_row(spark):
    chance, calls = counted(spark, lambda n: n / 10)
    scored = spark.range(0, 10, 1, 2).select("id", chance("id").alias("pd"))
    decided = scored.select("id", F.when(F.col("pd") > 0.65, "declined").otherwise("approved").alias("decision"))
    kept = rows(explain.declined_only(decided).select("id", "decision"))
    assert sorted(r["id"] for r in kept) == [7, 8, 9] and {r["decision"] for r in kept} == {"declined"}
    again = explain.declined_only(scored.select("*", F.lit("declined").alias("decision"))).filter("pd > 0.65")
    calls.value = 0
    assert sorted(r["pd"] for r in rows(again)) == [0.7, 0.8, 0.9]
    assert calls.value == 10


def test_computed_once_keeps_rows_nulls_and_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, None)], "a int, `b.c` double, `d``e` string")
    held = computed_once(df)
    assert held.dtypes == df.dtypes
    assert held.collect() == df.collect()


def test_a_contribution_is_worked_out_once(spark):
    df = spark.createDataFrame([(1, 3.0, None), (2, -1.0, 5.0)], "k int, b double, a double")
    explained = explain.linear_contributions(df, {"b": 0.8125, "a": 2.0}, {"b": (1.0, 2.0), "a": (1.0, 2.0)})
    assert explained._jdf.queryExecution().analyzed().toString().count("0.8125") == 1
    found = rows(explained, "k")
    assert [(c["feature"], c["value"], c["contribution"], c["direction"]) for c in found[1]["contributions"]] == [
        ("a", None, None, "decreases_risk"),
        ("b", 3.0, 0.8125, "increases_risk"),
    ]
    assert [(c["order"], c["feature"]) for c in found[2]["contributions"]] == [(-4.0, "a"), (-0.8125, "b")]


def test_notices_explain_declined_rows_only(spark):
    plan = optimized(queries()["adverse_action_notices_for_declined"](spark, "/root/testdata/sf0.001"))
    assert plan.count("sort_array") == 1
    assert plan.index("sort_array") < plan.index("LeftSemi")
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not [f for f in filters if "sort_array" in f or "EXP(" in f.upper() or "LN(" in f.upper()]
