from pyspark.sql import functions as F

from riskloom.plans import batch_scoring


def test_a_small_file_of_applications_is_judged_by_all_cores(spark, monkeypatch):
    """Rules are worked out after rows are dealt: no filter on them stays below the exchange."""
    seen = []

    class Scorer:
        def matrix(self, valid, key):
            seen.append(valid)
            return valid

        def score(self, matrix, *rest):
            return matrix

    monkeypatch.setattr(batch_scoring.quality, "application_rules", lambda: {"low": F.col("x") >= 3})
    applications = spark.createDataFrame([(i, float(i)) for i in range(9)], "application_id long, x double").coalesce(1)
    scored, rejected = batch_scoring.score_applications(applications, Scorer())
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Repartition")
    assert "Filter" not in plan[plan.index("Repartition"):]
    assert sorted(r["x"] for r in scored.collect()) == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0] and rejected.count() == 3
