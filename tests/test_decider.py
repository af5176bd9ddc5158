"""The batch function of the service around a scorer, and the timed batch reply."""

from pyspark.sql import functions as F

from riskloom.operators.decision import score_frame
from riskloom.plans import batch_scoring

from .conftest import rows


class Fixed:
    """Scores that stand on the rows."""

    def matrix(self, applications, key):
        return applications

    def score(self, matrix, keep):
        return score_frame(matrix, keep=keep)


def applications(spark):
    made = [("a", 0.02, 0.4, 0.1), ("b", 0.9, 0.4, 0.1), ("b", 0.9, 0.4, 0.1)]
    return spark.createDataFrame(made, "application_id string, pd double, lgd double, fraud_score double")


def test_each_application_is_answered_and_explained_once(spark, monkeypatch):
    def reasons(matrix, scored, scorer, background, key, samples):
        why = F.array(F.struct(F.lit("AA001").alias("code"), F.lit("High").alias("reason")))
        return matrix.select(key, why.alias(batch_scoring.REASONS))

    monkeypatch.setattr(batch_scoring, "declined_reasons", reasons)
    df = applications(spark)
    plain = rows(batch_scoring.decider(Fixed())(df))
    assert len(plain) == 3 and all(r["adverse_action_reasons"] is None for r in plain)
    explained = rows(batch_scoring.decider(Fixed(), df)(df))
    assert sorted((r["application_id"], r["decision"]) for r in explained) == [
        ("a", "approved"), ("b", "declined"), ("b", "declined")]
    assert {r["application_id"]: bool(r["adverse_action_reasons"]) for r in explained} == {"a": False, "b": True}


def test_reply_of_a_batch_names_its_time(spark, tmp_path):
    replies = batch_scoring.decider(Fixed())(applications(spark))
    (summary,) = rows(batch_scoring.answer_batch(replies, str(tmp_path / "replies")))
    assert summary["total_processed"] == 3 and summary["processing_time_ms"] > 0 and summary["batch_id"]
