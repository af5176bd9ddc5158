"""Day tables and the decision service: several batches, retries, compaction, what a read opens."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.streaming import days, jobs, service
from riskloom.streaming import sinks as stream_sinks

from .conftest import rows
from .test_sources_streaming import write_lines

KEYS = ["at", "k"]


def batch(spark, *entries):
    return spark.createDataFrame(list(entries), "at string, k string, n long").withColumn("at", F.col("at").cast("timestamp"))


def put(spark, path, number, *entries, **options):
    days.add_batch(batch(spark, *entries), number, path, KEYS, F.col("at"), **options)


def values(df):
    return {(str(r["at"])[:10], r["k"]): r["n"] for r in rows(df)}


def test_newest_row_of_a_key_counts_and_other_days_stay_untouched(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        days.read_days(spark, path, KEYS)
    put(spark, path, 0, ("2024-01-01", "a", 1), ("2024-01-02", "a", 2), (None, "b", 3))
    before = set(days.read_days(spark, path, KEYS, "2024-01-01", "2024-01-01").inputFiles())
    put(spark, path, 1, ("2024-01-02", "a", 5), ("2024-01-03", "c", 6))
    put(spark, path, 2)
    assert values(days.read_days(spark, path, KEYS)) == {
        ("2024-01-01", "a"): 1, ("2024-01-02", "a"): 5, ("2024-01-03", "c"): 6, ("None", "b"): 3}
    asked = days.read_days(spark, path, KEYS, "2024-01-01", "2024-01-01")
    assert set(asked.inputFiles()) == before and all("_day=2024-01-01" in f for f in before)
    assert values(days.read_days(spark, path, KEYS, first="2024-01-02")) == {("2024-01-02", "a"): 5, ("2024-01-03", "c"): 6}
    assert rows(days.read_days(spark, path, KEYS, "2030-01-01")) == []


def test_a_retried_batch_replaces_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 0, ("2024-01-01", "a", 1), add=["n"])
    for _ in range(2):
        put(spark, path, 1, ("2024-01-01", "a", 10), ("2024-01-01", "b", 4), add=["n"])
    found = days.read_days(spark, path, KEYS, add=["n"])
    assert values(found) == {("2024-01-01", "a"): 11, ("2024-01-01", "b"): 4}


@pytest.mark.parametrize("add", [None, ["n"]])
def test_compaction_and_vacuum_keep_the_rows(spark, tmp_path, add):
    path = str(tmp_path / "t")
    for i in range(7):
        put(spark, path, i, ("2024-01-01", "a", i), ("2024-01-01", f"x{i}", 1), add=add, compact_after=2)
    put(spark, path, 7, ("2024-01-09", "z", 1), add=add, compact_after=2)
    live = days._manifest(spark, path)
    assert len(live["2024-01-01"]) <= 2 and live["2024-01-01"][0].startswith("c")
    expected = {("2024-01-01", "a"): sum(range(7)) if add else 6, ("2024-01-09", "z"): 1,
                **{("2024-01-01", f"x{i}"): 1 for i in range(7)}}
    assert values(days.read_days(spark, path, KEYS, add=add)) == expected
    assert days.vacuum(spark, path, keep=1) > 0
    assert values(days.read_days(spark, path, KEYS, add=add)) == expected
    assert len(list((tmp_path / "t" / "manifest").glob("version=*"))) == 1
    with pytest.raises(ValueError):
        days.vacuum(spark, path, keep=0)


APPLICATION = {
    "application_id": "x", "borrower_id": 1, "age": 30, "annual_income": 5e4, "employment_length_years": 3.0,
    "employment_type": "employed", "home_ownership": "rent", "existing_credit_lines": 2, "total_credit_limit": 1e4,
    "current_credit_balance": 1e3, "credit_utilization_ratio": 0.1, "months_since_last_delinquency": None,
    "number_of_delinquencies": 0, "debt_to_income_ratio": 0.2, "requested_loan_amount": 5e3, "loan_purpose": "personal",
    "state": "TX", "account_age_months": 12, "profile_completeness_score": 0.9, "device_type": "mobile",
}
SCHEMA = ", ".join(
    f"{n} {'long' if isinstance(v, int) else 'string' if isinstance(v, str) else 'double'}" for n, v in APPLICATION.items()
)


def test_service_decides_and_refuses(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")

    def decide(valid):
        return valid.select("application_id", (F.col("annual_income") > 4e4).alias("approved"))

    def lines(name, *texts):
        write_lines(source, name, [{"value": t} for t in texts])

    def run():
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).json(str(source))
        service.decide_stream(stream, SCHEMA, decide, path).awaitTermination()

    def application(key, **changes):
        return json.dumps({**APPLICATION, "application_id": key, **changes})

    lines("0.json", application("a"), application("b", annual_income=3e4), "{\"application_id\": \"c", None, "")
    lines("1.json", application("d", annual_income=-1.0), application("e", annual_income="much"), application("a"))
    run()
    lines("2.json", application("f", unknown=1))
    run()
    run()
    decided = sorted((r["application_id"], r["approved"]) for r in rows(service.read_decisions(spark, path)))
    assert decided == [("a", True), ("a", True), ("b", False), ("f", True)]
    refused = {(r["application_id"], tuple(r["violations"])) for r in rows(service.read_quarantine(spark, path))}
    assert refused == {(None, ("message",)), ("d", ("annual_income",))}
    assert service.read_quarantine(spark, path).count() == 5
    batches = rows(service.finished_batches(spark, path), "batch")
    assert {b: (r["received"], r["total_processed"]) for b, r in batches.items()} == {0: (5, 2), 1: (3, 1), 2: (1, 1)}
    assert all(r["processing_time_ms"] > 0 for r in batches.values())


def test_unfinished_batch_is_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    for b in (0, 1):
        spark.range(3).write.parquet(f"{path}/{service.DECISIONS}/batch={b}")
    spark.range(1).write.parquet(f"{path}/{service.BATCHES}/batch=0")
    assert service.read_decisions(spark, path).count() == 3


def test_shadow_answers_late_missing_failed_and_repeated(spark, tmp_path):
    first, second, out = tmp_path / "champion", tmp_path / "challenger", str(tmp_path / "out")

    def champion(key, at):
        return {"application_id": key, "champion_pd": 0.1, "scored_at": f"2024-01-01T{at}Z"}

    def challenger(key, at, pd=0.2):
        return {"application_id": key, "challenger_pd": pd, "scored_at": f"2024-01-01T{at}Z"}

    def run():
        one = spark.readStream.schema("application_id string, champion_pd double, scored_at timestamp").json(str(first))
        two = spark.readStream.schema("application_id string, challenger_pd double, scored_at timestamp").json(str(second))
        stream_sinks.drain(jobs.shadow_pairs(one, two), out)

    write_lines(first, "0.json", [champion(k, "10:00:00") for k in ("ok", "late", "none", "failed", "twice", "early")])
    write_lines(second, "0.json", [challenger("ok", "10:00:01"), challenger("failed", "10:00:02", None),
                                   challenger("twice", "10:01:00"), challenger("early", "09:59:59")])
    run()
    write_lines(first, "1.json", [champion("later", "10:20:00")])
    write_lines(second, "1.json", [challenger("late", "10:10:01"), challenger("twice", "10:02:00", 0.9),
                                   challenger("later", "10:30:00")])
    run()
    write_lines(first, "2.json", [champion("end", "20:00:00")])
    write_lines(second, "2.json", [challenger("end", "20:00:00")])
    run()
    pairs = stream_sinks.read_batches(spark, out)
    found = sorted((r["application_id"], r["challenger_pd"]) for r in rows(pairs) if r["challenger_pd"])
    assert found == [("end", 0.2), ("later", 0.2), ("ok", 0.2), ("twice", 0.2)]
    misses = {r["application_id"]: r["reason"] for r in rows(jobs.shadow_misses(pairs, "challenger_pd"))}
    assert misses == {"late": "no answer", "none": "no answer", "failed": "failed", "early": "no answer"}
    assert pairs.count() == 8


def test_state_has_a_partition_per_core_at_most(spark, tmp_path):
    """Each partition of a state writes files in every batch, with 64 some hundreds a batch for these two rows."""
    path, usual = str(tmp_path / "out"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01")], "k int, at string").selectExpr(
        "k", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, at timestamp").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        stream_sinks.drain(jobs.first_seen(stream, "k", "at"), path)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    stored = [p.name for p in (tmp_path / "out" / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert 0 < len(stored) <= spark.sparkContext.defaultParallelism < 64
    assert stream_sinks.read_batches(spark, path).count() == 1
