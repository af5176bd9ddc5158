import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from riskloom.operators import registry
from riskloom.sources import sinks, standardize, store, tables
from riskloom.sources.schemas import BORROWER_COLUMNS, TRANSACTION_SCHEMA
from riskloom.streaming import jobs
from riskloom.streaming import sinks as stream_sinks

from .conftest import rows


def test_standardized_records_do_not_depend_on_layout(spark):
    raw = spark.range(200).select(
        F.col("id").alias("record"), F.lit(0).alias("SeriousDlqin2yrs"), F.lit(None).cast("double").alias("MonthlyIncome"),
        F.lit(9.0).alias("DebtRatio"), F.lit(3).alias("NumberOfTimes90DaysLate"),
    )
    first = standardize.standardize_give_me_credit(raw)
    assert first.columns == BORROWER_COLUMNS
    again = standardize.standardize_give_me_credit(raw.repartition(9))
    assert rows(first, "borrower_id") == rows(again, "borrower_id")
    one = rows(first, "borrower_id")["gmc-000007"]
    assert one["annual_income"] == 54000.0 and one["debt_to_income_ratio"] == 5.0 and one["number_of_delinquencies"] == 3
    assert one["months_since_last_delinquency"] is not None and 22 <= one["age"] < 70
    assert one["current_credit_balance"] <= one["ead_value"] <= one["total_credit_limit"]
    assert {r["employment_type"] for r in rows(first)} == {"employed", "self_employed", "unemployed", "retired"}


def test_lending_club_text_fields(spark):
    raw = spark.createDataFrame(
        [(0, "10+ years", "OWN", "Default", "weird"), (1, None, "NONE", None, None)],
        "id long, emp_length string, home_ownership string, loan_status string, purpose string",
    )
    found = rows(standardize.standardize_lending_club(raw), "borrower_id")
    assert found["lc-000000"]["employment_length_years"] == 10.0 and found["lc-000000"]["is_default"] == 1
    assert found["lc-000001"]["employment_length_years"] == 3.0 and found["lc-000001"]["home_ownership"] == "rent"
    assert found["lc-000000"]["loan_purpose"] == "personal" and found["lc-000001"]["is_default"] == 0


def test_bundle_and_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path), "payments")
    empty = spark.createDataFrame([], TRANSACTION_SCHEMA)
    tables.write_bundle({"transactions": empty}, str(tmp_path))
    assert tables.read_table(spark, str(tmp_path), "transactions").schema == TRANSACTION_SCHEMA


def test_feature_store(spark, tmp_path):
    path = str(tmp_path / "f")
    with pytest.raises(FileNotFoundError):
        store.load_version(spark, path)
    assert rows(store.version_metadata(spark, path)) == []
    store.save_version(spark.range(5), path, "v1")
    assert store.load_version(spark, path, "v1").count() == 5
    assert rows(store.version_metadata(spark, path, "v1")) == [{"column": "id", "dtype": "bigint", "n_columns": 1, "n_rows": 5}]


def test_snapshot_expiry(spark):
    at = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("a", 1.0, at), ("a", 2.0, at + dt.timedelta(minutes=5)), ("b", 3.0, at - dt.timedelta(hours=2))],
                               "k string, x double, at timestamp")
    entries = store.snapshot_entries(df, "k", "at")
    latest = store.latest_entries(entries, "2024-01-01 12:30:00", "k")
    assert rows(store.read_features(latest, "k", "x double")) == [{"k": "a", "x": 2.0}]


def test_result_tables_prune_by_day(spark, tmp_path):
    path = str(tmp_path / "r")
    drift = spark.createDataFrame([("x", 0.1, "warning")], "feature string, psi double, status string")
    sinks.append_drift(drift, path, "2024-01-01 10:00:00")
    sinks.append_drift(drift, path, "2024-01-02 10:00:00")
    later = sinks.read_results(spark, path, since="2024-01-02")
    assert later.count() == 1
    assert "PartitionFilters: [isnotnull(day" in later._jdf.queryExecution().executedPlan().toString()


def test_registry_lists_46_features(spark):
    assert registry.feature_registry(spark).count() == 46
    assert len(registry.feature_names("velocity")) == 11


def write_lines(folder, name, records):
    """A file named by its place in arrival order; a stream takes files by modification time."""
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(json.dumps(r) for r in records))
    arrived = 1_700_000_000 + int(path.stem)
    os.utime(path, (arrived, arrived))


def test_stream_of_several_batches_equals_batch(spark, tmp_path):
    """Windows updated by later micro-batches end up with their final value, once."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "requested_at timestamp, endpoint string, status string, latency_seconds double"
    for i in range(3):
        write_lines(source, f"{i}.json", [
            {"requested_at": f"2024-01-01T00:0{m}:10Z", "endpoint": "score", "status": "200", "latency_seconds": 0.02}
            for m in range(3)
        ])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    stream_sinks.drain(jobs.request_windows(stream), out, mode="update")
    latest = stream_sinks.read_latest(spark, out, ["window_start", "endpoint", "status"])
    assert sorted(r["requests"] for r in rows(latest)) == [3, 3, 3]
    assert {r["le_10ms"] for r in rows(latest)} == {0} and {r["le_25ms"] for r in rows(latest)} == {3}


def test_stream_drops_repeats_and_late_rows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write_lines(source, "0.json", [{"id": "a", "ts": "2024-01-01T10:00:00Z"}, {"id": "a", "ts": "2024-01-01T10:10:00Z"}])
    write_lines(source, "1.json", [{"id": "a", "ts": "2024-01-01T10:20:00Z"}, {"id": "b", "ts": "2024-01-01T12:00:00Z"}])
    write_lines(source, "2.json", [{"id": "late", "ts": "2024-01-01T02:00:00Z"}, {"id": "c", "ts": "2024-01-01T12:01:00Z"}])
    stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    stream_sinks.drain(jobs.first_seen(stream, "id", "ts"), out)
    assert sorted(r["id"] for r in rows(stream_sinks.read_batches(spark, out))) == ["a", "b", "c"]


def test_stream_drift_counts_add_up(spark, tmp_path):
    from riskloom.operators import drift

    source, out = tmp_path / "in", str(tmp_path / "out")
    reference = drift.reference_bins(spark.range(1000).select((F.col("id") / 1000).alias("x")), ["x"])
    for i in range(2):
        write_lines(source, f"{i}.json", [{"at": "2024-01-01T10:00:00Z", "x": (k * 2 + i) / 100} for k in range(50)])
    stream = spark.readStream.schema("at timestamp, x double").option("maxFilesPerTrigger", 1).json(str(source))
    stream_sinks.drain(stream, out, jobs.drift_counts(reference, ["x"], "at"))
    found = rows(jobs.drift_by_day(stream_sinks.read_batches(spark, out), reference))
    assert len(found) == 1 and found[0]["status"] == "stable"


def test_rerun_of_a_drained_stream_adds_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write_lines(source, "0.json", [{"id": "a", "ts": "2024-01-01T10:00:00Z"}])
    for _ in range(2):
        stream_sinks.drain(spark.readStream.schema("id string, ts timestamp").json(str(source)), out)
    assert stream_sinks.read_batches(spark, out).count() == 1
