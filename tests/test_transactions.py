"""Transaction features against hand-computed values and a pandas brute force."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import transactions as txn

from .conftest import rows

SCHEMA = (
    "borrower_id string, timestamp timestamp_ntz, amount double, merchant_category string,"
    " is_international boolean, channel string, is_declined boolean"
)
REF = "2024-12-31"


def make(spark, records):
    return spark.createDataFrame(records, SCHEMA)


def day(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    n = 600
    borrowers = np.where(rng.random(n) < 0.35, "hot", rng.choice([f"b{i}" for i in range(12)], n))
    return pd.DataFrame(
        {
            "borrower_id": borrowers,
            "timestamp": pd.Timestamp("2024-12-30") - pd.to_timedelta(rng.integers(0, 300 * 24 * 60, n), unit="min"),
            "amount": np.round(rng.gamma(2.0, 40.0, n), 2),
            "merchant_category": rng.choice(["grocery", "restaurant", "gas", "online"], n),
            "is_international": rng.random(n) < 0.2,
            "channel": rng.choice(["online", "in_store", "mobile"], n),
            "is_declined": rng.random(n) < 0.1,
        }
    )


@pytest.fixture(scope="module")
def sample_df(spark, sample):
    return spark.createDataFrame(sample, SCHEMA)


def test_membership_is_the_widest_window(spark):
    df = make(
        spark,
        [
            ("recent", day("2024-12-30 10:00"), 10.0, "gas", False, "mobile", False),
            ("old", day("2024-05-01 10:00"), 10.0, "gas", False, "mobile", False),
            ("edge", day("2024-10-02 00:00"), 4.0, "gas", True, "mobile", True),
        ],
    )
    found = rows(txn.velocity_features(df, REF), "borrower_id")
    assert set(found) == {"recent", "edge"}
    assert found["edge"]["txn_count_90d"] == 1 and found["edge"]["txn_count_30d"] == 0
    assert found["edge"]["decline_rate_30d"] == 0.0
    assert found["recent"]["txn_amount_std_30d"] == 0.0


def test_no_upper_bound_on_windows(spark):
    df = make(spark, [("a", day("2025-06-01 00:00"), 3.0, "gas", False, "mobile", False)])
    assert rows(txn.velocity_features(df, REF))[0]["txn_count_7d"] == 1


def test_null_and_nan_amounts_are_skipped(spark):
    df = make(
        spark,
        [
            ("a", day("2024-12-30 00:00"), None, "gas", None, "mobile", None),
            ("a", day("2024-12-30 00:00"), float("nan"), "gas", True, "mobile", False),
            ("a", day("2024-12-30 00:00"), 5.0, None, False, None, False),
        ],
    )
    found = rows(txn.velocity_features(df, REF))[0]
    assert found["txn_count_7d"] == 1 and found["txn_amount_sum_7d"] == 5.0
    assert found["international_txn_rate_30d"] == 0.5
    spend = rows(txn.spend_features(df, REF))[0]
    assert spend["merchant_diversity_30d"] == 1 and spend["channel_diversity"] == 1
    assert spend["spend_category_entropy"] == 0.0


def test_average_spend_counts_only_months_of_the_category(spark):
    df = make(
        spark,
        [
            ("a", day("2024-10-01 00:00"), 10.0, "grocery", False, "mobile", False),
            ("a", day("2024-10-09 00:00"), 20.0, "grocery", False, "mobile", False),
            ("a", day("2024-11-01 00:00"), 50.0, "travel", False, "mobile", False),
            ("a", day("2024-12-01 00:00"), 40.0, "grocery", False, "mobile", False),
        ],
    )
    found = rows(txn.spend_features(df, REF))[0]
    assert found["avg_spend_grocery"] == pytest.approx(35.0)
    assert found["avg_spend_travel"] == pytest.approx(50.0)
    assert found["avg_spend_online"] == 0.0
    p = 70 / 120
    assert found["spend_category_entropy"] == pytest.approx(-p * math.log2(p) - (1 - p) * math.log2(1 - p))


def test_trends_use_observed_months(spark):
    df = make(
        spark,
        [
            ("gap", day(f"{m}-05 00:00"), a, "gas", False, "mobile", False)
            for m, a in (("2023-01", 1.0), ("2023-07", 2.0), ("2024-02", 4.0), ("2024-11", 9.0))
        ]
        + [("single", day("2024-11-05 00:00"), 7.0, "gas", False, "mobile", False)],
    )
    found = rows(txn.trend_features(df), "borrower_id")
    assert found["gap"]["spend_trend_3m"] == pytest.approx(np.polyfit([0, 1, 2], [2, 4, 9], 1)[0])
    assert found["gap"]["spend_trend_6m"] == pytest.approx(np.polyfit([0, 1, 2, 3], [1, 2, 4, 9], 1)[0])
    assert found["gap"]["txn_frequency_trend"] == pytest.approx(0.0)
    assert found["single"]["spend_trend_3m"] == 0.0 and found["single"]["spend_volatility_6m"] == 0.0


def test_weekend_and_night(spark):
    df = make(
        spark,
        [
            ("a", day("2024-12-28 23:10"), 1.0, "gas", False, "mobile", False),  # Saturday night
            ("a", day("2024-12-29 06:00"), 1.0, "gas", False, "online", False),  # Sunday morning
            ("a", day("2024-12-30 05:59"), 1.0, "gas", False, None, False),  # Monday night
            ("a", day("2024-12-30 21:59"), 1.0, "gas", False, "online", False),
        ],
    )
    found = rows(txn.behavior_features(df))[0]
    assert (found["mobile_txn_fraction"], found["weekend_txn_fraction"], found["nighttime_txn_fraction"]) == (
        0.25,
        0.5,
        0.5,
    )


def test_fused_plan_equals_the_families(spark, sample_df):
    fused = rows(txn.transaction_features(sample_df, REF), "borrower_id")
    families = [
        rows(txn.velocity_features(sample_df, REF), "borrower_id"),
        rows(txn.spend_features(sample_df, REF), "borrower_id"),
        rows(txn.behavior_features(sample_df), "borrower_id"),
        rows(txn.trend_features(sample_df), "borrower_id"),
    ]
    assert set(fused) == set(families[1])
    for borrower, row in fused.items():
        for family in families:
            for name, value in family.get(borrower, {}).items():
                assert row[name] == pytest.approx(value) if name != "borrower_id" else True


def test_monthly_rollup_against_pandas(sample, sample_df):
    expected = sample.assign(month=sample.timestamp.dt.to_period("M")).groupby(["borrower_id", "month"]).amount.agg(
        ["sum", "count"]
    )
    for r in rows(txn.monthly_rollup(sample_df)):
        want = expected.loc[(r["borrower_id"], pd.Period(r["month"], "M"))]
        assert r["total_spend"] == pytest.approx(want["sum"]) and r["txn_count"] == want["count"]


def test_reference_filter_reaches_the_scan(spark, sample_df, tmp_path):
    sample_df.write.parquet(str(tmp_path / "t"))
    plan = txn.velocity_features(spark.read.parquet(str(tmp_path / "t")), REF)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in text
    assert "merchant_category" not in text
