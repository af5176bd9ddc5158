"""Decisions, fairness, drift, shadow comparison, explanations and quality."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import decision, drift, encode, explain, fairness, profile, quality, shadow

from .conftest import rows


def test_score_scale_and_tiers(spark):
    df = spark.createDataFrame([(0.05,), (0.20,), (0.50,), (0.043,), (0.0,), (1.0,), (None,)], "pd double")
    found = [tuple(r) for r in df.select("pd", decision.credit_score(F.col("pd")), decision.risk_tier(F.col("pd"))).collect()]
    assert [f[1] for f in found] == [736, 651, 575, 745, 850, 300, None]
    assert [f[2] for f in found] == ["medium", "high", "very_high", "low", "low", "very_high", None]


def test_fraud_outranks_score(spark):
    df = spark.createDataFrame(
        [(0.9, 0.5, 0.51), (0.9, 0.5, 0.5), (0.35, 0.5, 0.1), (0.01, 0.5, 0.1)], "pd double, lgd double, fraud_score double"
    )
    found = rows(decision.score_frame(df))
    assert [r["decision"] for r in found] == ["manual_review", "declined", "manual_review", "approved"]
    assert found[0]["ead"] == 7500.0 and found[0]["expected_loss"] == pytest.approx(0.9 * 0.5 * 7500)


def test_exposure_limit_wins(spark):
    df = spark.createDataFrame([(900.0, 500.0), (100.0, 500.0)], "d double, l double")
    found = [r[0] for r in df.select(decision.exposure(F.lit(0.75), F.col("d"), F.col("l"))).collect()]
    assert found == [500.0, 400.0]
    labels = [r[0] for r in df.select(profile.conversion_label(F.lit(300.0), F.col("d"), F.col("l"))).collect()]
    assert labels == [0.0, 0.5]


def rates(spark, records):
    df = spark.createDataFrame(records, "g string, label int, pred int")
    return fairness.group_rates(df, "g", "label", "pred")


def test_fairness_exact_values(spark):
    equal = rates(spark, [("a", 0, 0), ("a", 1, 1), ("b", 0, 0), ("b", 1, 1)])
    report = rows(fairness.fairness_report(equal, "g", "a"))[0]
    assert report["max_disparity"] == 0.0 and report["min_ratio"] == 1.0
    assert report["parity_passed"] and report["odds_passed"] and report["impact_passed"]
    apart = rates(spark, [("a", 0, 0), ("a", 0, 0), ("b", 0, 1), ("b", 0, 1)])
    assert rows(fairness.demographic_parity(apart)) == [{"max_disparity": 1.0, "passed": False}]
    odds = rows(fairness.equalized_odds(apart))[0]
    assert odds["fpr_disparity"] == 1.0 and odds["tpr_disparity"] == 0.0 and odds["passed"]
    assert rows(fairness.disparate_impact(apart, "g", "a")) == [{"min_ratio": 0.0, "passed": False}]


def test_impact_edge_cases(spark):
    one = rates(spark, [("a", 0, 0)])
    assert rows(fairness.disparate_impact(one, "g", "a"))[0]["min_ratio"] == 1.0
    absent = rates(spark, [("b", 0, 0), ("b", 0, 1)])
    assert rows(fairness.impact_ratios(absent, "g", "zz")) == [{"pair": "b_vs_zz", "ratio": 0.5}]
    refused = rates(spark, [("a", 0, 1), ("b", 0, 0)])
    assert rows(fairness.impact_ratios(refused, "g", "a")) == [{"pair": "b_vs_a", "ratio": 0.0}]


def test_bias_warnings_need_two_records(spark):
    schema = "recorded_at int, parity_passed boolean, impact_passed boolean"
    history = spark.createDataFrame([(1, True, True), (2, False, True)], schema)
    assert rows(fairness.bias_warnings(history)) == [{"warning": "Demographic parity check failed"}]
    assert rows(fairness.bias_warnings(history.filter("recorded_at = 2"))) == []


def psi(reference, current, bins=10):
    reference, current = reference[~np.isnan(reference)], current[~np.isnan(current)]
    edges = np.histogram(reference, bins=bins)[1]
    r = np.histogram(reference, bins=edges)[0] / len(reference)
    counts = np.histogram(current, bins=edges)[0]
    c = counts / max(counts.sum(), 1)
    r, c = np.clip(r, 1e-6, None), np.clip(c, 1e-6, None)
    return np.sum((c - r) * np.log(c / r))


def test_stability_index_against_histograms(spark):
    rng = np.random.default_rng(11)
    ref = pd.DataFrame(
        {
            "plain": rng.normal(size=900),
            "rounded": np.round(rng.random(900), 1),
            "constant": np.full(900, 4.0),
            "gappy": np.where(rng.random(900) < 0.3, np.nan, rng.random(900)),
            "whole": rng.integers(0, 7, 900).astype(float),
        }
    )
    cur = pd.DataFrame(
        {
            "plain": rng.normal(0.4, 1.5, size=500),
            "rounded": np.round(rng.random(500) ** 2, 1),
            "constant": np.full(500, 4.0),
            "gappy": rng.random(500),
            "whole": np.full(500, 99.0),
            "unknown": rng.random(500),
        }
    )
    names = list(ref.columns)
    reference = drift.reference_bins(spark.createDataFrame(ref), names)
    current = drift.current_bins(spark.createDataFrame(cur), reference, names)
    found = rows(drift.stability_index(current, reference), "feature")
    assert set(found) == set(names)
    for name in names:
        assert found[name]["psi"] == pytest.approx(psi(ref[name].to_numpy(), cur[name].to_numpy()), rel=1e-9), name
    report = rows(drift.drift_report(drift.feature_drift(drift.stability_index(current, reference))))[0]
    assert report["overall_status"] == "alert" and report["n_features_total"] == 5


def test_empty_current_feature_is_skipped(spark):
    reference = drift.reference_bins(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double"))
    current = spark.createDataFrame([(1.5, None)], "a double, b double")
    found = drift.drift_table(current, reference, ["a", "b"])
    assert [r["feature"] for r in rows(found)] == ["a"]


def test_unknown_scenario(spark):
    with pytest.raises(ValueError):
        drift.stressed_borrowers(spark.range(1), "flood")


def test_shadow_report(spark):
    df = spark.createDataFrame(
        [(1, 0.01, 0.02, 0.1), (2, 0.70, 0.02, 0.1), (3, 0.02, 0.80, 0.1), (4, 0.03, None, 0.1), (5, 0.4, 0.9, 0.9)],
        "application_id int, a double, b double, fraud_score double",
    )
    log = shadow.shadow_log(df, "a", "b")
    assert log.count() == 4
    report = rows(shadow.comparison_report(log))[0]
    assert report["n_comparisons"] == 4 and report["disagreements"] == 2
    assert report["challenger_more_lenient"] == 1 and report["challenger_more_strict"] == 1
    assert report["recommendation"].startswith("DO NOT PROMOTE")
    assert rows(shadow.comparison_report(log.limit(0)))[0]["status"] == "no_data"


def test_shadow_traffic_share(spark):
    df = spark.range(4000).select(
        F.col("id").alias("application_id"), F.lit(0.1).alias("a"), F.lit(0.2).alias("b"), F.lit(0.0).alias("fraud_score")
    )
    share = shadow.shadow_log(df, "a", "b", traffic=0.25).count() / 4000
    assert 0.2 < share < 0.3


def explained(spark):
    df = spark.createDataFrame([(1, 50.0, 0.9, 3.0, 1.0)], "k int, age double, credit_utilization_ratio double, number_of_delinquencies double, unmapped double")
    coefficients = {"age": 5.0, "credit_utilization_ratio": 1.0, "number_of_delinquencies": 1.0, "unmapped": 9.0}
    scaling = {"age": (30.0, 10.0), "credit_utilization_ratio": (0.5, 0.2), "number_of_delinquencies": (0.0, 1.0), "unmapped": (0.0, 1.0)}
    return explain.linear_contributions(df, coefficients, scaling)


def test_reasons_skip_protected_and_uncoded(spark):
    reasons = rows(explain.reason_rows(explain.adverse_reasons(explained(spark)), "k"))
    assert [r["code"] for r in reasons] == ["AA003", "AA001"]
    assert reasons[0]["impact_score"] == pytest.approx(3.0)
    first = rows(explain.contribution_rows(explained(spark), "k"))[0]
    assert first["feature"] == "age" and first["place"] == 1 and first["direction"] == "increases_risk"


def test_encoding_and_imputation(spark):
    raw = spark.createDataFrame(
        [("a", "employed", "CA", 1.0, None, 1), ("b", "retired", "CA", None, 4.0, 0), ("c", None, "TX", 3.0, 2.0, 0), ("d", "other", None, 8.0, 1.0, 1)],
        "borrower_id string, employment_type string, state string, x double, months_since_last_delinquency double, y int",
    )
    model = encode.fit_features(raw, ["borrower_id", "y"], "y")
    assert model.vocabulary["employment_type"] == ["employed", "other", "retired"]
    assert model.medians["x"] == 3.0 and model.medians["months_since_last_delinquency"] == 1.5
    found = rows(model.transform(raw, ["borrower_id"]), "borrower_id")
    assert found["b"]["x"] == 3.0 and found["a"]["months_since_last_delinquency"] == -1.0
    assert found["a"]["has_delinquency"] == 0.0 and found["a"]["state_encoded"] == 0.5
    assert found["d"]["state_encoded"] == 0.5 and found["c"]["employment_type_employed"] == 0.0
    unseen = raw.withColumn("employment_type", F.lit("brand_new")).withColumn("x", F.lit(float("inf")))
    assert model.transform(unseen, ["borrower_id"]).columns == ["borrower_id", *model.columns]
    assert {r["x"] for r in rows(model.transform(unseen, ["borrower_id"]))} == {0.0}


def test_feature_model_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("a", "CA", 1.0, None, 1)], "borrower_id string, state string, x double, months_since_last_delinquency double, y int")
    model = encode.fit_features(raw, ["borrower_id", "y"], "y")
    model.save(spark, str(tmp_path / "m"))
    loaded = encode.FeatureModel.load(spark, str(tmp_path / "m"))
    assert rows(loaded.transform(raw, ["borrower_id"])) == rows(model.transform(raw, ["borrower_id"]))


def borrower(**changes):
    base = {
        "borrower_id": "b1", "age": 40, "annual_income": 50000.0, "employment_length_years": 3.0,
        "employment_type": "employed", "home_ownership": "rent", "existing_credit_lines": 3,
        "total_credit_limit": 1000.0, "current_credit_balance": 100.0, "credit_utilization_ratio": 0.1,
        "months_since_last_delinquency": None, "number_of_delinquencies": 0, "debt_to_income_ratio": 0.2,
        "requested_loan_amount": 500.0, "loan_purpose": "personal", "state": "CA", "account_age_months": 10,
        "profile_completeness_score": 0.9, "device_type": "mobile", "is_default": 0, "is_fraud": 0,
        "lgd_value": 0.0, "ead_value": 100.0,
    }
    return {**base, **changes}


def borrowers(spark, *changes):
    from riskloom.sources.schemas import BORROWER_SCHEMA

    return spark.createDataFrame([borrower(**c) for c in changes], BORROWER_SCHEMA)


def test_borrower_checks_catch_violations(spark):
    df = borrowers(
        spark, {"age": 17}, {"annual_income": float("nan")}, {"credit_utilization_ratio": None, "employment_type": "pirate"}
    )
    found = rows(quality.validate_borrowers(df), "check")
    failing = {"min_rows", "age_range", "income_positive", "utilization_range", "default_rate", "employment_type_valid",
               "borrower_id_unique", "null_annual_income", "null_credit_utilization_ratio"}
    assert {n for n, r in found.items() if not r["passed"]} == failing
    assert found["borrower_id_unique"]["details"] == "Duplicate borrower_ids: 2"
    assert len(rows(quality.validate_borrowers(df.drop("age")))) == 2


def test_integrity_and_row_rules(spark):
    ts = dt.datetime(2024, 1, 1)
    txns = spark.createDataFrame(
        [("t1", "b1", ts, 5.0, "gas", False, "mobile", False), ("t2", "zz", ts, -1.0, "gas", False, "mobile", None)],
        "transaction_id string, borrower_id string, timestamp timestamp, amount double, merchant_category string,"
        " is_international boolean, channel string, is_declined boolean",
    )
    found = rows(quality.validate_transactions(txns, borrowers(spark, {})), "check")
    assert not found["amount_positive"]["passed"] and found["referential_integrity"]["details"] == "1 unknown borrower_ids"
    valid, rejected = quality.split_valid(txns, quality.transaction_rules())
    assert [r["transaction_id"] for r in rows(valid)] == ["t1"]
    assert rows(rejected)[0]["violations"] == ["is_declined", "amount"]
    assert rows(quality.split_valid(borrowers(spark, {"state": "CAL"}), quality.borrower_rules())[1])[0]["violations"] == ["state"]
