import datetime as dt

import numpy as np
import pandas as pd
import pytest

from riskloom.operators.payments import payment_features

from .conftest import rows

SCHEMA = "borrower_id string, due_date timestamp_ntz, amount_due double, amount_paid double, days_past_due int, payment_status string"


def brute(group):
    """Row by row, newest first; of equal dates the worst payment is the newest."""
    g = group.assign(broken=group.payment_status != "on_time").sort_values(
        ["due_date", "broken", "days_past_due"], ascending=False
    )
    streak = 0
    for broken in g.broken:
        if broken:
            break
        streak += 1
    last = g.days_past_due.head(3).to_numpy()[::-1]
    return {
        "on_time_payment_rate": (~g.broken).mean(),
        "avg_days_past_due": g.days_past_due.mean(),
        "max_days_past_due": g.days_past_due.max(),
        "missed_payment_count": (g.payment_status == "missed").sum(),
        "payment_amount_ratio": (g.amount_paid / g.amount_due.clip(lower=1)).mean(),
        "consecutive_on_time": streak,
        "payment_trend_3m": np.polyfit(range(len(last)), last, 1)[0] if len(last) > 1 else 0.0,
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force_with_ties_and_a_hot_borrower(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    late = rng.choice([0, 0, 0, 1, 5, 40], n)
    pdf = pd.DataFrame(
        {
            "borrower_id": np.where(rng.random(n) < 0.4, "hot", rng.choice([f"b{i}" for i in range(40)], n)),
            "due_date": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 12, n), unit="D"),
            "amount_due": rng.choice([0.5, 100.0, 250.0], n),
            "amount_paid": rng.choice([0.0, 50.0, 100.0], n),
            "days_past_due": late,
            "payment_status": np.where(late == 0, "on_time", np.where(late > 30, "missed", "late")),
        }
    )
    found = rows(payment_features(spark.createDataFrame(pdf, SCHEMA)), "borrower_id")
    assert set(found) == set(pdf.borrower_id)
    for borrower, group in pdf.groupby("borrower_id"):
        for name, value in brute(group).items():
            assert found[borrower][name] == pytest.approx(value, abs=1e-9), (borrower, name)


def test_single_and_all_on_time(spark):
    d = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("one", d, 10.0, 10.0, 3, "late"), ("good", d, 10.0, 10.0, 0, "on_time"), ("good", d, 10.0, 5.0, 0, "on_time")],
        SCHEMA,
    )
    found = rows(payment_features(df), "borrower_id")
    assert found["one"]["consecutive_on_time"] == 0 and found["one"]["payment_trend_3m"] == 0.0
    assert found["good"]["consecutive_on_time"] == 2 and found["good"]["missed_payment_count"] == 0


def test_payments_are_read_once_and_months_meet_in_order(spark, capsys):
    """The calendar was made twice and joined to itself. Three months, the newest with one payment, the next with two of a day."""
    made = [("a", dt.datetime(2024, m, d), 10.0, 10.0, late, "on_time" if not late else "late")
            for m, d, late in ((3, 1, 0), (2, 9, 0), (2, 9, 6), (1, 5, 0), (1, 4, 50))]
    df = payment_features(spark.createDataFrame([*made, (None, dt.datetime(2024, 1, 1), 1.0, 1.0, 9, "late")], SCHEMA))
    df.explain()
    assert "Join" not in capsys.readouterr().out
    found = rows(df, "borrower_id")
    assert set(found) == {"a"} and found["a"]["consecutive_on_time"] == 1
    # Newest first: 0, 6, 0 days late, then the others.
    assert found["a"]["payment_trend_3m"] == pytest.approx(0.0) and found["a"]["max_days_past_due"] == 50
