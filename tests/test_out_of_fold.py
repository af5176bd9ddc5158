"""State means without the row's own fold."""

from riskloom.operators import encode

from .conftest import rows

SCHEMA = "borrower_id string, state string, fold int, y int, state_mean double, own long"


def brute(data, fallback=0.08):
    out = {}
    for key, state, fold, *_ in data:
        others = [y for _, s, f, y, *_ in data if s is not None and s == state and f is not None and fold is not None and f != fold and y is not None]
        out[key] = sum(others) / len(others) if others else fallback
    return out


def test_means_come_from_the_other_folds(spark):
    data = [(f"k{i}", ["CA", "NY", "TX", None][i % 4], i * 7 % 3, (i * 5 % 11 < 3) * 1, 9.0, 8) for i in range(60)]
    data += [("one", "VT", 0, 1, 9.0, 8), ("two", "VT", 0, 0, 9.0, 8), ("gap", "CA", 1, None, 9.0, 8), ("lost", "CA", None, 1, 9.0, 8)]
    df = spark.createDataFrame(data, SCHEMA).drop("state_mean", "own")
    got = rows(encode.encode_state_out_of_fold(df, "y"), "borrower_id")
    want = brute(data)
    assert {k: round(v["state_encoded"], 12) for k, v in got.items()} == {k: round(v, 12) for k, v in want.items()}
    assert got["one"]["state_encoded"] == got["two"]["state_encoded"] == 0.08
    assert "state" not in next(iter(got.values()))


def test_no_row_sees_its_own_label(spark):
    """With as many folds as rows and a state per label, the plain mean tells the label, this one does not."""
    data = [(f"k{i}", "CA", i % 2, int(i < 2)) for i in range(4)]
    df = spark.createDataFrame(data, "borrower_id string, state string, fold int, y int")
    changed = spark.createDataFrame([(k, s, f, 1 - y if k == "k0" else y) for k, s, f, y in data], df.schema)
    a, b = (rows(encode.encode_state_out_of_fold(d, "y"), "borrower_id") for d in (df, changed))
    assert a["k0"]["state_encoded"] == b["k0"]["state_encoded"] and a["k1"]["state_encoded"] != b["k1"]["state_encoded"]


def test_no_rows(spark):
    df = spark.createDataFrame([], "borrower_id string, state string, fold int, y int")
    assert rows(encode.encode_state_out_of_fold(df, "y")) == []
