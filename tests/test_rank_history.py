import random

import pytest

from riskloom.operators import rank_history
from riskloom.operators.evaluate import evaluate_pd

from .conftest import rows

COLUMNS = "label int, prob double"


def batches():
    rng = random.Random(3)
    made = {}
    for name in ("2024-01", "2024-02", "2024-03"):
        made[name] = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(60)]
    made["2024-02"].append((1, None))
    return made


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k] if not isinstance(a[k], float) else a[k] == pytest.approx(b[k], abs=1e-12)


def test_unions_equal_raw_rows(spark, tmp_path):
    path, made = str(tmp_path / "history"), batches()
    for name, data in made.items():
        rank_history.add_batch(spark.createDataFrame(data, COLUMNS), path, name)
    unions = {"q": list(made), "ends": ["2024-01", "2024-03"], "one": ["2024-02", "unknown"]}
    got = rows(rank_history.united_metrics(spark, path, unions), "union")
    assert set(got) == set(unions)
    for name, parts in unions.items():
        raw = [r for p in parts for r in made.get(p, [])]
        wanted = rows(evaluate_pd(spark.createDataFrame(raw, COLUMNS), []))[0]
        found = {k: v for k, v in got[name].items() if k != "union"}
        close(found, wanted)


def test_repeated_batch_replaces_its_counts_and_reads_open_named_batches(spark, tmp_path):
    path, made = str(tmp_path / "history"), batches()
    for name in ("2024-01", "2024-02", "2024-01"):
        rank_history.add_batch(spark.createDataFrame(made[name], COLUMNS), path, name)
    total = rows(rank_history.read_counts(spark, path).groupBy("batch").sum("rows"), "batch")
    assert {k: v["sum(rows)"] for k, v in total.items()} == {"2024-01": 60, "2024-02": 60}
    plan = rank_history.read_counts(spark, path, ["2024-02"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "batch#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        rank_history.add_batch(spark.createDataFrame([], COLUMNS), path, "a/b")


def test_one_class_and_empty_batch(spark, tmp_path):
    path = str(tmp_path / "history")
    rank_history.add_batch(spark.createDataFrame([(0, 0.2), (0, 0.4)], COLUMNS), path, "a")
    rank_history.add_batch(spark.createDataFrame([], COLUMNS), path, "b")
    got = rows(rank_history.united_metrics(spark, path, {"x": ["a", "b"], "y": ["b"]}), "union")
    assert set(got) == {"x"} and got["x"]["auc_roc"] is None and got["x"]["tn"] == 2
