import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import ordering
from riskloom.operators import encode, split

from .conftest import rows


@pytest.mark.parametrize("shape", ["distinct", "ties", "one_value", "tiny_values"])
@pytest.mark.parametrize("groups", [None, 2])
def test_running_sums_and_quantiles(spark, shape, groups):
    rng = np.random.default_rng(3)
    n = 5000
    values = {
        "distinct": rng.random(n),
        "ties": rng.integers(0, 40, n) / 40,
        "one_value": np.full(n, 0.25),
        "tiny_values": 10 ** -rng.uniform(1, 15, n),
    }[shape]
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.9, "big", "small"), "v": values, "w": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf)
    steps = ordering.value_steps(df, ["g"], "v", {"w": F.col("w"), "rows": F.lit(1)}, groups).toPandas()
    for g, part in pdf.groupby("g"):
        want = part.groupby("v").agg(w=("w", "sum"), rows=("w", "size")).cumsum()
        got = steps[steps.g == g].sort_values("v")
        assert np.array_equal(got.v.to_numpy(), want.index.to_numpy())
        assert np.array_equal(got.w_cum.to_numpy(), want.w.to_numpy())
        assert np.array_equal(got.rows_cum.to_numpy(), want.rows.to_numpy())
        assert set(got.rows_all) == {len(part)}
    wanted = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.93, "qx": 1.0}
    found = ordering.order_statistics(df, ["g"], "v", wanted, groups).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        for name, p in wanted.items():
            assert found.loc[g, name] == pytest.approx(np.quantile(part.v, p), rel=1e-12)


def test_whole_table_without_groups_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "v double")
    assert rows(ordering.order_statistics(df, [], "v", {"m": 0.5})) == [{"m": 2.0}]


def test_split_shares_are_exact_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id").alias("borrower_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    first = split.stratified_split(df, "y").toPandas()
    again = split.stratified_split(df.repartition(7), "y").toPandas()
    assert first.set_index("borrower_id").split.sort_index().equals(again.set_index("borrower_id").split.sort_index())
    counts = first.groupby(["y", "split"]).size()
    assert counts[1, "test"] == 40 and counts[1, "validation"] == 30 and counts[0, "test"] == 360


def test_sample_is_exact(spark):
    df = spark.range(3000).withColumnRenamed("id", "borrower_id")
    assert split.sample_rows(df, 137).count() == 137
    assert split.sample_rows(df, 5000).count() == 3000
    one = {r[0] for r in split.sample_rows(df, 137).collect()}
    assert one == {r[0] for r in split.sample_rows(df.repartition(5), 137).collect()}


def test_weights(spark):
    df = spark.createDataFrame([(i, int(i < 2)) for i in range(100)], "borrower_id int, y int")
    found = rows(split.class_weights(df, "y"), "y")
    assert found[1]["balanced_weight"] == 25.0 and found[0]["balanced_weight"] == pytest.approx(100 / 196)
    assert found[1]["capped_weight"] == pytest.approx(98 / 3) and found[0]["capped_weight"] == 1.0
    total = split.with_class_weight(df, "y").agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(100.0)


def test_no_task_takes_a_group_before_it_is_cut(spark):
    """Windows over a group alone see its buckets only; rows are ordered within buckets."""
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("v"))
    plan = ordering.value_steps(df, ["g"], "v", {"rows": F.lit(1)}, 2)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window")]
    assert windows and all("_bucket" in line for line in windows if " v#" in line)  # those that order rows
    assert not any("row_number" in line or "xxhash64" in line for line in plan.splitlines())


def test_class_weights_need_no_join(spark):
    df = spark.createDataFrame([(i, int(i < 2)) for i in range(100)], "borrower_id int, y int")
    plan = split.with_class_weight(df, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("n", [1, 2, 7, 5001])
def test_bracketed_medians_are_exact(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({
        "smooth": rng.random(n), "ties": rng.integers(0, 3, n).astype(float), "tiny": 10 ** -rng.uniform(1, 15, n),
        "holes": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)),
    })
    df = spark.createDataFrame(pdf).replace(float("nan"), None).withColumn("empty", F.lit(None).cast("double"))
    found = {r["feature"]: r["median"] for r in encode.feature_medians(df, df.columns).collect()}
    want = {c: float(pdf[c].median()) for c in pdf if pdf[c].notna().any()}
    assert found == pytest.approx(want, rel=1e-15)
