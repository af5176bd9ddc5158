import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from riskloom.operators import distinct

from .conftest import rows

SCHEMA = "k long, kind string, client long, timestamp timestamp"
START, REFERENCE = datetime(2024, 1, 1), "2024-02-01"


def events(count=600):
    rng = random.Random(5)
    made = [
        (rng.randrange(6), rng.choice(["a", "b", "c", "d", None]), rng.randrange(90),
         START + timedelta(minutes=rng.randrange(31 * 1440)))
        for _ in range(count)
    ]
    return [*made, (7, None, None, START + timedelta(days=30)), (8, "a", 1, None), (9, "a", 1, START - timedelta(days=400))]


def counted(data, days):
    first = datetime(2024, 2, 1) - timedelta(days=days)
    out = {}
    for k, kind, client, at in data:
        if at is not None and at >= first:
            kinds, clients = out.setdefault(k, (set(), set()))
            kinds.add(kind)
            clients.add(client)
    return {k: tuple(len(s - {None}) for s in both) for k, both in out.items()}


def test_windows_unite_days(spark, tmp_path):
    data, path = events(), str(tmp_path / "days")
    distinct.save_months(distinct.daily_sketches(spark.createDataFrame(data, SCHEMA), ["k"], ["kind", "client"]), path)
    stored = distinct.read_months(spark, path)
    got = rows(distinct.window_distinct(stored, ["k"], {"kind": "kinds", "client": "clients"}, REFERENCE, [2, 7, 40]), "k")
    assert set(got) == set(counted(data, 40)) and 8 not in got and 9 not in got
    for days in (2, 7, 40):
        wanted = counted(data, days)
        for k, r in got.items():
            assert (r[f"kinds_{days}d"], r[f"clients_{days}d"]) == wanted.get(k, (0, 0))


def test_months_written_again_replace_their_own_and_windows_prune(spark, tmp_path):
    data, path = events(), str(tmp_path / "days")
    sketches = distinct.daily_sketches(spark.createDataFrame(data, SCHEMA), ["k"], ["kind"])
    distinct.save_months(sketches, path)
    before = distinct.read_months(spark, path).count()
    distinct.save_months(sketches.where(F.col("day") >= F.lit(date(2024, 1, 1))), path)
    stored = distinct.read_months(spark, path)
    assert stored.count() == before == sketches.count()
    plan = distinct.window_distinct(stored, ["k"], {"kind": "kinds"}, REFERENCE, [7])._jdf.queryExecution().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_large_sets_stay_within_the_stated_error(spark):
    many = spark.range(60_000).selectExpr("0L AS k", "CAST(id % 20000 AS string) AS kind",
                                          "timestamp'2024-01-01' + make_interval(0, 0, 0, id % 28) AS timestamp")
    sketches = distinct.daily_sketches(many, ["k"], ["kind"])
    found = distinct.window_distinct(sketches, ["k"], {"kind": "kinds"}, REFERENCE, [60]).first()["kinds_60d"]
    assert abs(found - 20_000) <= 4 * distinct.relative_error() * 20_000


def test_empty_table(spark):
    sketches = distinct.daily_sketches(spark.createDataFrame([], SCHEMA), ["k"], ["kind"])
    assert distinct.window_distinct(sketches, ["k"], {"kind": "kinds"}, REFERENCE, [7]).collect() == []
