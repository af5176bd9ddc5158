import random
import re
from datetime import datetime, timedelta

import pytest

from riskloom.sources import snapshot, store

from .conftest import rows

START = datetime(2024, 1, 1)
SCHEMA = "k long, v int, at timestamp"


def entries(spark, data, ttl=3600):
    return store.snapshot_entries(spark.createDataFrame(data, SCHEMA), "k", "at", ttl)


def log(count, seed):
    rng = random.Random(seed)
    return [(rng.randrange(30), rng.randrange(1000), START + timedelta(minutes=rng.randrange(600))) for _ in range(count)]


def newest(data, now, ttl=3600):
    best = {}
    for k, v, at in data:
        if k not in best or (at, f'{{"v":{v}}}') > best[k]:
            best[k] = (at, f'{{"v":{v}}}')
    return {k: t for k, (at, t) in best.items() if at + timedelta(seconds=ttl) > now}


def read(spark, path, now, **more):
    return {k: r["features"] for k, r in rows(snapshot.read(spark, path, "k", now, **more), "k").items()}


def test_merged_writes_equal_one_fold_and_retries_add_nothing(spark, tmp_path):
    path, now, seen = str(tmp_path / "s"), START + timedelta(minutes=590), []
    for batch in range(5):
        data = log(60, batch)
        seen += data
        for _ in range(2 if batch in (1, 3) else 1):  # 3 is retried after it has been folded
            snapshot.add_batch(entries(spark, data), batch, path, "k", now, buckets=4, compact_after=2)
        assert read(spark, path, now) == newest(seen, now)
    live, buckets = snapshot._manifest(spark, path)
    assert len(live) <= 2 and buckets == 4


def test_compaction_removes_expired_entries(spark, tmp_path):
    path, late = str(tmp_path / "s"), START + timedelta(days=2)
    old, new = [(1, 5, START)], [(2, 6, late)]
    snapshot.add_batch(entries(spark, old), 0, path, "k", START, compact_after=1)
    snapshot.add_batch(entries(spark, new), 1, path, "k", late, compact_after=1)
    kept = snapshot._opened(spark, path, snapshot._manifest(spark, path)[0])
    assert [r.k for r in kept.collect()] == [2]
    snapshot.add_batch(entries(spark, new), 2, path, "k", late + timedelta(days=9), compact_after=1)
    assert read(spark, path, late + timedelta(days=9)) == {}


def test_point_read_opens_the_buckets_of_its_keys(spark, tmp_path):
    path, now = str(tmp_path / "s"), START + timedelta(minutes=30)
    data = [(k, k * 10, START) for k in range(200)]
    snapshot.add_batch(entries(spark, data), 0, path, "k", now, buckets=16)
    found = snapshot.read(spark, path, "k", now, keys=[7, None, 999])
    assert {r.k: r.features for r in found.collect()} == {7: '{"v":70}'}
    scan = next(n for n in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in n)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
    assert "_bucket" in filters and "xxhash64" not in filters
    files = len(found.inputFiles())
    assert files <= len(snapshot.read(spark, path, "k", now).inputFiles())
    assert read(spark, path, now, keys=[]) == {}
    with pytest.raises(ValueError):
        snapshot.read(spark, path, "k", now, keys=list(range(snapshot.MOST_KEYS + 1)))


def test_null_keys_empty_batches_and_no_batch(spark, tmp_path):
    path, now = str(tmp_path / "s"), START + timedelta(minutes=5)
    with pytest.raises(FileNotFoundError):
        snapshot.read(spark, path, "k", now)
    snapshot.add_batch(entries(spark, [(None, 1, START), (3, 2, START), (3, 2, START)]), 0, path, "k", now)
    snapshot.add_batch(entries(spark, []), 1, path, "k", now)
    assert read(spark, path, now) == {3: '{"v":2}'}
