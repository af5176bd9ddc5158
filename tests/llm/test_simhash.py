import itertools

import pytest
from pyspark.sql import functions as F

from riskloom.llm import simhash
from riskloom.llm.components import components

from .frames import awkward, frame, prose, rows, SCHEMA


def brute(texts, radius=4, width=4):
    marks = [simhash.fingerprint(t, width) & (2**64 - 1) for _, t in texts]
    ids = sorted({i for i, _ in texts if i is not None})
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, x), (b, y) in itertools.combinations(zip([i for i, _ in texts], marks), 2):
        if a is not None and b is not None and (x ^ y).bit_count() <= radius:
            low, high = sorted((find(a), find(b)))
            label[high] = low
    return sorted((i, f"{m:016x}", None if i is None else find(i)) for (i, _), m in zip(texts, marks) if i is not None)


def test_fingerprint_agrees_with_sparks_own_hash(spark):
    text = prose(5, 300) + " É STRASSE Über"
    low = "".join(c.lower() if c.isascii() else c for c in text).split()
    grams = [(" ".join(low[i : i + 4]),) for i in range(len(low) - 3)]
    hashes = [r[0] & (2**64 - 1) for r in spark.createDataFrame(grams, "g string").select(F.xxhash64("g")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (2**64 - 1) == want


def test_words_are_cut_at_ascii_space_only():
    assert simhash.fingerprint("a\x0bb c") == simhash.fingerprint("A b c")
    assert simhash.fingerprint("a b c") != simhash.fingerprint("a b c")
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("tile", [4, 32768])
def test_agrees_with_all_pairs(spark, tile):
    texts = awkward()
    base = prose(9, 150).split()
    texts += [(100 + n, " ".join(base[:n] + ["x"] + base[n + 1 :])) for n in range(40)]
    texts += [(200 + n, prose(300 + n, 40)) for n in range(40)]
    got = simhash.near_duplicates(frame(spark, texts), tile_rows=tile).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute(texts)
    assert sum(r.doc_id is None for r in got) == 2 and all(r.component_id is None for r in got if r.doc_id is None)


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(1000, i) for i in range(1001, 1100)]
    loop = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    links = spark.createDataFrame(chain + star + loop + [(5, 5), (9000, 9000)] + chain[:5], "u long, v long")
    got = {tuple(r) for r in components(links).collect()}
    want = {(i, 0) for i in range(51)} | {(i, 1000) for i in range(1000, 1100)} | {(2000 + i, 2000) for i in range(7)}
    assert got == want
    assert components(links.limit(0)).collect() == []


def test_repeated_rows_stay_rows(spark):
    got = simhash.near_duplicates(spark.createDataFrame(rows([(1, "a b c d e")] * 3), SCHEMA)).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {1}
