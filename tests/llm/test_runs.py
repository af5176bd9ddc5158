import hashlib
import random
import zlib

import numpy as np
import pytest

from riskloom.llm import runs

from .frames import SCHEMA, awkward, frame, prose


def brute(words, exponent=4, least=6):
    """Every maximal stretch for every period; a stretch counts for its smallest period."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        at = 0
        while at + p < n:
            end = at
            while end + p < n and words[end] == words[end + p]:
                end += 1
            length = end + p - at
            if end > at and length >= max(least, exponent * p):
                found.setdefault((at, length), p)
            at = max(end, at) + 1
    return sorted((s, l, p) for (s, l), p in found.items())


def own(words, **settings):
    return [tuple(r) for r in runs.runs_of([[w.encode() for w in words]], **settings)[0].tolist()]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


CASES = [
    [], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 40, list("abababab"), list("abababa"), list("xabcabcabcabcaby"), list("abaababaab" * 5),
    fibonacci(300), list("aabaab" * 8 + "c" + "ab" * 9), list("ab" * 4 + "ba" * 4 + "b" * 7), ["x"] + list("abcd" * 20) + ["a"],
]


@pytest.mark.parametrize("words", CASES)
@pytest.mark.parametrize("settings", [{}, {"exponent": 2, "least": 2}, {"exponent": 3, "least": 5}])
def test_runs_are_those_of_the_definition(words, settings):
    assert own(words, **settings) == brute(words, **settings)


@pytest.mark.parametrize("seed", range(60))
def test_random_words(seed):
    draw = random.Random(seed)
    words = []
    while len(words) < draw.randint(1, 200):
        block = draw.choices("abc", k=draw.randint(1, 9))
        words += block * draw.randint(1, 7) + draw.choices("abcd", k=draw.randint(0, 6))
    assert own(words) == brute(words)
    assert own(words, exponent=2, least=2) == brute(words, exponent=2, least=2)


def test_texts_of_a_batch_do_not_meet():
    texts = [list("ababab"), list("ababab"), [], list("b" * 9), list("ab" * 9)]
    got = runs.runs_of([[w.encode() for w in t] for t in texts])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t) for t in texts]


def test_suffixes_and_common_parts():
    draw = random.Random(4)
    symbols = np.array([*draw.choices(range(3), k=300), 9])
    found = runs.SuffixArray(symbols)
    listed = symbols.tolist()
    assert found.order.tolist() == sorted(range(301), key=lambda i: listed[i:])
    a, b = np.array(draw.choices(range(150), k=80)), np.array(draw.choices(range(150, 301), k=80))

    def equal(x, y, step):
        n = 0
        while 0 <= x < 301 and 0 <= y < 301 and listed[x] == listed[y]:
            x, y, n = x + step, y + step, n + 1
        return n

    assert found.common_prefix(a, b).tolist() == [equal(x, y, 1) for x, y in zip(a, b, strict=True)]
    assert found.common_suffix(a, b).tolist() == [equal(x - 1, y - 1, -1) for x, y in zip(a, b, strict=True)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words) if len(words) < 2000 else [tuple(r) for r in runs.runs_of([words])[0].tolist()]
    gone = {i for s, l, p in found for i in range(s + p, s + l)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{l},{p}\n" for s, l, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return (doc_id, len(found), *shown, digest(lines), digest(kept))


def test_rows(spark):
    texts = awkward() + [(i, "x " * (i % 9) + prose(i, 30) + " la" * (i % 13) + " a b" * (i % 7)) for i in range(100, 260)]
    texts += [(300, " so " * 9000), (301, "\x0ba\tb\na\rb a b a\x0cb"), (302, None), (None, "z " * 8), (-13, "y " * 20)]
    texts += [(i, None if i % 3 else "") for i in range(400, 440)]
    got = runs.digests(runs.periodic_runs(runs.with_planted_periods(frame(spark, texts)))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((expected(*t) for t in texts), key=key)
    assert sum(r.n_runs for r in got) > 100


def test_small_batches_change_nothing(spark):
    docs = frame(spark, [(i, prose(i, 12) + " q r" * (i % 6)) for i in range(60)])
    want = sorted(map(str, runs.periodic_runs(docs).collect()))
    assert sorted(map(str, runs.periodic_runs(docs, batch_words=1).collect())) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert runs.digests(runs.periodic_runs(runs.with_planted_periods(empty))).collect() == []


def test_children_of_intervals():
    lcp = np.array([0, 3, 3, 1, 3, 1, 0, 2, 2, 2])
    got = sorted(zip(*(v.tolist() for v in runs._children(lcp, 2)), strict=True))
    # (depth, first, after, child first, child after): all but one of the largest children
    assert len(got) == 2 + 2 + 1 + 3
    whole = {(1, 0, 6): [(0, 3), (3, 5), (5, 6)], (3, 0, 3): [(0, 1), (1, 2), (2, 3)], (3, 3, 5): [(3, 4), (4, 5)],
             (2, 6, 10): [(6, 7), (7, 8), (8, 9), (9, 10)]}
    assert all((g[3], g[4]) in whole[g[:3]] for g in got) and (1, 0, 6, 0, 3) not in got
