import random
import re
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import collocations as colloc
from riskloom.llm import quotient

from .frames import SCHEMA, awkward, frame, prose

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, least, top=2000, longest=5, covered=100):
    counts, totals = {}, Counter()
    for _, text, *rest in texts:
        lang = (rest[0] if rest else None) or "und"
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n, found = totals[lang], []
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(a, inside.get(p[i : i + k], 0))
        for p, a in cands.items():
            if 100 * inside.get(p, -1) >= covered * a:
                continue
            score, _, l, r = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def texts():
    draw, vocabulary = random.Random(1), prose(11, 40).split() + ["Ünï", "字", "A\x1fb", "don't", "(x)"]
    made = list(awkward())
    for i in range(300):
        words = draw.choices(vocabulary, [1 / (k + 1) for k in range(45)], k=draw.randint(1, 60))
        if i % 3:
            words[3:3] = ["New", "york\tstock", "exchange", "opens", "at", "noon"][: i % 7]
        joined = "".join(w + draw.choice([" ", "  ", "\t", ". ", ",", "\n", " ! ", " "]) for w in words)
        made.append((1000 + i, joined, [None, "en", "de", "en"][i % 4]))
    return made


@pytest.mark.parametrize("settings", [
    {"least": 3}, {"least": 2, "chunk_words": 50, "shard_grams": 8}, {"least": 5, "top": 7, "chunk_words": 400},
    {"least": 3, "covered": 60, "longest": 4}, {"least": 10_000_000},
])
def test_agrees_with_counting_everything(spark, settings):
    rows = texts()
    got = colloc.collocations(frame(spark, rows).repartition(3), **settings)
    plain = {k: v for k, v in settings.items() if k in ("least", "top", "longest", "covered")}
    want = brute(rows, **plain)
    assert sorted(map(tuple, got.collect())) == want
    assert bool(want) == (settings["least"] < 1000)


def test_no_rows(spark):
    assert colloc.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("length,bits", [(2, 1), (2, 7), (5, 12), (5, 13), (5, 16), (3, 21), (5, 25), (5, 32), (4, 33), (5, 64), (2, 64)])
def test_permutation_and_filter_lose_nothing(length, bits):
    draw = np.random.default_rng(bits)
    words = draw.integers(0, min(1 << bits, 1 << 63), (3000, length), dtype=np.uint64)
    words[:1500] = draw.integers(0, min(1 << bits, 5), (1500, length), dtype=np.uint64)
    packing = quotient.Packing(length, bits)
    keys = packing.keys(words)
    assert (packing.words(keys) == words).all()
    distinct, counts, number = quotient.sort_count(keys)
    want = Counter(map(tuple, words.tolist()))
    assert dict(zip(map(tuple, packing.words(distinct).tolist()), counts.tolist(), strict=True)) == want
    assert (distinct[number] == keys).all()
    counts[::3] += 700
    for shard_bits in (0, 1, min(5, packing.width), min(11, packing.width)):
        cut = quotient.cut_in_shards(packing, distinct, counts, shard_bits)
        read = [quotient.QuotientFilter.from_bytes(packing, f.shard, shard_bits, f.to_bytes()) for f in cut]
        assert (np.concatenate([f.keys for f in read]) == distinct).all()
        assert (np.concatenate([f.counts for f in read]) == counts).all()
        merged, numbers = quotient.merge([read[0], read[0]])
        assert (merged.counts == 2 * read[0].counts).all() and (numbers[1] == np.arange(len(read[0].keys))).all()


def test_filter_is_compact_and_shards_are_even():
    words = np.stack(np.meshgrid(np.arange(300), np.arange(300)), axis=-1).reshape(-1, 2)
    packing = quotient.Packing(2, 16)
    keys, counts, _ = quotient.sort_count(packing.keys(words))
    sizes = np.bincount(packing.shard(keys, 6), minlength=64)
    assert sizes.max() < 1.3 * sizes.mean()
    body = quotient.QuotientFilter(packing, 0, 0, keys, counts).to_bytes()
    assert len(body) < 4.5 * len(keys)  # against 16 bytes for two plain numbers
    assert quotient.cut_in_shards(packing, keys[:0], counts[:0], 3) == []


def test_stretches():
    seq = np.array([5, 6, 0, 7, 8, 9, 0, 4])
    assert colloc._windows(seq, 2).tolist() == [0, 3, 4] and colloc._windows(seq, 9).tolist() == []
    assert colloc._stretches(seq, seq > 0, 0, 2).tolist() == [5, 6, 0, 7, 8, 9, 0]
    good = np.array([True, False, False, True, True, False, False, False])
    assert colloc._stretches(seq, good, 1, 3).tolist() == [7, 8, 9, 0]
    assert colloc._stretches(seq, good, 1, 2).tolist() == [5, 6, 0, 7, 8, 9, 0]
