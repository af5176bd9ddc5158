import math
import zlib

import numpy as np
import pytest

from riskloom.llm import language

from .frames import SCHEMA, awkward, frame, prose

ALPHABETS = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "mnopqrst", "dd": "uvwxyzab"}


def corpus(count=120):
    return [(100 + n, prose(n, 60, ALPHABETS[lang]), lang, "s") for n in range(count)
            for lang in [sorted(ALPHABETS)[n % 4]]]


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 6, 20):
        words = language.codewords(n)
        apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
        assert len(words) == n and min(apart) >= words.shape[1] / 2


def test_held_out_accuracy_and_rule(spark):
    texts = corpus()
    got = language.identify(frame(spark, texts)).collect()
    truth = {i: lang for i, _, lang, _ in texts}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95


def test_lang_of_held_out_rows_is_not_used(spark):
    texts = corpus()
    lied = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in texts]
    a, b = (sorted(tuple(r) for r in language.identify(frame(spark, x)).collect()) for x in (texts, lied))
    assert a == b


def test_awkward_rows(spark):
    texts = [(i, t, None, None) for i, t in awkward()] + corpus(40) + [(11, "12 34 --", "aa", "s")]
    got = language.identify(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert none == {3, 4, 5, 11, None} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert sum(r.doc_id is None for r in got) == 2 and not any(r.held_out for r in got if r.doc_id is None)
    assert {r.lang_pred for r in got} - {"und"} <= set(ALPHABETS)


def test_nothing_learnt_and_one_language(spark):
    got = language.identify(frame(spark, [(i, t, None, None) for i, t in awkward()])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    got = language.identify(frame(spark, [x for x in corpus() if x[2] == "aa"])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 1.0)}
    assert language.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_counts_whole(spark):
    model = language.learn(frame(spark, corpus()))
    text = prose(1, 10, ALPHABETS["aa"]) + " " + prose(2, 60_000, ALPHABETS["cc"])
    best = model.decode(model.margins(text)[None])[0][0]
    assert model.languages[best] == "cc"


def plain_buckets(text, size=8192):
    """Buckets of all n-grams of one to three code points, one by one."""
    points = [32 if c < 65 or 90 < c < 97 or 122 < c < 170 else c for c in map(ord, text.lower())]
    found = []
    for start in range(len(points)):
        gram = 0
        for n in range(3):
            if start + n < len(points):
                gram = (gram * 0x9E3779B97F4A7C15 + points[start + n] + 1) % 2**64
                found.append(((gram ^ (gram >> 29)) * 0xBF58476D1CE4E5B9 % 2**64 >> 32) % size)
    return found


def plain_labels(texts, size=8192):
    """Languages and scores by plain loops: counts, odds of every split, weighted losses of the codewords."""
    languages = sorted({lang for _, _, lang, _ in texts})
    splits = range(1, 2 ** (len(languages) - 1))  # bit b of a split: the side of language b + 1; the first is below
    side = [[b > 0 and bool(s >> (b - 1) & 1) for s in splits] for b in range(len(languages))]
    rates = []
    for lang in languages:
        counts = [0] * size
        for i, text, own, _ in texts:
            if own == lang and zlib.crc32(str(i).encode()) % 3 != 1:
                for bucket in plain_buckets(text):
                    counts[bucket] += 1
        total = sum(counts)
        rates.append([(n + 0.5) / (total + 0.5 * size) for n in counts])
    weights, gaps = [], []
    for bit in range(len(splits)):
        up = [r for r, s in zip(rates, side, strict=True) if s[bit]]
        down = [r for r, s in zip(rates, side, strict=True) if not s[bit]]
        odds = [
            math.log(sum(r[k] for r in up) / len(up)) - math.log(sum(r[k] for r in down) / len(down)) for k in range(size)
        ]
        gap = sum(abs(sum(a * b for a, b in zip(r, odds, strict=True))) for r in rates) / len(rates)
        weights.append([o / gap for o in odds])
        gaps.append(gap)
    answers = {}
    for i, text, _, _ in texts:
        grams = plain_buckets(text)
        margins = [sum(w[g] for g in grams) / len(grams) for w in weights]
        losses = [
            sum(gap / sum(gaps) * math.log1p(math.exp(-8.0 * m * (1 if up else -1))) for m, up, gap in zip(margins, s, gaps, strict=True))
            for s in side
        ]
        best = min(losses)
        answers[i] = languages[losses.index(best)], 1 / sum(math.exp(best - x) for x in losses)
    return answers


def test_equals_plain_loops(spark):
    texts = corpus(48)
    wanted = plain_labels(texts)
    for r in language.identify(frame(spark, texts)).collect():
        assert r.lang_pred == wanted[r.doc_id][0]
        assert r.score == pytest.approx(wanted[r.doc_id][1], abs=1e-9)


def test_pieces_count_every_ngram_once(spark, monkeypatch):
    for count in (62, 63, 64, 65, 66, 128, 200):
        text = prose(3, 200, ALPHABETS["bb"])[:count]
        whole = sorted(plain_buckets(text))
        for chunk in (64, 1 << 18):
            monkeypatch.setattr(language, "CHUNK", chunk)
            got = [b for codes in language._pieces(text) for part in language._buckets(codes, 8192) for b in part.tolist()]
            assert sorted(got) == whole
