import itertools

import numpy as np
import pytest

from riskloom.llm import paragraphs
from riskloom.llm.queries import op4

from .frames import SCHEMA, awkward, frame, prose


def brute(texts, least=30, similarity=0.8, width=5):
    """Occurrences in classes over two documents or more, from all pairs of paragraphs."""
    found = []
    for doc_id, text in texts:
        for number, line in enumerate((text or "").split("\n")):
            words = line.lower().split()
            if doc_id is not None and len(words) >= least:
                found.append((doc_id, number, {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}))
    label = list(range(len(found)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(found)), 2):
        a, b = found[i][2], found[j][2]
        if len(a & b) >= similarity * len(a | b):
            low, high = sorted((find(i), find(j)))
            label[high] = low
    classes = {}
    for i, (doc_id, number, _) in enumerate(found):
        classes.setdefault(find(i), []).append((doc_id, number))
    return sorted(tuple(sorted(c)) for c in classes.values() if len({d for d, _ in c}) > 1)


def classes(result):
    found = {}
    for r in (r for r in result if r.kind == "paragraph"):
        found.setdefault(r.class_id, []).append((r.doc_id, r.paragraph))
    return sorted(tuple(sorted(c)) for c in found.values())


def near(base, n, step=9):
    """Copies of a paragraph, each with one word changed."""
    words = base.split()
    return [" ".join(words[: k * step % len(words)] + ["zz%d" % k] + words[k * step % len(words) + 1 :]) for k in range(n)]


@pytest.mark.parametrize("tile", [3, 512])
def test_agrees_with_all_pairs(spark, tile):
    a, b = prose(1, 90), prose(2, 60)
    texts = [(n, "\n".join([prose(100 + n, 40), t, "short line", prose(200 + n, 35)])) for n, t in enumerate(near(a, 24))]
    texts += [(50 + n, b + "\n" + prose(300 + n, 31)) for n in range(6)]
    texts += [(60 + n, prose(400 + n, 50)) for n in range(10)]
    texts += [(80, "\n".join([prose(5, 44)] * 3)), (81, prose(6, 29)), (82, prose(6, 29))]
    got = paragraphs.repeated_paragraphs(frame(spark, texts), tile=tile).collect()
    assert classes(got) == brute(texts)
    runs, got = [r for r in got if r.kind == "passage"], [r for r in got if r.kind == "paragraph"]
    assert {r.doc_id for r in runs} >= set(range(24)) | set(range(50, 56)) and not {r.doc_id for r in runs} & set(range(60, 83))
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r.class_id, r.doc_id, r.paragraph)), key=lambda r: r.class_id):
        group = list(group)
        assert [r.kept for r in group] == [True] + [False] * (len(group) - 1)
        assert {r.class_size for r in group} == {len(group)}
    by_id = dict(texts)
    for r in got:
        assert by_id[r.doc_id][r.start : r.end] == by_id[r.doc_id].split("\n")[r.paragraph]


def test_awkward_rows(spark):
    texts = awkward()
    got = paragraphs.repeated_paragraphs(frame(spark, texts)).collect()
    assert {(r.doc_id, r.kind) for r in got} == {(i, k) for i in (1, 2, 6, 7) for k in ("paragraph", "passage")}
    assert paragraphs.repeated_paragraphs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_removal_keeps_the_first_and_all_columns(spark):
    shared = prose(3, 50)
    texts = [(1, "a\n" + shared + "\nb"), (2, shared + "\nc"), (3, "d"), (4, None)]
    docs = frame(spark, texts)
    left = paragraphs.without_repeats(docs, paragraphs.repeated_paragraphs(docs))
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: texts[0][1], 2: "c", 3: "d", 4: None}


def shared_runs(texts, words=50):
    """Documents that share a run of so many words with another, by brute force."""
    where = {}
    for doc_id, text in texts:
        own = text.lower().split()
        for i in range(len(own) - words + 1):
            where.setdefault(tuple(own[i : i + words]), set()).add(doc_id)
    return {d for docs in where.values() if len(docs) > 1 for d in docs}


def test_passages_inside_lines_are_found(spark):
    shared = [prose(900 + k, 50 + k) for k in range(8)]
    texts = [(n, prose(n, 37 + n % 9) + " " + shared[n % 8] + " " + prose(500 + n, n % 40) + ("\n" if n % 3 else " ") + prose(700 + n, 20))
             for n in range(40)]
    texts += [(100 + n, prose(1000 + n, 150)) for n in range(20)] + [(200, shared[0].replace(" ", "\n", 20)), (201, prose(5000, 9) + " " + " ".join(shared[1].split()[:20]))]
    got = [r for r in paragraphs.repeated_paragraphs(frame(spark, texts)).collect() if r.kind == "passage"]
    assert {r.doc_id for r in got} == shared_runs(texts) == set(range(40)) | {200}
    by_id = dict(texts)
    for r in got:
        piece = " ".join(by_id[r.doc_id][r.start : r.end].split())
        assert len(piece.split()) >= 25 and any(piece in " ".join(by_id[d].split()) for d in by_id if d != r.doc_id)
    assert sum(r.kept for r in got) == 8


def test_places_are_code_points():
    text = "É " + prose(1, 70, "aéö字") + "\n  \tx " + prose(2, 40, "äb")
    words = paragraphs._Words(text, 5)
    assert [text[a:b] for a, b in zip(words.starts, words.ends)] == text.split()
    assert [text[a:b] for _, a, b, _, _ in words.paragraphs(1)] == text.split("\n")
    assert words.key(0, 71) == paragraphs.xxhash.xxh3_128_digest(" ".join(text.split("\n")[0].split()).encode().lower())
    assert paragraphs._Words("", 5).count == 0 and not list(paragraphs._Words("\n\n", 5).paragraphs(1))


def test_bands_give_the_recall_they_are_tuned_for():
    assert 1 - (1 - 0.8**3) ** paragraphs.tune() >= 0.995
    hits = 0
    for n in range(200):
        words = prose(n, 104).split()
        other = words[:44] + [f"q{n}"] + words[45:]  # one word in 100 shingles: similarity about 0.9
        sets = [paragraphs.shingles([w.encode() for w in x]) for x in (words, other)]
        a, b = paragraphs.band_hashes(np.concatenate(sets), np.array([len(x) for x in sets]), 8, 3, 0.8)[0].reshape(2, 8)
        hits += bool(set(a.tolist()) & set(b.tolist()))
    assert hits >= 198


def test_every_place_of_a_passage_is_returned(spark):
    shared = prose(40, 60)
    texts = [(1, shared + " " + prose(41, 45)), (2, " ".join([prose(42, 40), shared, prose(43, 40), shared, prose(44, 40), shared])),
             (3, " ".join([prose(45, 50), prose(46, 60), prose(45, 50)]))]
    docs = frame(spark, texts)
    got = paragraphs.repeated_paragraphs(docs)
    runs = [r for r in got.collect() if r.kind == "passage"]
    assert sorted((r.doc_id, r.kept) for r in runs) == [(1, True)] + [(2, False)] * 3  # doc 3 repeats itself only
    assert {r.class_size for r in runs} == {4}
    left = " ".join(r.text for r in paragraphs.without_repeats(docs, got).collect())
    middle = " ".join(shared.split()[26:34])  # 25 words from either end may be outside of all passages
    assert left.count(middle) == 1


def test_overlapping_runs_keep_one_place_of_every_passage(spark):
    x, y, z = (prose(50 + n, 80) for n in range(3))
    texts = [(1, x + " " + y), (2, " ".join([x, y, z])), (3, y + " " + z), (4, " ".join([z, y, x, prose(60, 30), z]))]
    near_copy = prose(70, 300)
    inside = " ".join(near_copy.split()[:140] + prose(71, 36).split() + near_copy.split()[160:])  # a near copy with words of its own
    own = " ".join(inside.split()[135:190])
    texts += [(10, near_copy), (11, inside), (12, prose(72, 40) + " " + own + " " + prose(73, 40))]
    docs = frame(spark, texts)
    got = paragraphs.repeated_paragraphs(docs)
    runs = [r for r in got.collect() if r.kind == "passage"]
    assert any(r.kept for r in runs if r.doc_id == 2) and not all(r.kept for r in runs if r.doc_id == 2)
    for r, s in itertools.combinations(runs, 2):
        assert r.doc_id != s.doc_id or r.kept == s.kept or r.end <= s.start or s.end <= r.start
    rest = {r.doc_id: r.text for r in paragraphs.without_repeats(docs, got).collect()}
    places = {}
    for doc_id, text in texts:
        words = paragraphs._Words(text, 5)
        for begin, key in zip(*words.passages(26)):
            places.setdefault(int(key), {})[doc_id] = " ".join(text.split()[begin : begin + 25])
    shared = [where for where in places.values() if len(where) > 1]
    assert len(shared) > 15
    for where in shared:
        piece = next(iter(where.values()))
        assert sum(" ".join(t.split()).count(piece) for t in rest.values()) == 1


def test_the_query_compares_short_lines(spark, tmp_path):
    a, b, c = prose(80, 29), prose(81, 5), prose(82, 9)
    texts = [(n, prose(100 + n, 12) + "\n" + t) for n, t in enumerate([a, a.upper(), a + " end", b, b, c, "of " + c, prose(83, 4), prose(83, 4)])]
    texts += [(20 + n, t) for n, t in enumerate(near(prose(84, 28), 8))] + [(40, prose(85, 6) + "\n" + prose(85, 6))]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = op4(spark, str(tmp_path)).collect()
    assert classes(got) == brute(texts, least=5)
    assert {r.doc_id for r in got} >= set(range(7)) and not {r.doc_id for r in got} & {7, 8, 40}


def test_bands_of_many_sets_are_those_of_each(monkeypatch):
    draw = np.random.default_rng(2)
    sets = [draw.integers(0, 40, draw.integers(1, 30)).astype(np.uint64) for _ in range(300)]
    sets += [np.arange(500, dtype=np.uint64), np.array([3, 3, 3], np.uint64), np.array([3], np.uint64)]
    sizes = np.array([len(x) for x in sets])
    values, ends = paragraphs.band_hashes(np.concatenate(sets), sizes, 8, 3, 0.8)
    monkeypatch.setattr(paragraphs, "GRAMS", 16)
    small, same = paragraphs.band_hashes(np.concatenate(sets), sizes, 8, 3, 0.8)
    assert (values == small).all() and (ends == same).all()
    own = [tuple(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for one, bands in zip(sets, own, strict=True):
        alone = paragraphs.band_hashes(np.unique(one), np.array([len(np.unique(one))]), 8, 3, 0.8)[0]
        assert bands == tuple(alone.tolist()) and len(bands) == (1 if len(set(one.tolist())) < 4 else 8)
    for i in range(len(sets)):
        for j in range(i):
            if len(own[i]) == 1 or len(own[j]) == 1:  # one band decides: exactly equal sets meet
                assert (set(own[i]) & set(own[j]) != set()) == (set(sets[i].tolist()) == set(sets[j].tolist()))
