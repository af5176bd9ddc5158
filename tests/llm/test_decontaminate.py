import random

import numpy as np
import pytest

from riskloom.llm import decontaminate as dec

from .frames import SCHEMA, awkward, frame, prose


def edits(item, text):
    """Fewest edits between ``item`` and any substring of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def spoiled(text, n, seed):
    drawn, chars = random.Random(seed), list(text)
    for _ in range(n):
        at = drawn.randrange(len(chars))
        kind = drawn.randrange(3)
        if kind == 0:
            chars[at] = "q"
        elif kind == 1:
            chars.insert(at, "q")
        else:
            del chars[at]
    return "".join(chars)


def normal(text):
    return dec.normal_form(text)[0].astype("<u4").tobytes().decode("utf-32-le")


def test_agrees_with_the_plain_edit_table(spark):
    items = [(n, prose(n, 14 + n)) for n in range(8)]
    texts = []
    for n in range(60):
        item = items[n % 8][1]
        texts.append((n, prose(500 + n, 12) + " " + spoiled(item, n % 16, n) + " " + prose(900 + n, 12)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dec.leaks(frame(spark, texts), benchmark).collect()}
    want = {}
    for i, t in texts:
        for k, item in items:
            own = normal(item)
            e = edits(own, normal(t))
            if e <= min(int(len(own) * 0.08), (len(own) - 10) // 10):
                want[i, k] = e
    assert got == want and len(want) > 20


def test_case_marks_and_spaces_do_not_hide_a_leak_and_spans_are_places(spark):
    item = prose(3, 30)
    text = "Start. " + item.upper().replace(" ", ",\n ") + "! End"
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    (row,) = dec.leaks(frame(spark, [(1, text)]), benchmark).collect()
    assert (row.item_id, row.edits) == (7, 0)
    assert normal(text[row.start : row.end]) == normal(item)


def test_leaks_across_pieces_of_a_long_text(monkeypatch):
    item = prose(4, 25)
    own = dec.Block.build([(1, item)], 10, 0.08)
    monkeypatch.setattr(dec, "PIECE", 500)
    for at in (0, 70, 97, 140):
        words = prose(5, 200).split()
        text = " ".join(words[:at] + [item] + words[at:])
        (place,), *others = own.search([text, "", prose(6, 50)])
        assert place[:2] == (1, 0) and normal(text[place[2] : place[3]]) == normal(item) and others == [[], []]


def test_awkward_rows(spark):
    texts = awkward()
    benchmark = spark.createDataFrame(
        [(1, prose(2, 60)), (1, prose(2, 60)), (None, prose(2, 60)), (2, None), (3, ""), (4, "short"), (5, "x")],
        "item_id long, text string")
    got = dec.leaks(frame(spark, texts), benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in got) == sorted(
        (d, i) for d in (0, 1, 2, 2) for i in (0, 1, 1)
    )
    assert dec.leaks(frame(spark, texts), benchmark.limit(0)).collect() == []
    assert dec.leaks(spark.createDataFrame([], SCHEMA), benchmark).collect() == []


def test_benchmark_in_blocks_gives_the_same(spark):
    items = [(n, prose(n, 20)) for n in range(6)]
    texts = [(n, prose(70 + n, 9) + " " + items[n % 6][1]) for n in range(12)]
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), frame(spark, texts)
    a, b = (sorted(tuple(r) for r in dec.leaks(docs, benchmark, block_chars=c).collect()) for c in (1 << 20, 200))
    assert a == b and len(a) == 12


@pytest.mark.parametrize("seed", range(4))
def test_short_items_keep_their_budget_and_every_place_is_found(seed):
    """Items of 3 to 60 code points: what is returned holds the item, what is left when it is cut does not."""
    drawn = random.Random(seed)

    def letters(n):
        return "".join(drawn.choice("abcdefghijklmnop") for _ in range(n))

    items = [(m, letters(m)) for m in range(3, 61)]
    block = dec.Block.build(items, 10, 0.08)
    assert sorted(i for p in block.parts for i in p.ids) == list(range(3, 61))
    texts = []
    for m, item in items:
        allowed = int(m * 0.08)
        parts = [spoiled(item, k, seed * 1000 + m * 10 + n) for n, k in enumerate((0, allowed, allowed + 1, allowed))]
        texts.append(letters(30).join(["", *parts, ""]))
    for (m, item), text, found in zip(items, texts, block.search(texts), strict=True):
        own = [r for r in found if r[0] == m]
        assert len(own) >= 3 and own == sorted(own)
        rest = text
        for _, e, start, end in own:
            assert e == edits(item, text[start:end]) <= int(m * 0.08)
            rest = rest[:start] + "\u4e00" * (end - start) + rest[end:]
        assert edits(item, rest) > int(m * 0.08)
        places = sorted(r[2:] for r in own)
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))


def test_an_item_three_times_in_one_text_and_one_id_over_two_texts(spark):
    item = prose(11, 15)
    text = prose(21, 8).join([item, item.upper(), spoiled(item, 2, 5)])
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = dec.leaks(frame(spark, [(1, text), (1, prose(22, 30)), (1, item)]), benchmark).collect()
    assert sorted(r.start == 0 for r in rows) == [False, False, True, True] and {r.doc_id for r in rows} == {1}
    (found,) = dec.Block.build([(7, item)], 10, 0.08).search([text])
    assert len(found) == 3
    for _, _, start, end in found:
        text = text[:start] + "\u4e00" * (end - start) + text[end:]
    assert edits(normal(item), normal(text)) > int(len(normal(item)) * 0.08)


def test_blocks_are_searched_one_after_another(spark):
    items = [(n, prose(n, 20)) for n in range(16)]
    benchmark = spark.createDataFrame([*items, items[3]], "item_id long, text string")
    texts = [(n, prose(70 + n, 9) + " " + items[n][1] + " and " + items[(n + 5) % 16][1]) for n in range(16)]
    docs = frame(spark, [*texts, texts[0], (None, texts[1][1]), (99, None), (98, "")])
    docs = docs.withColumn("hits", docs.doc_id).withColumn("text_digest", docs.doc_id)
    one, many = (dec.with_leaks(docs, benchmark, "leaks", block_chars=c) for c in (1 << 20, 300))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    found = [sorted(str(r) for r in df.collect()) for df in (one, many)]
    assert found[0] == found[1] and len(found[0]) == 20 and one.columns == many.columns


@pytest.mark.parametrize("q", [1, 2, 3, 7, 10])
def test_gram_hash_is_of_the_gram_alone(q):
    codes = np.array([ord(c) for c in "abcabcabcdabcdabcdefabc"], np.uint32)
    hashes = dec.gram_hashes(codes, q)
    grams = [codes[i : i + q].tobytes() for i in range(len(codes) - q + 1)]
    assert len(hashes) == len(grams) and len(set(zip(hashes.tolist(), grams))) == len(set(grams)) == len(set(hashes.tolist()))
