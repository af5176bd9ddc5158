import hashlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import chat

NASTY = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|a", "a<", "|b", "<", "<|<|", "", "\n", "\\", "%0A%25", "<|image|>",
         "é字😀", "$1 \\1", "<" * 50 + "|"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss int").withColumn(
        "parts", chat.text_parts(F.col("text")))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_string_comes_back(spark):
    rows = [(n, t, role, text, "x", 1) for n, (a, b) in enumerate((a, b) for a in NASTY for b in NASTY)
            for t, role, text in [(0, "user", a), (1, "assistant", b), (2, a, b)]]
    formatted = chat.format_conversations(turns(spark, rows))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(formatted)).collect()}
    strings = {r.conv_id: r for r in formatted.collect()}
    by_id = {}
    for conv_id, _, role, text, *_ in rows:
        by_id.setdefault(conv_id, []).append((role, text))
    for conv_id, own in by_id.items():
        r, s = got[conv_id], strings[conv_id]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == digest("".join(f"{a}\n{b}\n" for a, b in own))
        learnt = "".join(b for a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), digest(learnt))
        assert r.formatted_chars == len(s.formatted)
        assert s.formatted.count("<|im_start|>") == len(own) == s.formatted.count("<|im_end|>")


def test_parts_become_placeholders_with_references(spark):
    part = {"kind": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [part | {"kind": "text", "text": "see <|image|> "}, part | {"kind": "image", "ref": "a.png", "width": 57, "height": 28},
             part | {"kind": "audio", "ref": "b.wav", "seconds": 1.5}, part | {"kind": "document", "ref": "c.pdf", "pages": 2},
             part | {"kind": "hologram", "ref": "d"}, part, part | {"kind": "text", "text": None}, part | {"kind": "text", "text": "end"}]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (r,) = chat.format_conversations(frame).collect()
    assert r.formatted == ("<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|other|><|other|>end<|im_end|>\n"
                           "<|im_start|>assistant\n<|im_end|>\n")
    assert [tuple(a) for a in r.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 512),
                                                 (0, "other", "d", 0), (0, "other", None, 0)]
    assert r.attachment_tokens == 553
    back = chat.read_back(chat.format_conversations(frame)).first()
    assert [t.text for t in back.turns] == ["see <|image|> end", ""]


def test_awkward_rows(spark):
    rows = [(1, None, None, None, "x", 1), (1, 2, "assistant", None, "x", 1), (1, 2, "assistant", "b", "x", 1), (1, 2, "assistant", "a", "x", 1),
            (1, 2, "assistant", "a", "x", 1), (None, 0, "user", "t", "x", 1), (2, 0, "a\nb%\n", "z" * 200_000, "x", 1)]
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_conversations(turns(spark, rows)))).collect()}
    assert got[1].n_turns == 5 and got[1].loss_sha256 == digest("aab")
    assert got[1].turns_sha256 == digest("\n\n" + "".join(f"assistant\n{t}\n" for t in ["", "a", "a", "b"]))
    assert got[None].n_turns == 1
    assert got[2].turns_sha256 == digest("a\nb%\n\n" + "z" * 200_000 + "\n") and got[2].loss_chars == 0
    empty = turns(spark, rows).limit(0)
    assert chat.digests(chat.read_back(chat.format_conversations(empty))).collect() == []


def test_loss_spans_are_the_bodies(spark):
    rows = [(1, 0, "user", "<|q|>", "x", 1), (1, 1, "assistant", "<|a|> é", "x", 1), (1, 2, "assistant", "b", "x", 1)]
    (r,) = chat.format_conversations(turns(spark, rows)).collect()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["<\\|a|> é", "b"]


def test_plan_is_native(spark):
    frame = chat.digests(chat.read_back(chat.format_conversations(turns(spark, [(1, 0, "user", "t", "x", 1)]))))
    assert not any(n in frame._jdf.queryExecution().executedPlan().toString() for n in ("Python", "Arrow", "Pandas"))
    assert pytest
