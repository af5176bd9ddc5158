"""Every stage against a plain version of it, on small documents with planted cases."""

import pytest

import corpus_pipeline
from riskloom.llm import training_order
from riskloom.session import materialize

from .frames import awkward, frame, prose
from .test_decontaminate import edits, normal
from .test_simhash import brute

ALPHABETS = {"en": "abcdefghi", "fr": "hijklmnop", "de": "qrstuvwxy"}


def corpus():
    texts = [(i, t, "en", "s1") for i, t in awkward() if i is not None]
    for n in range(150):
        lang = sorted(ALPHABETS)[n % 3]
        text = prose(n, 50 + n % 30, ALPHABETS[lang])
        if n % 10 == 0:
            text = prose(1000 + n % 4, 25) + " " + text
        texts.append((100 + n, text, lang, f"s{n % 4}"))
        if n % 5 == 0:
            texts.append((1000 + n, text, lang, "s0"))
    texts += [(11, "12 34", "en", "s0"), (12, "--- !", None, None)]
    return texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    frame(spark, corpus()).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(k, prose(1000 + k, 25)) for k in range(4)] + [(None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = materialize(stages[name](spark, docs, folder), "test-stage")
        return out, sorted((r.doc_id, r.text) for r in out.collect() if name != "training_order")

    before = [(r.doc_id, r.text) for r in docs.collect()]
    docs, after = step("language_id", docs)
    assert docs.columns == columns
    assert after == sorted((i, t) for i, t in before if any(c.isalpha() for c in t or ""))

    docs, kept = step("simhash_near_dedup", docs)
    assert docs.columns == columns
    heads = {c for _, _, c in brute(after)}
    assert [i for i, _ in kept] == sorted(heads)

    docs, clean = step("benchmark_decontamination", docs)
    items = [normal(prose(1000 + k, 25)) for k in range(4)]
    leaky = {i for i, t in kept if len(t) < 5000 and any(edits(x, normal(t)) <= int(0.08 * len(x)) for x in items)}
    assert docs.columns == columns and leaky and clean == [(i, t) for i, t in kept if i not in leaky]

    docs, mixed = step("source_mix", docs)
    assert docs.columns == columns
    counts = {i: sum(j == i for j, _ in mixed) for i, _ in clean}
    assert set(counts.values()) <= {0, 1, 2} and sum(counts.values()) == len(mixed)
    words = sum(len(t.encode().split()) for _, t in clean)
    longest = max(len(t.encode().split()) for _, t in clean)
    assert 1.5 * words - 2 * longest <= sum(len(t.encode().split()) for _, t in mixed) <= 1.5 * words

    slots, _ = step("training_order", docs)
    rows = slots.collect()
    with open(training_order.VOCABULARY, "rb") as file:
        encoder = training_order.Encoder(file.read())
    want = sum(len(encoder.encode(t)) // 512 + 1 for _, t in mixed)
    assert sorted(r.slot for r in rows) == list(range(want))
    assert sum(r.n_tokens for r in rows) == sum(len(encoder.encode(t)) + 1 for _, t in mixed)


def test_run_is_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "tokens_crc32"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_rows_without_id_and_repeated_ids(spark, folder):
    texts = awkward() + [(2, prose(77, 40)), (1, prose(2, 60))]
    docs = frame(spark, [(i, t, "en", "s") for i, t in texts])
    out = corpus_pipeline.near_dedup(spark, docs, folder)
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert out.columns == docs.columns
    assert [i for i, _ in got].count(0) == 2  # rows without an id stay
    assert len({i for i, _ in got if i}) == len([i for i, _ in got if i])


def test_documents_stay_where_no_language_can_be_learned(spark, folder):
    docs = frame(spark, [(1, "some words", None, "s"), (2, "12 34", None, "s"), (3, None, None, "s"), (4, "", None, "s"), (5, "\u5b57", None, None)])
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5]


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty_documents(spark, tmp_path, rows):
    path = str(tmp_path)
    frame(spark, [(1, "a")]).limit(0).write.parquet(f"{path}/documents.parquet") if not rows else frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
