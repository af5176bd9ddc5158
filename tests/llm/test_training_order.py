import numpy as np
import pytest
import tiktoken

from riskloom.llm import training_order as order

from .frames import SCHEMA, awkward, frame, prose


def plain():
    with open(order.VOCABULARY, "rb") as file:
        return order.Encoder(file.read())


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_and_inverts(size):
    own = order.Permutation(size, "k")
    slots = own.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (own.sequences(slots) == np.arange(size)).all()
    if size > 100:
        assert (order.Permutation(size, "other").slots(np.arange(size)) != slots).any()


@pytest.mark.parametrize("text", [
    "a b", " a", "a ", "a  b", "it's we'll 12 34,5", "x\ny\n\nz", "\n", "a  b", "a  b", "a\t b\r\n c", "tab\tx y",
    "é ü 字 字 😀 x", "a\x85 b", "don 't", prose(1, 400), "a\n b", "a \nb", "x\x1c y", "a  b", "a　b c", "... ,, !!  ?",
])
def test_ids_are_those_of_the_published_pattern(text):
    tokenizers, own = pytest.importorskip("public_tokenizers"), plain()
    published = tiktoken.Encoding(
        "published", pat_str=tokenizers.PATTERN, mergeable_ranks=own.encoding._mergeable_ranks, special_tokens={})
    assert own.encode(text) == published.encode_ordinary(text)
    assert own.encoding.decode(own.encode(text)) == text


def test_round_trip(spark, tmp_path):
    texts, path = awkward(), str(tmp_path / "shards")
    total = order.write_shards(frame(spark, texts).repartition(3), path, length=16, shard_records=100)
    got = order.read_shards(spark, path, 16, 100).collect()
    assert sorted(r.slot for r in got) == list(range(total)) and total > 1000
    encoding, by_doc = plain().encoding, {}
    for r in got:
        assert (r.shard, r.offset) == order.locate(r.slot, 16, 100)
        ids = np.frombuffer(bytes(r.tokens), "<u2").tolist()
        assert len(ids) == r.n_tokens
        by_doc.setdefault(r.doc_id, []).append((r.part, ids))
    for doc_id in {i for i, _ in texts}:
        want = sorted(encoding.encode_ordinary(t or "") + [order.END_OF_TEXT] for i, t in texts if i == doc_id)
        parts = sorted(by_doc[doc_id], key=lambda p: p[0])
        assert sum(len(i) for _, i in parts) == sum(map(len, want))
        if len(want) == 1:
            assert sum((i for _, i in parts), []) == want[0]


def test_reruns_agree_and_reading_resumes(spark, tmp_path):
    docs = frame(spark, awkward()).coalesce(1)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for path in (a, b):
        order.write_shards(docs, path, length=32, shard_records=64)
    first = sorted(tuple(map(str, r)) for r in order.read_shards(spark, a, 32, 64).collect())
    assert first == sorted(tuple(map(str, r)) for r in order.read_shards(spark, b, 32, 64).collect())
    late = order.read_shards(spark, a, 32, 64, first_slot=130).collect()
    assert min(r.slot for r in late) == 130 and len(late) == len(first) - 130
    sizes = sorted(p.stat().st_size for p in (tmp_path / "a").glob("part-*"))
    assert set(sizes[1:]) == {64 * order.stride(32)}


def test_damage_and_no_rows(spark, tmp_path):
    path = tmp_path / "s"
    order.write_shards(frame(spark, [(1, "a b c")]), str(path), length=8)
    next(path.glob("part-*")).write_bytes(b"short")
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="no whole records"):
        order.read_shards(spark, str(path), 8).collect()
    assert order.materialised_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_order_is_noticed(spark, tmp_path, monkeypatch):
    docs = frame(spark, awkward())
    real = order._count
    monkeypatch.setattr(order, "_count", lambda *a: {t: (n, c + 1) for t, (n, c) in real(*a).items()})
    with pytest.raises(Exception, match="another order"):
        order.write_shards(docs, str(tmp_path / "s"), length=16)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
