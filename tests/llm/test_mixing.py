import pytest

from riskloom.llm import mixing
from riskloom.llm.queries import OP7
from suite.compare import compare

from .frames import SCHEMA, awkward, frame, prose


def corpus():
    texts = [(i, t, None, None) for i, t in awkward()]
    for n in range(400):
        source = ["a", "b", "é", None, "zz"][n % 5] if n % 2 else "hot"
        texts.append((100 + n, prose(n, 20 + n % 40), None, source))
    return texts + [(100, prose(0, 20), None, "hot")] * 2


def test_agrees_with_sql(spark):
    import duckdb

    docs = frame(spark, corpus())
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert compare(got, con, OP7) == []


def test_targets_and_bounds(spark):
    got = mixing.mix(frame(spark, corpus())).collect()
    total = sum(r.size for r in got)
    by_source = {}
    for r in got:
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 2 * r.size
        one = by_source.setdefault((r.missing, r.name), [r.target, 0, 0, 0])
        one[1] += r.taken
        one[2] += r.size
        one[3] = max(one[3], r.size)
    assert abs(sum(t for t, *_ in by_source.values()) - 1.5 * total) < 1e-6 * total
    for target, taken, size, largest in by_source.values():
        assert target <= 2 * size + 1e-9
        # A queue stops within a document of its target; what all leave is shared among the rest.
        assert abs(taken - target) <= largest + 0.05 * target
    weights = sorted(by_source)
    assert [m for m, _ in weights][-1] is True


def test_reruns_agree_and_order_of_rows_does_not_matter(spark):
    docs = frame(spark, corpus())
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.orderBy("text").repartition(7)))
    assert a == b


def test_applied_copies(spark):
    docs = frame(spark, corpus())
    mixed = mixing.mix(docs)
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns
    want = sum(r.taken // r.size for r in mixed.collect() if r.size)
    assert out.count() == want
    words = sum(len((r.text or "").encode().split()) for r in out.select("text").collect())
    assert words == sum(r.taken for r in mixed.collect())


@pytest.mark.parametrize("texts", [[], [(1, None), (2, "")], [(1, "a b c", None, "s")]])
def test_small_tables(spark, texts):
    docs = frame(spark, texts) if texts else spark.createDataFrame([], SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) and all(r.taken in (0, 3, 6) for r in got)
