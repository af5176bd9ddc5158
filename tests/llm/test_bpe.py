import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import bpe

from .frames import SCHEMA, awkward, frame, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return bpe.Encoder(bpe.Vocabulary(file.read()))


def ids(own, text):
    packed = own.encode([text])[0]
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def decoded(own, *lists):
    texts = bpe.Decoder(own.vocabulary).decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist()
    return texts[0] if len(texts) == 1 else texts


TEXTS = [
    "", " ", "a", "Hello world", "it's we'll 12 34,5 'S", "x\ny\n\nz  ", "tab\tx  y\r\n z", "é ü 字字 😀 👩‍👩‍👧", "a\x85b\x1cc",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "-" * 300,
    " " * 500, "=" * 77 + "x", "ab" * 400, "՘ x՘y 1࢏", "a　1 b", "�\x00\x7f", "don't DON'T o'clock'",
    "antidisestablishmentarianism floccinaucinihilipilification", "1234567890" * 9, "\U0001fae8\U0001faf7 ౜",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_text_are_the_librarys(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want
    assert decoded(own, want) == library.decode(want, skip_special_tokens=False) == text


def test_random_texts(own, library):
    draw = random.Random(3)
    for alphabet in ["ab", "aeiounrst ", "the and ing ", "é字 \n\t'1.", "".join(map(chr, range(0x20, 0x500)))]:
        for _ in range(150):
            text = "".join(draw.choices(alphabet, k=draw.randint(1, 60)))
            assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_trie_gives_what_merging_by_definition_gives(own):
    draw = random.Random(5)
    words = {"".join(draw.choices("aeiounrstlhd", k=draw.randint(1, 14))).encode() for _ in range(400)}
    words |= {bytes(draw.choices(range(256), k=draw.randint(1, 9))) for _ in range(200)}
    trie = bpe.Trie(own.vocabulary)
    assert all(found == own.vocabulary.plain(word) for word, found in trie.encode(list(words)))
    prefixes = {w[:n] for w in words for n in range(len(w) + 1)}
    assert len(trie.last) == len(prefixes)  # a shared prefix is one node
    assert all(found == own.vocabulary.plain(word) for word, found in trie.encode(list(words)))
    assert len(trie.last) == len(prefixes)


def test_small_tries_and_pair_tables_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    monkeypatch.setattr(bpe, "PART", 40)
    small = bpe.Encoder(own.vocabulary, max_nodes=20)
    for text in [prose(7, 200), prose(8, 200), *TEXTS]:
        assert ids(small, text) == library.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text(own, library):
    broken = [own.vocabulary.ids[bytes([b])] for b in (0xE5, 0xAD, 0x41, 0xFF, 0xF0, 0x9F, 0x98)]
    assert decoded(own, broken) == library.decode(broken, skip_special_tokens=False)


def test_lists_of_ids(own):
    a, b = ids(own, "a 字 <|endoftext|>"), ids(own, "b")
    assert decoded(own, a, [], None, b, None) == ["a 字 <|endoftext|>", "", None, "b", None]
    held = pa.array([b, a, None, b], pa.list_(pa.int32())).slice(1, 2)
    assert bpe.Decoder(own.vocabulary).decode(held).to_pylist() == ["a 字 <|endoftext|>", None]
    with pytest.raises(ValueError, match="not in the vocabulary"):
        decoded(own, [None])


def test_rows(spark, library):
    texts = awkward() + [(20, "a <|endoftext|>"), (21, "x" * 50_000), (22, prose(4, 50) + " ՘")]
    got = bpe.decode(bpe.encode(frame(spark, texts), PATH), PATH)
    want = []
    for doc_id, text in texts:
        found = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(found), found, text or ""))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    hashed = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(got).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert hashed == {(i, n, digest(",".join(map(str, found))), digest(text)) for i, n, found, text in want}


def test_no_rows_and_null_ids(spark):
    assert bpe.digests(bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), PATH), PATH)).collect() == []
    rows = spark.createDataFrame([(1, None, None)], "doc_id long, n_tokens long, ids array<int>")
    assert bpe.decode(rows, PATH).select(F.col("text").isNull()).first()[0]


def test_other_kinds_of_files_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file, pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(file.read())
