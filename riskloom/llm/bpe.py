"""Byte-level BPE: distinct words in a trie whose nodes know the last token of their prefix."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

# Fixed value: the words of this family of vocabularies, in the form that never looks back.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MAX_NODES = 1 << 18  # a larger trie is begun anew, which changes no result
MAX_WORDS = 1 << 17
MAX_PAIRS = 1 << 18
ROWS = 1024  # rows of an outgoing batch
PART = 1 << 21  # characters whose words are held at once
# Between two ASCII letters a space always begins a word.
BORDER = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and special strings of a ``tokenizers`` file with byte-level BPE."""

    def __init__(self, content: bytes):
        held = json.loads(content)
        model, cut = held["model"], held["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
            and cut.get("use_regex", True) and not held["normalizer"] and not model.get("dropout")
            and not model.get("ignore_merges")
        )
        if not plain:
            raise ValueError("only byte-level BPE without normaliser, dropout and prefix space is supported")
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        added = {t["content"]: t["id"] for t in held["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.specials = added
        self.ids = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        self.bytes = {i: b for b, i in self.ids.items()}
        for token, i in added.items():
            known = all(c in byte for c in token)
            self.bytes[i] = bytes(byte[c] for c in token) if known else token.encode()
        self.sizes = {i: len(b) for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a token: the two merged into it, and the rank
        for rank, pair in enumerate(model["merges"]):
            left, right = (bytes(byte[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, whole = self.ids[left], self.ids[right], self.ids[left + right]
            if any(part in self.parts and self.parts[part][2] > rank for part in (left, right)) or whole in self.parts:
                raise ValueError("a merge stands before those of its parts, or makes a token again")
            self.merges[left, right], self.parts[whole] = (rank, whole), (left, right, rank)
        longest_first = "|".join(map(regex.escape, sorted(added, key=len, reverse=True)))
        self.special = regex.compile(f"({longest_first})") if added else None

    def plain(self, word: bytes) -> list[int]:
        """The definition: of all neighbours the pair with the lowest rank merges, the leftmost first."""
        ids = [self.ids[bytes([b])] for b in word]
        while True:
            ranked = [(self.merges[pair][0], at) for at, pair in enumerate(zip(ids, ids[1:])) if pair in self.merges]
            if not ranked:
                return ids
            _, at = min(ranked)
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]


class Trie:
    """Prefixes of all words met; each node holds the last token of its prefix's encoding.

    The encoding of a prefix is that of a shorter prefix and one token more. That token is a suffix
    of the prefix, and stays beside the shorter prefix's last token if the two are merged alone;
    exactly one token does. So a node needs its ancestors' last tokens only, a shared prefix
    is worked out once, and a word's encoding is read backwards along its path.
    """

    def __init__(self, vocabulary: Vocabulary, apart: dict[int, bool] | None = None):
        self.vocabulary = vocabulary
        self.child: dict[int, int] = {}
        self.last: list[int] = [-1]
        self.apart = {} if apart is None else apart  # pairs of tokens, which no trie changes
        self.alone: dict[int, bool] = {}

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens, each its own encoding, stay as they are beside each other.

        Seen backwards in time, each side of the border was its token, then that token's part at
        the border, down to bytes. Two parts that stood there together merge if their
        rank comes before the merge that took either away; at equal ranks the leftmost goes first.
        """
        key = left << 32 | right
        known = self.apart.get(key)
        if known is not None:
            return known
        merges, parts, never = self.vocabulary.merges, self.vocabulary.parts, len(self.vocabulary.merges)
        a, b, a_until, b_until, known = left, right, never, never, True
        while True:
            merge = merges.get((a, b))
            if merge is not None and merge[0] < a_until and merge[0] <= b_until:
                known = False
                break
            a_made, b_made = parts.get(a), parts.get(b)
            if b_made is not None and (a_made is None or b_made[2] >= a_made[2]):
                b, b_until = b_made[0], b_made[2]
            elif a_made is not None:
                a, a_until = a_made[1], a_made[2]
            else:
                break
        if len(self.apart) >= MAX_PAIRS:
            self.apart.clear()
        self.apart[key] = known
        return known

    def _fits(self, start: int, token: int, lasts: list[int]) -> bool:
        return self._stay_apart(lasts[start - 1], token) if start else self._stands(token)

    def _last_token(self, word: bytes, end: int, lasts: list[int]) -> int:
        """The one suffix that fits, short ones tried first."""
        ids = self.vocabulary.ids
        for start in range(end - 1, max(0, end - self.vocabulary.longest) - 1, -1):
            token = ids.get(word[start:end])
            if token is not None and self._fits(start, token, lasts):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _stands(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes: its parts are, and make nothing else."""
        known = self.alone.get(token)
        if known is None:
            held = self.vocabulary
            known = self.alone[token] = held.plain(held.bytes[token]) == [token]
        return known

    def encode(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Encodings of ``words``, inserted in order of their bytes: a depth-first walk of the trie."""
        child, last, size, known, apart = self.child, self.last, self.vocabulary.sizes, self.vocabulary.ids, self.apart
        before, nodes, lasts = b"", [0], []
        for word in sorted(words):
            common = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                common += 1
            del nodes[common + 1 :], lasts[common:]
            before, node = word, nodes[-1]
            for end in range(common + 1, len(word) + 1):
                edge = node << 8 | word[end - 1]
                node = child.get(edge)
                if node is None:
                    node = child[edge] = len(last)
                    # Mostly the last token before, with the new byte.
                    start = end - 1 - size[lasts[-1]] if lasts else 0
                    token = known.get(word[start:end])
                    if token is None or not (start and apart.get(lasts[start - 1] << 32 | token) or self._fits(start, token, lasts)):
                        token = self._last_token(word, end, lasts)
                    last.append(token)
                nodes.append(node)
                lasts.append(last[node])
            ids, end = [], len(word)
            while end:
                ids.append(lasts[end - 1])
                end -= size[ids[-1]]
            yield word, ids[::-1]


class Encoder:
    """Token ids of whole texts; keeps the trie and the encodings of its words between texts."""

    def __init__(self, vocabulary: Vocabulary, max_nodes: int = MAX_NODES):
        self.vocabulary, self.max_nodes = vocabulary, max_nodes
        self.pattern = regex.compile(PATTERN)
        self.classes = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s")]
        self.published = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.letters = {letter: b for b, letter in enumerate(byte_letters())}
        self.alike: set[str] = set()
        self.trie = Trie(vocabulary)
        self.packed: dict[str, bytes] = {}

    def _is_alike(self, char: str) -> bool:
        """Whether both Unicode tables, of ``regex`` and of ``tokenizers``, see one class in the character."""
        joins = [len(self.published.pre_tokenize_str(before + char)) == 1 for before in "a1%"]
        letter, number, space = (bool(c.match(char)) for c in self.classes)
        return joins == [letter, number, not (letter or number or space)]

    def _pieces(self, text: str) -> list[str]:
        """The words of a text without special strings.

        The two libraries know different versions of Unicode. Where a text has a character they
        class differently, the tokenizer's own, slower cut decides.
        """
        strange = set(text) - self.alike
        if strange:
            same = {c for c in strange if self._is_alike(c)}
            self.alike |= same
            if same != strange:
                cut = self.published.pre_tokenize_str(text)
                return [bytes(self.letters[c] for c in word).decode() for word, _ in cut]
        return self.pattern.findall(text)

    def _parts(self, text: str) -> Iterator[str | int]:
        """Special strings as their ids, other text in parts of bounded size where it has words to cut between."""
        held = [text] if self.vocabulary.special is None else self.vocabulary.special.split(text)
        for part in held:
            special = self.vocabulary.specials.get(part)
            if special is not None:
                yield special
                continue
            at = 0
            while len(part) - at > PART:
                found = BORDER.search(part, at + PART)
                if found is None:
                    break
                yield part[at : found.start()]
                at = found.start()
            yield part[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; the new words of some ``PART`` characters enter the trie together."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            if len(self.trie.last) > self.max_nodes:
                self.trie = Trie(self.vocabulary, self.trie.apart)
            if len(self.packed) > MAX_WORDS:
                self.packed = {}
            packed = self.packed
            new = set().union(*(words for _, words in waiting)).difference(packed)
            for word, ids in self.trie.encode([w.encode() for w in new]):
                packed[word.decode()] = array("i", ids).tobytes()
            for at, words in waiting:
                out[at].append(b"".join(map(packed.__getitem__, words)))
            waiting.clear()

        for at, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, int):
                    flush()
                    out[at].append(array("i", [part]).tobytes())
                    continue
                waiting.append((at, self._pieces(part)))
                held += len(part)
                if held > PART:
                    flush()
                    held = 0
        flush()
        return [b"".join(parts) for parts in out]


class Decoder:
    """Texts of token ids, special ones included; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        known = vocabulary.bytes
        self.table = pa.array([known.get(i) for i in range(max(known) + 1)], pa.binary())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """One string per list, none where the list is null. The tokens' bytes lie in order, so only ends are looked up."""
        tokens = self.table.take(ids.flatten())
        if tokens.null_count:
            raise ValueError("an id is not in the vocabulary")
        lengths = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], np.int64)
        ends = np.cumsum([0, *lengths])
        starts = np.frombuffer(tokens.buffers()[1], "<i4")[tokens.offset :][ends]
        bitmap = None if not ids.null_count else pa.array(ids.is_valid()).buffers()[1]
        whole = pa.Array.from_buffers(pa.binary(), len(ids), [bitmap, pa.py_buffer(starts.tobytes()), tokens.buffers()[2]])
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([None if b is None else b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())


_MADE: dict[tuple, Encoder | Decoder] = {}


def _made(kind: type, content: bytes) -> Encoder | Decoder:
    """One encoder or decoder per Python worker and vocabulary."""
    name = (kind, hashlib.sha1(content).hexdigest())
    if name not in _MADE:
        _MADE[name] = kind(Vocabulary(content))
    return _MADE[name]


def _sent(docs: DataFrame, vocabulary: str):
    """The vocabulary file, read by the driver and sent along: a fixed size, whatever the documents are."""
    with open(vocabulary, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row of ``docs(doc_id, text, ...)``, in one pass without a shuffle.

    ``vocabulary`` is the path of a ``tokenizers`` file with byte-level BPE; no special tokens are added,
    special strings inside a text are their ids, as that library has it by default. Null text counts
    as empty, has no ids and an empty array. Rows without doc_id and repeated rows stay rows, other
    columns are not read. No rows, no result rows. A worker holds some
    ``MAX_NODES`` prefixes, ``MAX_WORDS`` words and one batch of texts.
    """
    sent = _sent(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _made(Encoder, sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                packed = own.encode([t or "" for t in batch.column(1).to_pylist()])
                counts = np.array([len(p) // 4 for p in packed], np.int64)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), ids], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, text)``: the texts of ``encode``'s rows, special tokens kept; null ids give no text."""
    sent = _sent(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _made(Decoder, sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = own.decode(batch.column(2))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["doc_id", "n_tokens", "ids", "text"])

    kinds = "doc_id long, n_tokens long, ids array<int>, text string"
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, kinds)


def digests(decoded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ``decode``'s rows."""
    listed = F.btrim(F.to_json("ids"), F.lit("[]"))  # far cheaper than a cast of every id
    return decoded.select(
        "doc_id", "n_tokens", F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
