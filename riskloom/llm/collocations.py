"""Frequent phrases whose words attract each other, counted level by level in quotient filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.functions.attach import attach
from riskloom.llm.quotient import Packing, QuotientFilter, cut_in_shards, merge, sort_count
from riskloom.session import materialize

NO_LANGUAGE = "und"
LONGEST = 5
CHUNK_WORDS = 1 << 18  # words a task holds as numbers at once
SHARD_GRAMS = 1 << 20  # words or n-grams of a shard on average, at most, before equal ones are combined
TOP_SALTS = 64
# A-Z become small, the marks that end a piece become line feeds, tabs become spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
WORDS = "lang string, word string, f long, shard long, rank long, chunk long, spots binary, ranks binary"
CHUNKS = "chunk long, seq binary, n_words long, owners binary, words binary, counts binary, langs array<string>, sizes array<long>"


def _pack(values: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes as the largest needs, compressed."""
    most = int(values.max()) if len(values) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + zstandard.compress(values.astype(f"<u{size}").tobytes(), 1)


def _unpack(content: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(content[1:]), f"<u{content[0]}").astype(np.int64)


class _Numbers(dict):
    """Numbers of the words of one language within a chunk, given at the first meeting."""

    def __init__(self, lang: int, owners: list[int], words: list[bytes]):
        super().__init__({b"": -1, b"\n": 0})
        self.lang, self.owners, self.words = lang, owners, words

    def __missing__(self, word: bytes) -> int:
        self.owners.append(self.lang)
        self.words.append(word)
        self[word] = len(self.words)
        return self[word]


class _Chunk:
    """Texts as numbers: 0 ends a piece, word number n is ``words[n - 1]`` of language ``owners[n - 1]``."""

    def __init__(self):
        self.owners: list[int] = []
        self.words: list[bytes] = []
        self.known: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: str, text: str) -> None:
        tokens = text.encode().translate(FOLD).replace(b"\n", b" \n ").split(b" ")
        if lang not in self.known:
            self.known[lang] = _Numbers(len(self.known), self.owners, self.words)
        found = np.fromiter(map(self.known[lang].__getitem__, tokens), np.int64, len(tokens))
        found = found[found >= 0]
        self.parts += [found, np.zeros(1, np.int64)]
        self.held += len(found)

    def row(self, number: int) -> dict:
        seq = np.concatenate(self.parts)
        counts = np.bincount(seq, minlength=len(self.words) + 1)[1:]
        owners = np.array(self.owners, np.int64)
        sizes = [int(counts[owners == at].sum()) for at in range(len(self.known))]
        return {"chunk": number, "seq": _pack(seq), "n_words": len(counts), "owners": _pack(owners),
                "words": zstandard.compress(b"\n".join(self.words), 1), "counts": _pack(counts), "langs": list(self.known), "sizes": sizes}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    fields = [pa.field(*[f(v) for f, v in zip((str, kinds.get), part.split(" "), strict=True)]) for part in schema.split(", ")]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def numbered_chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows of ``docs(text, lang)`` as chunks of word numbers with their own word lists, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for lang, text in zip(*batch.columns, strict=True):
                chunk.add(lang.as_py(), text.as_py())
                if chunk.held >= chunk_words:
                    yield _batch([chunk.row((task << 32) + made)], CHUNKS)
                    chunk, made = _Chunk(), made + 1
        if chunk.parts:
            yield _batch([chunk.row((task << 32) + made)], CHUNKS)

    given = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(given.mapInArrow(run, CHUNKS), "chunks")


def _shard_bits(amount: int | None, per_shard: int, most: int = 32) -> int:
    return min(most, max(0, ((amount or 0) // per_shard).bit_length()))


def count_words(chunks: DataFrame, least: int, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """Words met ``least`` times or more: ``(lang, word, f, shard, rank)``, and ``(chunk, spots, shard, ranks)``.

    Each chunk sends its words by shards of their hash; a shard's words are counted in one group. A word comes
    once per chunk, so shards are alike however common it is. The second kind of row, with ``word`` null, tells a
    chunk which of its words were frequent; a frequent word is named by its shard and its rank there.
    """
    bits = _shard_bits(chunks.agg(F.sum("n_words")).first()[0], shard_grams)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = zstandard.decompress(row["words"]).split(b"\n") if row["n_words"] else []
                counts, owners = _unpack(row["counts"]), _unpack(row["owners"])
                first = [zlib.crc32(lang.encode()) for lang in row["langs"]]
                hashed = (zlib.crc32(w, first[o]) for w, o in zip(words, owners.tolist(), strict=True))
                shards = np.fromiter(hashed, np.int64, len(words)) & ((1 << bits) - 1)
                order = np.lexsort((owners, shards))
                place = shards[order] * len(first) + owners[order]
                starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(order) else []
                made = []
                for a, b in zip(starts, [*starts[1:], len(order)] if len(order) else [], strict=True):
                    spots = np.array(sorted(order[a:b].tolist(), key=words.__getitem__))  # alike words side by side
                    made.append({
                        "shard": int(shards[spots[0]]), "chunk": row["chunk"], "lang": row["langs"][owners[spots[0]]],
                        "spots": _pack(spots), "counts": _pack(counts[spots]),
                        "words": zstandard.compress(b"\n".join([words[i] for i in spots.tolist()]), 1)})
                yield _batch(made, "shard long, chunk long, lang string, spots binary, words binary, counts binary")

    def combine(table: pa.Table) -> pa.Table:
        shard, rows = table.column("shard")[0].as_py(), table.select(["chunk", "lang", "spots", "words", "counts"]).to_pylist()
        known: dict[tuple[str, bytes], int] = {}
        numbers, counts = [], []
        for row in rows:
            lang, words = row["lang"], zstandard.decompress(row["words"]).split(b"\n")
            numbers.append(np.fromiter((known.setdefault((lang, w), len(known)) for w in words), np.int64, len(words)))
            counts.append(_unpack(row["counts"]))
        totals = np.zeros(len(known), np.int64)
        np.add.at(totals, np.concatenate(numbers), np.concatenate(counts))
        # Ranks by language and word, so that a repeated task names the words alike.
        found = sorted(key for key, number in known.items() if totals[number] >= least)
        rank = np.full(len(known), -1, np.int64)
        rank[[known[key] for key in found]] = np.arange(len(found))
        out = [{"lang": lang, "word": word.decode(), "f": int(totals[known[lang, word]]), "shard": shard, "rank": at}
               for at, (lang, word) in enumerate(found)]
        for row, number in zip(rows, numbers, strict=True):
            ranks = rank[number]
            spots = _unpack(row["spots"])[ranks >= 0]
            if len(spots):
                out.append({"chunk": row["chunk"], "shard": shard, "spots": _pack(spots), "ranks": _pack(ranks[ranks >= 0])})
        return pa.Table.from_batches([_batch(out, WORDS)])

    sent = chunks.select("chunk", "n_words", "owners", "words", "counts", "langs").mapInArrow(
        emit, "shard long, chunk long, lang string, spots binary, words binary, counts binary")
    return materialize(sent.groupBy("shard").applyInArrow(combine, WORDS), "words")


def vocabulary(counted: DataFrame) -> tuple[DataFrame, int]:
    """``(lang, word, f, id)`` of the frequent words, and the bits of an id: those of the shard and of the longest rank.

    Ids begin at 1, as 0 ends a piece.
    """
    most = counted.agg(F.max("rank")).first()[0]
    rank_bits = int((most or 0) + 1).bit_length()
    word_id = F.shiftleft("shard", rank_bits) + F.col("rank") + 1
    return counted.where("word is not null").select("lang", "word", "f", word_id.alias("id")), rank_bits


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _stretches(seq: np.ndarray, good: np.ndarray, more: int, least: int) -> np.ndarray:
    """The stretches of ``good`` places, ``more`` symbols longer and of ``least`` symbols at least, each ended by a zero."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2] + more
    long = sizes >= least
    starts, sizes = starts[long], sizes[long]
    out = np.append(seq, 0)[_ranges(starts, sizes + 1)]
    out[np.cumsum(sizes + 1) - 1] = 0
    return out


def _windows(seq: np.ndarray, length: int) -> np.ndarray:
    """Places from which ``length`` symbols come before the next zero."""
    if len(seq) < length:
        return np.zeros(0, np.int64)
    zeros = np.cumsum(np.append(0, seq == 0))
    return np.flatnonzero(zeros[length:] == zeros[:-length])


def _grams(seq: np.ndarray, packing: Packing) -> tuple[np.ndarray, tuple]:
    places = _windows(seq, packing.length)
    if not len(places):
        return places, sort_count(np.zeros((0, packing.lanes), np.uint64))
    words = np.lib.stride_tricks.sliding_window_view(seq, packing.length)[places]
    return places, sort_count(packing.keys(words))


def _from_words(chunks: DataFrame, counted: DataFrame, rank_bits: int) -> DataFrame:
    """``(chunk, seq, n)``: stretches of two frequent words and more, as ids, a zero after each.

    A chunk gets the ids of its own words only, so no task holds the whole vocabulary.
    """
    ids = counted.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("shard", "spots", "ranks")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, seq, n_words, held in zip(*batch.columns, strict=True):
                known = np.zeros(n_words.as_py() + 1, np.int64)
                for row in held.as_py():
                    known[_unpack(row["spots"]) + 1] = (row["shard"] << rank_bits) + _unpack(row["ranks"]) + 1
                words = known[_unpack(seq.as_py())]
                yield _state(chunk, _stretches(words, words > 0, 0, 2))

    given = chunks.select("chunk", "seq", "n_words").join(ids, "chunk")
    return given.select("chunk", "seq", "n_words", "held").mapInArrow(run, "chunk long, seq binary, n long")


def _state(chunk: pa.Scalar, seq: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([chunk.as_py()], pa.int64()), pa.array([_pack(seq)], pa.binary()),
               pa.array([len(seq)], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "seq", "n"])


def _count_level(state: DataFrame, packing: Packing, shard_bits: int, least: int) -> DataFrame:
    """``(chunk, shard, marks, words, f)``: the frequent n-grams, and for each chunk's filter which keys are.

    Each chunk sends a filter per shard; a shard's filters are merged in one group. The permutation
    spreads keys evenly, and a key comes once per chunk, so shards are alike however common an n-gram is.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, seq in zip(*batch.columns, strict=True):
                _, (keys, counts, _) = _grams(_unpack(seq.as_py()), packing)
                filters = cut_in_shards(packing, keys, counts, shard_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f.shard for f in filters], pa.int64()),
                     pa.array([chunk.as_py()] * len(filters), pa.int64()),
                     pa.array([f.to_bytes() for f in filters], pa.binary())], ["shard", "chunk", "body"])

    def combine(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        filters = [QuotientFilter.from_bytes(packing, shard, shard_bits, b.as_py()) for b in table.column("body")]
        merged, numbers = merge(filters)
        enough = merged.counts >= least
        marks = [np.packbits(enough[n]).tobytes() if enough[n].any() else None for n in numbers]
        words = packing.words(merged.keys[enough]).astype(np.int64)
        n = len(words)
        listed = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * packing.length, words.reshape(-1))
        kept = [(c, m) for c, m in zip(chunks, marks, strict=True) if m is not None]
        none = [None] * n
        return pa.table({
            "chunk": pa.array([c for c, _ in kept] + none, pa.int64()),
            "shard": pa.array([shard] * (len(kept) + n), pa.int64()),
            "marks": pa.array([m for _, m in kept] + none, pa.binary()),
            "words": pa.concat_arrays([pa.nulls(len(kept), pa.list_(pa.int64())), listed]),
            "f": pa.concat_arrays([pa.nulls(len(kept), pa.int64()), pa.array(merged.counts[enough], pa.int64())]),
        })

    sent = state.select("chunk", "seq").mapInArrow(emit, "shard long, chunk long, body binary")
    return sent.groupBy("shard").applyInArrow(
        combine, "chunk long, shard long, marks binary, words array<long>, f long")


def _next_state(state: DataFrame, level: DataFrame, packing: Packing, shard_bits: int) -> DataFrame:
    """Stretches in which every n-gram is frequent, with room for an n-gram one word longer."""
    marks = level.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("shard", "marks")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body, held in zip(*batch.columns, strict=True):
                seq = _unpack(body.as_py())
                places, (keys, _, number) = _grams(seq, packing)
                enough, shards = np.zeros(len(keys), bool), packing.shard(keys, shard_bits)
                for row in held.as_py():
                    a, b = np.searchsorted(shards, [row["shard"], row["shard"] + 1])
                    enough[a:b] = np.unpackbits(np.frombuffer(row["marks"], np.uint8), count=b - a).astype(bool)
                good = np.zeros(len(seq), bool)
                good[places[enough[number]]] = True
                yield _state(chunk, _stretches(seq, good, packing.length - 1, packing.length + 1))

    given = state.join(marks, "chunk").select("chunk", "seq", "held")
    return given.mapInArrow(run, "chunk long, seq binary, n long")


def frequent_phrases(chunks: DataFrame, counted: DataFrame, least: int, longest: int = LONGEST,
                     shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """``(words, f)``: every n-gram of 1 to ``longest`` word ids that occurs ``least`` times or more, with its exact count.

    An n-gram can only be frequent if both n-grams one word shorter in it are; so each level counts only
    the windows of stretches that the level before left.
    """
    known, rank_bits = vocabulary(counted)
    bits = int(known.agg(F.max("id")).first()[0] or 1).bit_length()
    found = known.select(F.array("id").alias("words"), "f")
    state = materialize(_from_words(chunks, counted, rank_bits), "stretches")
    for length in range(2, longest + 1):
        packing = Packing(length, bits)
        shard_bits = _shard_bits(state.agg(F.sum("n")).first()[0], shard_grams, packing.width)
        level = materialize(_count_level(state, packing, shard_bits, least), "level")
        found = found.unionByName(level.where("words is not null").select("words", "f"))
        if length < longest:
            state = materialize(_next_state(state, level, packing, shard_bits), "stretches")
    return found


def _parts(words: str, least: int) -> Column:
    """All contiguous parts of ``least`` words or more, without the whole."""
    size = F.size(words)
    starts = F.sequence(F.lit(1), size)
    by_start = F.transform(
        starts,
        lambda s: F.transform(
            F.filter(F.sequence(F.lit(least), F.greatest(F.lit(least), size - s + 1)), lambda n: (n <= size - s + 1) & (n < size)),
            lambda n: F.slice(F.col(words), s, n)))
    return F.flatten(by_start)


def _within(whole: Column, least: Column) -> Column:
    return whole.cast("decimal(38,0)") >= least.cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST, covered: int = 100,
                 chunk_words: int = CHUNK_WORDS, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    ``docs(text, lang, ...)``: A-Z are lower-cased; ``.,;:!?`` and the line breaks 0A to 0D end a piece, spaces and tabs a
    word. A phrase has 2 to ``longest`` words of one piece and occurs ``a >= least`` times in its language. Cut in two, its
    parts occur l and r times; ``score`` is the least of floor(1000 a n / (l r)) over all cuts, n being
    the words of the language, ties to the first cut. Phrases inside a longer one that occurs
    at least ``covered`` percent as often are left out. Numbers are exact: products are decimals of 38 digits. Order: score, a (both falling), phrase by its bytes.
    Null text counts as empty, null lang as ``und``; repeated rows count again; no other column is read.
    No rows, or no phrase that is frequent enough, give no rows.
    """
    chunks = numbered_chunks(docs, chunk_words)
    words = count_words(chunks, least, shard_grams)
    known, _ = vocabulary(words)
    counted = materialize(frequent_phrases(chunks, words, least, longest, shard_grams), "phrases")
    sizes = chunks.select(F.inline(F.arrays_zip("langs", "sizes"))).groupBy(F.col("langs").alias("lang")).agg(F.sum("sizes").alias("n"))

    several = counted.where(F.size("words") > 1)
    longer = several.where(F.size("words") > 2).select("f", F.explode(_parts("words", 2)).alias("words"))
    most = longer.groupBy("words").agg(F.max("f").alias("most"))
    open_ = several.join(most, "words", "left").where(
        F.col("most").isNull() | ~_within(F.lit(100) * F.col("most"), F.lit(covered) * F.col("f"))
    ).select("words", F.col("f").alias("a"))

    spelt = open_.select("words", F.posexplode("words").alias("at", "id")).join(known.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("words").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    named = attach(open_.join(spelt, "words"), sizes, ["lang"], spread_on="phrase")

    cuts = named.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("cut")))
    cuts = cuts.withColumn("right", F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")))
    cuts = cuts.join(counted.select(F.col("words").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counted.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("(cast(1000 * cast(a as decimal(18,0)) as decimal(21,0)) * cast(n as decimal(17,0))) "
                   "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least_cut = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(least_cut.alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    # Two steps, so that the phrases of one language are not sorted in one task.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
    ranked = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
