"""Paragraphs that repeat across documents, exactly or nearly: MinHash banding, then exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskloom.llm.components import components
from riskloom.llm.forest import Forest
from riskloom.llm.tables import free_name
from riskloom.session import materialize

COLUMNS = 2048  # shingles compared at once
GRAMS = 1 << 14  # shingles hashed at once


def tune(similarity: float = 0.8, recall: float = 0.995, rows: int = 3) -> int:
    """Fewest bands of ``rows`` hashes in which a pair of that similarity collides with probability ``recall``."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(similarity**rows))))


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles; fewer words than ``width`` make one."""
    count = max(1, len(words) - width + 1)
    return np.unique(
        np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width])) for i in range(count)), np.uint64, count)
    )


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20).integers(1, 1 << 62, size=(2, count), dtype=np.uint64)
    return drawn[0] * np.uint64(2) + np.uint64(1), drawn[1]


def band_hashes(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the MinHash bands of many shingle sets at once, and where those of each set begin and the last ends.

    ``grams`` holds the shingles of one set after the other, ``sizes`` of each, repeats included. A set of so few
    distinct shingles that only an equal one reaches ``similarity`` has the hash of all of them as its one band.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    counts = np.bincount(owner, minlength=n)
    starts = np.cumsum(counts) - counts
    few = counts < similarity * (counts + 1) - 1e-4  # one shingle more or less is too much
    ends = np.cumsum(np.concatenate(([0], np.where(few, 1, bands))))
    out = np.zeros(ends[-1], np.uint64)

    def mixed_in(value: np.ndarray, more: np.ndarray) -> np.ndarray:
        value = (value ^ more) * np.uint64(0x9E3779B97F4A7C15)
        return value ^ (value >> np.uint64(29))

    whole = np.zeros(n, np.uint64)
    for at in range(int(counts[few].max(initial=0))):
        has = few & (counts > at)
        whole[has] = mixed_in(whole[has], grams[starts[has] + at])
    out[ends[:-1][few]] = whole[few]

    times, plus = _multipliers(bands * rows)
    large, grams = np.flatnonzero(~few), grams[np.repeat(~few, counts)]
    stops, done = np.cumsum(counts[large]), 0
    while done < len(large):
        first = stops[done] - counts[large[done]]
        upto = max(done + 1, int(np.searchsorted(stops, first + GRAMS, "right")))
        begins = stops[done:upto] - counts[large[done:upto]] - first
        smallest = np.full((upto - done, bands * rows), np.iinfo(np.uint64).max, np.uint64)
        for at in range(first, stops[upto - 1], GRAMS):  # more than once for a long set, which comes alone
            part = grams[at : min(at + GRAMS, stops[upto - 1]), None] * times + plus
            part ^= part >> np.uint64(32)
            smallest = np.minimum(smallest, np.minimum.reduceat(part, begins, axis=0))
        table = smallest.reshape(-1, bands, rows)
        value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), table.shape[:2])
        for at in range(rows):
            value = mixed_in(value, table[:, :, at])
        out[ends[large[done:upto]][:, None] + np.arange(bands)] = value
        done = upto
    return out.view(np.int64), ends


PASSAGE_WORDS = 25
NAMES = ["doc_id", "paragraph", "start", "end", "n_words", "key", "bands", "passage"]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
SCHEMA = "doc_id long, paragraph int, start int, end int, n_words int, key binary, bands array<long>, passage long"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Words:
    """Words of a text with their places, and the hash of the shingle that begins at each."""

    def __init__(self, text: str, width: int):
        data = text.encode().lower()
        codes = np.frombuffer(data, np.uint8)
        gap = np.concatenate(([True], _SPACE[codes], [True]))
        first = np.nonzero(gap[:-1] & ~gap[1:])[0]
        last = np.nonzero(~gap[:-1] & gap[1:])[0]
        place = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))  # code points before each byte
        self.starts, self.ends, self.count = place[first], place[last], len(first)
        self.line = b" ".join(data.split())
        self.stops = np.cumsum(last - first + 1) - 1
        self.heads = self.stops - (last - first)
        breaks = np.nonzero(codes == 10)[0]
        self.breaks = place[breaks]
        self.bounds = np.concatenate(([0], np.searchsorted(first, breaks), [self.count]))
        self.size = int(place[-1])
        pairs = zip(self.heads[: 1 - width].tolist(), self.stops[width - 1 :].tolist()) if self.count >= width else ()
        self.grams = np.fromiter((xxhash.xxh64_intdigest(self.line[i:j]) for i, j in pairs), np.uint64)
        self.width = width

    def paragraphs(self, least_words: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Number, start, end and word range of each line with enough words."""
        for number in np.nonzero(np.diff(self.bounds) >= least_words)[0].tolist():
            start = int(self.breaks[number - 1]) + 1 if number else 0
            end = int(self.breaks[number]) if number < len(self.breaks) else self.size
            yield number, start, end, int(self.bounds[number]), int(self.bounds[number + 1])

    def key(self, low: int, high: int) -> bytes:
        return xxhash.xxh3_128_digest(self.line[self.heads[low] : self.stops[high - 1]])

    def repeated_shingles(self, low: int, high: int) -> np.ndarray:
        if high - low < self.width:
            return np.array([xxhash.xxh64_intdigest(self.line[self.heads[low] : self.stops[high - 1]])], np.uint64)
        return self.grams[low : high - self.width + 1]

    def shingles(self, low: int, high: int) -> np.ndarray:
        return np.unique(self.repeated_shingles(low, high))

    def passages(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and keys of the passages in order, every place of a key.

        Of every ``span`` shingles in a row the one with the smallest hash begins a passage, so texts that
        share ``span`` + PASSAGE_WORDS - 1 words share one that begins in the same place.
        """
        if len(self.grams) < span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(self.grams, span)
        begin = np.unique(view.argmin(axis=1) + np.arange(len(view)))
        begin = begin[begin + PASSAGE_WORDS <= self.count]
        value = np.zeros(len(begin), np.uint64)
        for at in [*range(0, PASSAGE_WORDS - self.width, self.width), PASSAGE_WORDS - self.width]:
            value = (value ^ self.grams[begin + at]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return begin, value.view(np.int64)


def signed_paragraphs(
    docs: DataFrame, least_words: int, width: int, bands: int, rows: int, span: int, similarity: float = 0.8
) -> DataFrame:
    """Long enough lines of every text with key and bands, and its passages with ``passage`` set."""

    def lines_of(found: list, sets: list) -> pa.RecordBatch:
        values, ends = band_hashes(np.concatenate(sets), np.array([len(g) for g in sets]), bands, rows, similarity)
        *columns, own = zip(*found)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)).take(pa.array(own, pa.int64()))
        named = [pa.array(c, t) for c, t in zip(columns, KINDS)]
        return pa.RecordBatch.from_arrays([*named, lists, pa.nulls(len(own), pa.int64())], NAMES)

    def passages_of(found: list) -> pa.RecordBatch:
        doc_id, start, end, passage = (np.concatenate(c) for c in zip(*found))
        none = [pa.nulls(len(doc_id), t) for t in KINDS]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_id), none[1], pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
             pa.array(np.full(len(doc_id), PASSAGE_WORDS, np.int32)), none[5], none[6], pa.array(passage)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, passages, held, made, sets, grams = [], [], 0, {}, [], 0
            for doc_id, text in zip(*batch.columns, strict=True):
                words = _Words(text.as_py() or "", width)
                for number, start, end, low, high in words.paragraphs(least_words):
                    key = words.key(low, high)
                    if key not in made:  # common lines are hashed once among those sent together
                        made[key] = len(sets)
                        sets.append(words.repeated_shingles(low, high))
                        grams += len(sets[-1])
                    lines.append((doc_id.as_py(), number, start, end, high - low, key, made[key]))
                begin, keys = words.passages(span)
                if len(keys):
                    passages.append((np.full(len(keys), doc_id.as_py(), np.int64), words.starts[begin],
                                     words.ends[begin + PASSAGE_WORDS - 1], keys))
                    held += len(keys)
                if len(lines) >= 16384 or grams >= 1 << 20:
                    yield lines_of(lines, sets)
                    lines, made, sets, grams = [], {}, [], 0
                if held >= 65536:
                    yield passages_of(passages)
                    passages, held = [], 0
            if lines:
                yield lines_of(lines, sets)
            if passages:
                yield passages_of(passages)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def repeated_passages(passages: DataFrame, removed: DataFrame) -> DataFrame:
    """Runs of passages that other documents hold too: ``passages(doc_id, start, end, passage)``.

    Passages are first counted by key alone; only every place of those that two documents hold is brought
    together. One place of each is kept: the first that no paragraph ``removed(doc_id, start, end)`` touches,
    else the first. Passages of a document that touch and are all kept or all not become one run. What a
    passage that is not kept shares with a kept one belongs to the latter, so that no cut reaches into it.
    """
    often = materialize(
        passages.groupBy("passage").agg(
            F.count("*").alias("class_size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
        ).where("low < high").drop("low", "high"), "passage-counts")
    met = passages.join(often, "passage")
    both = met.unionByName(removed.select("doc_id", "start", "end"), allowMissingColumns=True)
    past = F.max(F.when(F.col("passage").isNull(), F.col("end"))).over(_rows_before("start", F.desc("end")))
    coming = F.min(F.when(F.col("passage").isNull(), F.col("start"))).over(_rows_before(F.desc("start"), "end"))
    lost = F.coalesce(past > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("end"), F.lit(False))
    met = materialize(both.withColumn("lost", lost).where("passage is not null"), "met-passages")
    place = F.struct("lost", "doc_id", "start")
    first = met.groupBy("passage").agg(F.min(place).alias("first"))
    placed = met.join(materialize(first, "first-passages"), "passage").select(
        "doc_id", "start", "end", "passage", "class_size", (place == F.col("first")).alias("kept"))
    after = F.max(F.when(F.col("kept"), F.col("end"))).over(_rows_before("start", "end"))
    until = F.min(F.when(F.col("kept"), F.col("start"))).over(_rows_before(F.desc("start"), F.desc("end"))) - 1  # white space
    free = placed.withColumns({"after": after, "until": until}).select(
        "doc_id", "passage", "class_size", "kept",
        F.when(F.col("kept"), F.col("start")).otherwise(F.greatest("start", "after")).alias("start"),
        F.when(F.col("kept"), F.col("end")).otherwise(F.least("end", "until")).alias("end"),
    ).where("start < end")
    before = _rows_before("start", "end")
    opens = F.coalesce((F.col("start") > F.max("end").over(before)) | (F.col("kept") != F.lag("kept").over(
        W.partitionBy("doc_id").orderBy("start", "end"))), F.lit(True)).cast("int")
    numbered = free.withColumn("opens", opens).withColumn(
        "run", F.sum("opens").over(before.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("passage").alias("passage"),
        F.max("class_size").alias("class_size"), F.every("kept").alias("kept"),
    )


def _rows_before(*order: Column | str):
    return W.partitionBy("doc_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def collisions(signed: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between keys that share a band, a chain per band value.

    Within each batch of rows a band value keeps its first key and links the others to it, before
    anything is shuffled: a line that a third of the rows share arrives once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)[1]  # equal keys need no link
            keys, lists = (c.take(pa.array(one)) for c in batch.columns)
            bands = np.asarray(lists.flatten())
            owner = np.repeat(np.arange(len(one)), np.asarray(lists.value_lengths()))
            first, inverse = np.unique(bands, return_index=True, return_inverse=True)[1:]
            head = owner[first][inverse]
            leads = np.zeros(len(bands), bool)
            leads[first] = True
            take = leads | (head != owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bands[take]), keys.take(pa.array(owner[take])), keys.take(pa.array(head[take])),
                 pa.array(leads[take])],
                ["band", "key", "head", "leads"])

    met = materialize(
        signed.select("key", "bands").mapInArrow(run, "band long, key binary, head binary, leads boolean"), "bands")
    within = met.where("not leads").select(F.col("key").alias("u"), F.col("head").alias("v"))
    last = F.lag("key").over(W.partitionBy("band").orderBy("key"))
    across = met.where("leads").select(F.col("key").alias("u"), last.alias("v"))
    return within.unionByName(across).where("u <> v")


def similar_links(sets: list[tuple[bytes, np.ndarray]], similarity: float) -> tuple[list[bytes], list[bytes]]:
    """Spanning forest of the pairs whose exact Jaccard similarity reaches ``similarity``."""
    sizes = np.array([len(s) for _, s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    gram, count = np.unique(np.concatenate([s for _, s in sets]), return_inverse=True, return_counts=True)[1:]
    shared = count[gram] > 1
    place = (np.cumsum(count > 1) - 1)[gram[shared]]
    owner, order = owner[shared], np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        low, high = np.searchsorted(place, [at, at + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[low:high], place[low:high] - at] = 1
        common += table @ table.T
    joint = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu(common >= similarity * joint - 1e-4, 1))
    forest = Forest(len(sets))
    if len(i):
        forest.link(i, j)
    node, root = forest.edges()
    return [sets[n][0] for n in node], [sets[r][0] for r in root]


def verified_links(docs: DataFrame, candidates: DataFrame, similarity: float, width: int, tile: int = 512) -> DataFrame:
    """Links between candidates whose shingles really overlap, a spanning forest per tile pair.

    ``candidates(key, group, doc_id, paragraph)`` names one occurrence of each key. Every pair of
    a group is compared, each key's shingles being sent once; groups of more than ``tile`` keys
    are cut into tiles and every pair of tiles is compared in a task of its own.
    """
    wanted = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("paragraph", "key", "group", "tiles")).alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        materialize(wanted, "wanted-paragraphs"), "doc_id"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(*batch.columns, strict=True):
                words = _Words(text.as_py() or "", width)
                found = {n: (low, high) for n, _, _, low, high in words.paragraphs(1)}
                for one in wanted.as_py():
                    low, high = found.get(one["paragraph"], (0, 0))
                    if low < high and words.key(low, high) == one["key"]:  # else another text with this id
                        rows.append((one["group"], one["tiles"], one["key"], words.shingles(low, high).tobytes()))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int32(), pa.binary(), pa.binary()])],
                ["group", "tiles", "key", "grams"])

    cells = (
        texts.select("text", "wanted").mapInArrow(cut, "group binary, tiles int, key binary, grams binary")
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("group", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "key", "grams")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        u, v = [], []
        for _, cell in groupby(rows(), key=lambda r: r[:3]):
            sets = {key: np.frombuffer(grams, np.uint64) for *_, key, grams in cell}
            if len(sets) > 1:
                left, right = similar_links(list(sets.items()), similarity)
                u += left
                v += right
            if len(u) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    # Cells arrive sorted, so a task holds one pair of tiles at a time.
    dealt = cells.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b")
    return dealt.mapInArrow(compare, "u binary, v binary")


def repeated_paragraphs(
    docs: DataFrame, least_words: int = 30, similarity: float = 0.8, width: int = 5, recall: float = 0.995,
    rows: int = 3, tile: int = 512, passage_span: int = 26,
) -> DataFrame:
    """Paragraphs and passages that repeat across documents.

    Result: ``doc_id, kind, paragraph, start, end, n_words, class_id, class_size, kept``; start and end are
    code points of the text.

    ``kind`` paragraph: a line of at least ``least_words`` words, ``paragraph`` its number from 0. Equal lines
    (A-Z lower-cased, white space aside) and those whose five-word shingles have a Jaccard similarity of
    ``similarity`` or more form classes, closed under links. One occurrence is kept, the first by
    doc_id and line; all others are for removal.

    ``kind`` passage: a run of words that stands in other documents too, wherever it lies in its lines.
    Texts are cut into 25-word passages at places their own words decide, so that any
    ``passage_span`` + 24 words (50) that two documents share contain one passage in common. Runs have
    no ``paragraph`` and no ``n_words``; ``class_id`` is the smallest passage in them. A run ends where
    kept passages begin, so every passage stands in one place after removal.

    What repeats within one document only is not returned. Whole texts are read; empty and null
    texts and short lines have no paragraphs. Rows without doc_id are left out, they can't be named.
    A repeated row is one document, so its paragraphs do not repeat by it alone. No rows, no result.
    """
    bands = tune(similarity, recall, rows)
    named = docs.where("doc_id is not null")
    cut = materialize(signed_paragraphs(named, least_words, width, bands, rows, passage_span, similarity), "paragraphs")
    signed = cut.where("passage is null").drop("passage")
    coarse = components(collisions(signed))
    sizes = coarse.groupBy("component").count()
    grouped = materialize(
        coarse.join(sizes, "component").select(
            F.col("node").alias("key"), F.col("component").alias("group"),
            F.ceil(F.col("count") / tile).cast("int").alias("tiles")),
        "groups",
    )
    places = signed.groupBy("key").agg(F.min(F.struct("doc_id", "paragraph")).alias("at")).join(grouped, "key")
    candidates = places.select("key", "group", "tiles", "at.doc_id", "at.paragraph")
    classes = components(verified_links(named, candidates, similarity, width, tile))
    classes = materialize(classes.select(F.col("node").alias("key"), "component"), "classes")
    narrow = materialize(
        signed.drop("bands").join(classes, "key", "left")
        .withColumn("class_id", F.coalesce("component", "key")).drop("key", "component"),
        "class-occurrences",
    )
    spread = narrow.groupBy("class_id").agg(
        F.count("*").alias("class_size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.min(F.struct("doc_id", "paragraph")).alias("first")
    ).where("low < high")
    lines = materialize(narrow.join(materialize(spread, "repeated-classes"), "class_id").select(
        "doc_id", F.lit("paragraph").alias("kind"), "paragraph", "start", "end", "n_words",
        F.lower(F.hex("class_id")).alias("class_id"), "class_size",
        (F.struct("doc_id", "paragraph") == F.col("first")).alias("kept"),
    ), "repeated-lines")
    passages = cut.where("passage is not null").select("doc_id", "start", "end", "passage")
    runs = repeated_passages(passages, lines.where("not kept")).select(
        "doc_id", F.lit("passage").alias("kind"), F.lit(None).cast("int").alias("paragraph"), "start", "end",
        F.lit(None).cast("int").alias("n_words"), F.lower(F.lpad(F.hex("passage"), 16, "0")).alias("class_id"),
        "class_size", "kept",
    )
    return lines.unionByName(runs)


def without_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``docs`` with everything not kept cut out of the texts, a paragraph with its line end; all columns stay."""
    name = free_name(docs, "cuts")
    until = F.when(F.col("kind") == "paragraph", F.col("end") + 1).otherwise(F.col("end"))
    cuts = repeats.where("not kept").groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", until.alias("until")))).alias(name))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def cut(left: Column, span: Column) -> Column:
        more = F.substring(F.col("text"), left["at"] + 1, F.greatest(span["start"] - left["at"], F.lit(0)))
        return F.struct(F.greatest(left["at"], span["until"]).alias("at"), F.concat(left["text"], more).alias("text"))

    rest = F.aggregate(name, empty, cut, lambda left: F.concat(
        left["text"], F.substring(F.col("text"), left["at"] + 1, F.length("text"))))
    return docs.join(cuts, "doc_id", "left").withColumn(
        "text", F.when(F.col(name).isNull(), F.col("text")).otherwise(rest)).select(docs.columns)
