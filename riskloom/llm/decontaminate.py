"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tables import free_name

PIECE = 1 << 19  # code points searched at once
FILTER_BITS = 22
HITS = "array<struct<item_id:bigint,edits:int,start:int,end:int>>"
_WORD = np.zeros(0x110000, bool)


def _word_table() -> np.ndarray:
    """True for code points that are letters or digits; built once per worker."""
    if not _WORD[ord("a")]:
        _WORD[:] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _WORD


def normal_form(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits, one space for all between; and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is two
        low = "".join(c if len(d := c.lower()) != 1 else d for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _word_table()[codes]
    before = np.zeros(len(codes), bool)
    before[1:] = word[:-1]
    place = np.nonzero(word | before)[0]
    codes = np.where(word[place], codes[place], np.uint32(32))
    if len(codes) and codes[-1] == 32:
        codes, place = codes[:-1], place[:-1]
    return codes, place


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q-gram, by doubling: a gram's hash is made of two shorter ones."""
    base, total, size, power = codes.astype(np.uint64) + np.uint64(1), None, 0, 1
    while q:
        if q & 1:
            n = len(codes) - size - power + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            part = base[size : size + n]
            total = part.copy() if total is None else _joined(total[:n], part)
            size += power
        q >>= 1
        if q:
            n = len(base) - power
            if n <= 0:
                return np.zeros(0, np.uint64)
            base, power = _joined(base[:n], base[power : power + n]), 2 * power
    return total


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + right
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def aligned(item: np.ndarray, window: np.ndarray, low: int, high: int, budget: int, anchored: bool = False):
    """Fewest edits between ``item`` and a substring of ``window``, within diagonals ``low..high``.

    Returns the edits and where the substring ends, or None above the budget. A cell is addressed by
    its diagonal, so a row of the table is the band. ``anchored`` makes the substring begin at 0.
    """
    diagonals = np.arange(low, high + 1)
    steps = np.arange(len(diagonals))
    far = len(item) + len(window) + 1
    padded = np.full(len(window) + 1, 0xFFFFFFFF, np.uint32)
    padded[:-1] = window
    row = np.where((diagonals >= 0) & (diagonals <= len(window)), np.maximum(diagonals, 0) if anchored else 0, far)
    for i, code in enumerate(item, 1):
        end = diagonals + i  # window positions consumed
        inside = (end >= 0) & (end <= len(window))
        here = padded[np.where((end >= 1) & inside, end - 1, len(window))] != code
        best = row + here
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.where(inside, best, far)
        row = np.minimum.accumulate(best - steps) + steps
        row = np.where(inside, row, far)
        if row.min() > budget:
            return None
    at = int(row.argmin())
    return int(row[at]), int(diagonals[at] + len(item))


@dataclass(frozen=True)
class Items:
    """Normal forms of benchmark items that share one gram length, and the index of their q-grams."""

    ids: list
    codes: list[np.ndarray]
    budget: np.ndarray
    needed: np.ndarray  # q-grams a band must share
    q: int
    grams: np.ndarray  # distinct hashes, ascending
    first: np.ndarray  # where a hash's occurrences begin
    item: np.ndarray  # item of each occurrence
    at: np.ndarray  # position of each occurrence
    filter: np.ndarray
    width: int

    @classmethod
    def build(cls, ids: list, codes: list[np.ndarray], q: int, rate: float) -> Items:
        """An item of m code points may differ by ``rate * m`` edits.

        A match with e edits keeps at least m + 1 - q - q * e of its q-grams, so ``q`` must be at most
        m // (1 + e) for every item.
        """
        sizes = np.array([len(c) for c in codes], np.int64)
        budget = _budget(sizes, rate)
        hashes = [gram_hashes(c, q) for c in codes]
        every = np.concatenate(hashes)
        item = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
        at = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        width = 1 << int(max(4, np.ceil(np.log2(budget.max() + 1))))
        return cls(ids, codes, budget, sizes + 1 - q - q * budget, q, grams, np.append(first, len(every)),
                   item[order], at[order], seen, width)

    def reach(self) -> int:
        """Code points by which pieces of a long text overlap."""
        return max(len(c) + int(b) for c, b in zip(self.codes, self.budget, strict=True)) + 2 * self.width

    def bands(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, item and band of every region that shares enough q-grams.

        ``codes`` holds several texts, text ``t`` from ``starts[t]``; q-grams across two texts are
        dropped. Bands are ``width`` diagonals and the item's budget more, so every match has a
        band that holds all of its diagonals.
        """
        hashes = gram_hashes(codes, self.q)
        place = np.nonzero(self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])[0]
        if not len(place):
            return
        found = np.minimum(np.searchsorted(self.grams, hashes[place]), len(self.grams) - 1)
        equal = self.grams[found] == hashes[place]
        place, found = place[equal], found[equal]
        text = np.searchsorted(starts, place, "right") - 1
        whole = place + self.q <= np.append(starts[1:], len(codes))[text]
        place, found, text = place[whole], found[whole], text[whole]
        counts = self.first[found + 1] - self.first[found]
        total = int(counts.sum())
        if not total:
            return
        slot = np.repeat(self.first[found] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        item, text = self.item[slot], np.repeat(text, counts)
        longest = 1 + max(len(c) for c in self.codes)
        diagonal = np.repeat(place, counts) - self.at[slot] - starts[text] + longest
        band = diagonal // self.width
        shared = diagonal % self.width <= self.budget[item]
        bands = (len(codes) + 2 * longest) // self.width + 2
        key = (text * len(self.codes) + item) * bands
        key = np.concatenate([key + band, key[shared] + np.maximum(band[shared] - 1, 0)])
        keys, hits = np.unique(key, return_counts=True)
        owner = keys // bands
        enough = hits >= self.needed[owner % len(self.codes)]
        for k in keys[enough].tolist():
            owner, band = divmod(k, bands)
            text, item = divmod(owner, len(self.codes))
            yield text, item, band * self.width - longest

    def places(self, codes: np.ndarray, item: int, low: int) -> list[tuple[int, int, int]]:
        """Edits, start and end of matches of ``item`` in the band that begins at ``low``.

        The best match first; what lies left and right of it is searched again, so every match of the
        band is found or overlaps one that is.
        """
        own, budget = self.codes[item], int(self.budget[item])
        todo = [(max(0, low - budget), min(len(codes), low + self.width + 2 * budget + len(own)))]
        found = []
        while todo:
            left, right = todo.pop()
            if right - left < len(own) - budget:
                continue
            best = self._best(codes[left:right], own, low - left, budget)
            if best:
                edits, start, end = best[0], left + best[1], left + best[2]
                found.append((edits, start, end))
                todo += [(left, start), (end, right)]
        return found

    def _best(self, window: np.ndarray, own: np.ndarray, low: int, budget: int) -> tuple[int, int, int] | None:
        text, sought, exact = window.tobytes(), own.tobytes(), -1
        while (exact := text.find(sought, exact + 1)) >= 0:
            if exact % 4 == 0:
                return 0, exact // 4, exact // 4 + len(own)
        if not budget:
            return None
        # Within a match the diagonal moves by the budget at most, so the band is that much wider.
        end = aligned(own, window, low - budget, low + self.width + 2 * budget, budget)
        if end is None or end[0] > budget:
            return None
        back = aligned(own[::-1], window[: end[1]][::-1], -budget, budget, budget, anchored=True)
        return end[0], end[1] - back[1], end[1]


def _budget(sizes: np.ndarray, rate: float) -> np.ndarray:
    return (sizes * rate).astype(np.int64)


@dataclass(frozen=True)
class Block:
    """A part of the benchmark: its items by gram length, most often a single one."""

    parts: list[Items]

    @classmethod
    def build(cls, rows: list[tuple], q: int, rate: float, least: int = 1) -> Block:
        """Every item gets the longest grams, up to ``q``, at which its whole budget can still be met.

        Items of fewer than ``least`` code points are left out. Short items that allow no edit are a single gram.
        """
        if not 0 <= rate < 0.5:
            raise ValueError("the rate of edits must be at least 0 and below a half")
        forms = [(i, normal_form(text or "")[0]) for i, text in rows]
        forms = [(i, c) for i, c in forms if len(c) >= max(1, least)]
        sizes = np.array([len(c) for _, c in forms], np.int64)
        grams = np.minimum(q, sizes // (1 + _budget(sizes, rate)))
        parts = []
        for length in np.unique(grams).tolist():
            chosen = [f for f, g in zip(forms, grams.tolist(), strict=True) if g == length]
            parts.append(Items.build([i for i, _ in chosen], [c for _, c in chosen], length, rate))
        return cls(parts)

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Item id, edits, start and end of every place of every item, per text.

        Places of one item that overlap are one, with the fewest edits among them.
        """
        found: list[dict] = [{} for _ in texts]
        if self.parts:
            reach = max(p.reach() for p in self.parts)
            group, held = [], 0
            for n, text in enumerate(texts):
                codes, place = normal_form(text)
                for at in range(0, max(1, len(codes)), PIECE):
                    piece = codes[at : at + PIECE + reach]
                    group.append((n, at, piece, place))
                    held += len(piece)
                    if held >= PIECE:
                        self._search(group, found)
                        group, held = [], 0
            self._search(group, found)
        return [self._rows(places) for places in found]

    def _search(self, group: list, found: list[dict]) -> None:
        if not group:
            return
        sizes = np.array([len(g[2]) for g in group])
        starts = np.cumsum(sizes) - sizes
        codes = np.concatenate([g[2] for g in group])
        for part, items in enumerate(self.parts):
            for text, item, low in items.bands(codes, starts):
                n, at, piece, place = group[text]
                for edits, start, end in items.places(piece, item, low):
                    one = (int(place[at + start]), int(place[at + end - 1]) + 1, edits)
                    found[n].setdefault((part, item), set()).add(one)

    def _rows(self, places: dict) -> list[tuple[int, int, int, int]]:
        rows = []
        for (part, item), spans in places.items():
            merged: list[list[int]] = []
            for start, end, edits in sorted(spans):
                if merged and start < merged[-1][1]:
                    merged[-1][1:] = [max(end, merged[-1][1]), min(edits, merged[-1][2])]
                else:
                    merged.append([start, end, edits])
            own = self.parts[part].ids[item]
            rows += [(own, edits, start, end) for start, end, edits in merged]
        return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_chars`` characters, each small enough to send to every task."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    if blocks == 1:
        return [rows]
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))
    return [rows.where(block == n) for n in range(blocks)]


def _searcher(sent):
    @F.pandas_udf(HITS)
    def search(texts: pd.Series) -> pd.Series:
        names = ("item_id", "edits", "start", "end")
        found = sent.value.search([t or "" for t in texts])
        return pd.Series([[dict(zip(names, r, strict=True)) for r in rows] for rows in found], index=texts.index, dtype=object)

    return search


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    column: str,
    q: int = 10,
    rate: float = 0.08,
    block_chars: int = 1 << 21,
    least: int = 3,
) -> DataFrame:
    """``docs`` with an array ``column`` of benchmark items found: item_id, edits, start, end.

    ``start`` and ``end`` are code points of the text. An item is found where its normal form (lower
    case, letters and digits, one space between words) is within ``rate`` edits per character of
    a stretch of the text's. Every such stretch overlaps a returned place; places of one item that overlap are
    returned as one, with the fewest edits. Grams are ``q`` code points long, shorter for items that could not
    meet the rate with them. Items of fewer than ``least`` code points are ignored: they stand in any text.

    Whole texts are searched, long ones in overlapping pieces. The benchmark is sent to the tasks in blocks of
    about ``block_chars`` characters. With one block nothing is shuffled. With more, each block has a pass
    of its own whose findings are written before the next is sent, and findings are joined to the documents by
    a digest of the text; memory does not grow with the number of blocks.

    Null or empty texts hold nothing, null items are ignored; an empty benchmark finds nothing. Repeated rows are
    each searched; repeated items each found. A doc_id may stand over several texts.
    """
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_chars)

    def sent(block: DataFrame):
        rows = [tuple(r) for r in block.orderBy("item_id", "text").collect()]
        return context.broadcast(Block.build(rows, q, rate, least))

    if len(blocks) == 1:
        return docs.withColumn(column, _searcher(sent(blocks[0]))(F.col("text")))
    key, hits = free_name(docs, "text_digest"), free_name(docs, "hits")
    digest = F.sha2(F.col("text"), 256)
    parts = []
    for block in blocks:
        held = sent(block)
        found = docs.select(digest.alias(key), _searcher(held)(F.col("text")).alias(hits)).where(F.size(hits) > 0)
        parts.append(materialize(found.groupBy(key).agg(F.first(hits).alias(hits)), "leaks"))
        held.unpersist()
    every = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.flatten(F.collect_list(hits)).alias(hits))
    joined = docs.withColumn(key, digest).join(every, key, "left")
    return joined.withColumn(column, F.coalesce(F.array_sort(hits), F.array().cast(HITS))).drop(key, hits)


def leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``(doc_id, item_id, edits, start, end)``, a row for each place of each item in each document."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, "leaks", **settings)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
