"""Runs of periodically repeated words, found as branching tandem repeats on an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 1 << 16  # words of the documents whose suffixes are sorted together
NONE = np.zeros(0, np.int64)
RESULT = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indexes of the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class SuffixArray:
    """Suffixes of a symbol sequence whose last symbol occurs once, by prefix doubling.

    ``levels[j]`` numbers the substrings of length ``2**j``: two places carry one number exactly if
    those substrings are equal. Suffixes already told apart are not sorted again.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - counts)[inverse]
        self.order = np.argsort(rank, kind="stable")
        self.levels = [rank]
        shared = np.repeat(counts, counts) > 1
        step = 1
        while shared.any():
            at = np.flatnonzero(shared)
            suffixes = self.order[at]
            first, second = rank[suffixes], rank[suffixes + step]
            by = np.lexsort((second, first))
            suffixes, first, second = suffixes[by], first[by], second[by]
            self.order[at] = suffixes
            new = np.ones(len(at), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(at)))
            rank = rank.copy()
            rank[suffixes] = np.repeat(at[starts], sizes)
            shared = np.zeros(n, bool)
            shared[at] = np.repeat(sizes, sizes) > 1
            self.levels.append(rank)
            step *= 2
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from the places ``a`` and ``b`` on, where the two always differ."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            rank, size = self.levels[level], 1 << level
            equal = rank[a] == rank[b]
            a[equal] += size
            b[equal] += size
        return a - start

    def common_suffix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols just before the places ``a`` and ``b``, where the two always differ."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            rank, size = self.levels[level], 1 << level
            inside = np.flatnonzero((a >= size) & (b >= size))
            equal = inside[rank[a[inside] - size] == rank[b[inside] - size]]
            a[equal] -= size
            b[equal] -= size
        return start - a


def _children(lcp: np.ndarray, least_size: int) -> tuple[np.ndarray, ...]:
    """Children of the LCP intervals of ``least_size`` suffixes or more, all but the largest of each.

    ``lcp[k]`` belongs to the neighbours k-1 and k. Returned are the depth of the interval, its first
    place and the place after its last, and those of the child. Every child lies beside
    a place k whose LCP is its interval's depth, so one sweep with a stack finds them.
    """
    n = len(lcp)
    deep = lcp > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], deep, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least_size - 1
    spots = _ranges(starts[long], (ends - starts)[long])
    # For each spot the nearest places before and after with a lower LCP.
    lower_before, lower_after = np.empty(n, np.int64), np.empty(n, np.int64)
    values = lcp.tolist()
    for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        stack: list[int] = []
        for k in range(start, end):
            value = values[k]
            while stack and values[stack[-1]] > value:
                lower_after[stack.pop()] = k
            before = stack[-1] if stack else start - 1
            lower_before[k] = lower_before[before] if stack and values[before] == value else before
            stack.append(k)
        lower_after[stack] = end
    depth = lcp[spots]
    left = lower_before[spots]
    group = np.lexsort((spots, depth, left))
    spots, depth, left = spots[group], depth[group], left[group]
    if not len(spots):
        return NONE, NONE, NONE, NONE, NONE
    head = np.ones(len(spots), bool)
    head[1:] = (depth[1:] != depth[:-1]) | (left[1:] != left[:-1])
    number = np.cumsum(head) - 1
    # Children: from each spot to the next of its interval, and one before the first spot.
    next_spot = lower_after[spots]
    next_spot[:-1] = np.where(head[1:], next_spot[:-1], spots[1:])
    child_from = np.concatenate((spots, left[head]))
    child_to = np.concatenate((next_spot, spots[head]))
    owner = np.concatenate((number, number[head]))
    begin, finish, depths = left[head], lower_after[spots[head]], depth[head]
    size = child_to - child_from
    order = np.lexsort((size, owner))
    largest = np.ones(len(order), bool)
    largest[:-1] = owner[order][1:] != owner[order][:-1]
    keep = order[~largest]
    keep = keep[(finish - begin)[owner[keep]] >= least_size]
    whose = owner[keep]
    return depths[whose], begin[whose], finish[whose], child_from[keep], child_to[keep]


def find_runs(symbols: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """``(start, length, period)`` rows of all runs in a sequence whose last symbol occurs once.

    A run is a maximal stretch with a smallest period p, of length ``max(least, exponent * p)``
    at least; ``exponent`` is 2 or more. The last square of a run is a branching tandem repeat: its
    half w, of p symbols, is followed by two different symbols, so an LCP interval has depth p, and the
    places i and i+p of the two halves lie in different children of it. Of each pair of children one is not the
    interval's largest; looking from the suffixes of these to i+p and i-p thus finds every such
    square in O(n log n) looks. Rotating the square to the left as far as the symbols agree gives the run.
    An interval with fewer suffixes than a run has repeats of w is skipped.
    """
    found = SuffixArray(symbols)
    order, place, n = found.order, found.place, len(symbols)
    first = found.levels[0]
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1
    lcp[near] = found.common_prefix(order[near - 1], order[near])
    depth, begin, finish, child_from, child_to = _children(lcp, exponent)
    counts = child_to - child_from
    suffix = order[_ranges(child_from, counts)] if len(counts) else NONE
    depth, begin, finish, child_from, child_to = (
        np.repeat(v, counts) for v in (depth, begin, finish, child_from, child_to))
    squares = []
    for other, start in ((suffix + depth, suffix), (suffix - depth, suffix - depth)):
        inside = np.flatnonzero((other >= 0) & (other < n))
        spot = place[other[inside]]
        meets = (spot >= begin[inside]) & (spot < finish[inside])
        meets &= (spot < child_from[inside]) | (spot >= child_to[inside])
        hit = inside[meets]
        squares.append(np.stack((start[hit], depth[hit]), axis=1))
    square = np.unique(np.concatenate(squares), axis=0) if squares else np.zeros((0, 2), np.int64)
    if not len(square):
        return np.zeros((0, 3), np.int64)
    last, period = square[:, 0], square[:, 1]
    start = last - found.common_suffix(last, last + period)
    length = last + 2 * period - start
    keep = length >= np.maximum(least, exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    # Squares of a multiple of the period span the same stretch; the smallest is the run's.
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(by), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return np.stack((start[new], length[new], period[new]), axis=1)


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def _symbols(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words, of no text equal to those of another, an end mark after each text."""
    out, at = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers = [known.setdefault(w, len(known)) for w in words]
        numbers.append(len(known))
        out.append(np.array(numbers, np.int64) + at)
        at += len(known) + 1
    return np.concatenate(out)


def runs_of(texts: list[list[bytes]], exponent: int = 4, least: int = 6) -> list[np.ndarray]:
    """Runs of each word list, sorted by start, then period; all suffixes are sorted in one go."""
    if not texts:
        return []
    runs = find_runs(_symbols(texts), exponent, least)
    begins = np.cumsum([0, *(len(words) + 1 for words in texts)])
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    cuts = np.searchsorted(runs[:, 0], begins)
    return [runs[a:b] - [at, 0, 0] for a, b, at in zip(cuts[:-1], cuts[1:], begins[:-1], strict=True)]


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, batch_words: int = BATCH_WORDS) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row of ``docs(doc_id, text, ...)``, whole texts, no shuffle.

    Words are what ASCII white space separates. ``runs`` are ``(start, length, period)`` by start, then
    period: stretches that repeat their first ``period`` words, ``exponent`` times and ``least`` words at
    least, and cannot be prolonged. ``collapsed`` joins by a space what remains when every run keeps its first
    period only. Null or empty text has no words, no run and an empty ``collapsed``. Rows without doc_id
    and repeated rows stay rows; other columns are not read; no rows give no rows. Texts are handled in
    groups of ``batch_words`` words, a longer one alone, its memory in proportion to its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            found, collapsed = runs_of(texts, exponent, least), []
            for words, own in zip(texts, found, strict=True):
                if len(own):
                    words = [w for w, gone in zip(words, dropped(len(words), own).tolist(), strict=True) if not gone]
                collapsed.append(b" ".join(words).decode())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            joined = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            fields = [pa.array(np.ascontiguousarray(joined[:, i])) for i in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            columns = [pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), runs,
                       pa.array(collapsed, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(*batch.columns, strict=True):
                words = (text.as_py() or "").encode().split()
                if texts and held + len(words) > batch_words:
                    yield result(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(words)
                held += len(words)
            if texts:
                yield result(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, RESULT)


def digests(found: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: number of runs, the longest one, and hashes of the rest."""
    longest = F.array_sort(
        "runs", lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"])
        .when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]).cast("int"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.get(F.when(F.size("runs") > 0, longest), F.lit(0))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")


def with_planted_periods(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs(doc_id, text)`` with one text in ten made periodic from some word on, as the digest query asks.

    By ``h``, the CRC-32 of the decimal id: texts with ``h % 10 = 0`` repeat the words from ``a`` on with
    period ``p``. Texts of other rows, without an id or without words stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    a = F.pmod(g, F.col("n"))
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod(g, F.lit(8))))
    places = F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))
    source = F.transform(
        places, lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    chosen = (h % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    planted = (
        docs.where(chosen).select(key, words.alias("w")).withColumn("n", F.size("w").cast("long"))
        .withColumn("a", a).withColumn("p", p).select(key, F.array_join(source, " ").alias("text"))
    )
    return docs.where(~F.coalesce(chosen, F.lit(False))).select(key, "text").unionByName(planted)
