"""Near duplicates by 64-bit SimHash, compared exactly, tile against tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.forest import Forest
from riskloom.session import materialize

SEED = 42
CELLS = 1 << 21  # comparisons held in memory at once


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles of ``text``, as a signed 64-bit number.

    A-Z are lower-cased; words are what ASCII white space separates. Repeated shingles count
    again. Fewer words than ``width`` make one shingle; no word, or null, gives zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        cuts = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in cuts]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row; whole texts, null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _tile_links(left: pd.DataFrame, right: pd.DataFrame | None, radius: int) -> pd.DataFrame:
    """Spanning forest of the links within ``left``, or between ``left`` and ``right``.

    Both are sorted by the population count of their low halves. That count too differs by at
    most the radius between linked fingerprints, so each run of rows meets one range only.
    """

    def ordered(frame):
        marks = frame["fp"].to_numpy(np.int64).view(np.uint64)
        low = np.bitwise_count(marks & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(low, kind="stable")
        return marks[order], low[order], frame["node"].to_numpy(np.int64)[order]

    marks, low, nodes = ordered(left)
    others, other_low, other_nodes = (marks, low, nodes) if right is None else ordered(right)
    shift = 0 if right is None else len(marks)
    forest = Forest(shift + len(others))
    at = 0
    while at < len(marks):
        first = np.searchsorted(other_low, low[at] - radius, "left")
        end = min(len(marks), at + max(1, CELLS // max(1, len(others))))
        end = min(end, int(np.searchsorted(low, low[at], "right")))
        last = np.searchsorted(other_low, low[at] + radius, "right")
        near = np.bitwise_count(marks[at:end, None] ^ others[None, first:last]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            forest.link(i + at, j + first + shift)
        at = end
    every = nodes if right is None else np.concatenate([nodes, other_nodes])
    node, root = forest.edges()
    return pd.DataFrame({"u": every[node], "v": every[root]})


def mark_links(marks: DataFrame, radius: int = 4, tile_rows: int = 32768) -> DataFrame:
    """Links ``(u, v)`` between the nodes of ``marks(node, fp)``, a spanning forest per tile pair.

    ``fp`` must be distinct. Rows are cut into tiles of one population count and about
    ``tile_rows`` rows. Counts of linked fingerprints differ by at most ``radius``, so a tile
    is paired only with tiles of such counts; every remaining pair is compared bit by bit.
    The driver sees 65 counts, never fingerprints. Work is quadratic in the number of
    distinct fingerprints, as the exact method is; a row is copied once per paired tile.
    """
    marks = marks.withColumn("ones", F.bit_count("fp"))
    counts = dict(marks.groupBy("ones").count().collect())
    first, total = [], 0
    for ones in range(66):
        first.append(total)
        total += -(-counts.get(ones, 0) // tile_rows)
    starts = F.array(*map(F.lit, first))
    tile = F.get(starts, F.col("ones")) + F.pmod(
        F.hash("fp"), F.greatest(F.lit(1), F.get(starts, F.col("ones") + 1) - F.get(starts, F.col("ones")))
    )
    lowest = F.get(starts, F.greatest(F.col("ones") - radius, F.lit(0)))
    highest = F.get(starts, F.least(F.col("ones") + radius + 1, F.lit(65))) - 1
    paired = (
        marks.withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(lowest, highest)))
        .select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"),
                (F.col("tile") > F.col("other")).alias("second"), "node", "fp")
    )

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] == key[1]:
            return _tile_links(frame, None, radius)
        second = frame["second"].to_numpy(bool)
        return _tile_links(frame[~second], frame[second], radius)

    return paired.groupBy("a", "b").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, tile_rows: int = 32768) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is
    the smallest doc_id reachable. Equal fingerprints are combined first, so exact copies,
    however many, are one node. Null text counts as empty and links with other empty texts.
    A row without doc_id gets its fingerprint and a null component: it cannot be named, so it
    links nothing. Repeated rows are returned as often as they occur. No rows, no result rows.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    marks = materialize(
        prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "marks"
    )
    found = components(mark_links(marks, radius, tile_rows))
    named = materialize(
        marks.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")),
        "named-marks",
    )
    return prints.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
