"""Token sequences in a keyed random order, written as fixed-stride shards."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.tables import write_raw
from riskloom.session import materialize, shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
# Fixed value: the pre-tokenizer pattern of this vocabulary, in the form that never looks back.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NO_ID = -(1 << 63)
HEADER = np.dtype([("doc_id", "<i8"), ("part", "<u4"), ("length", "<u4")])


class Encoder:
    """Token ids of whole texts."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2") if max(ranks.values()) < 65535 else np.dtype("<u4")
        self.encode = self.encoding.encode_ordinary


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    name = hashlib.sha1(vocabulary).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary)
    return _ENCODERS[name]


class Permutation:
    """Keyed bijection of ``0..size-1``: a Feistel network on the next even power of two, and cycle-walking."""

    def __init__(self, size: int, key: str, rounds: int = 6):
        self.size = size
        self.half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        seeds = hashlib.blake2b(key.encode(), digest_size=8 * rounds).digest()
        self.keys = np.frombuffer(seeds, "<u8")

    def _mixed(self, value: np.ndarray, key: np.uint64) -> np.ndarray:
        value = (value ^ key) * np.uint64(0x9E3779B97F4A7C15)
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (value ^ (value >> np.uint64(32))) & self.mask

    def _once(self, value: np.ndarray, back: bool) -> np.ndarray:
        left, right = value >> self.half, value & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return (left << self.half) | right

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        result = self._once(np.asarray(values).astype(np.uint64), back)
        while (outside := result >= np.uint64(self.size)).any():
            result[outside] = self._once(result[outside], back)
        return result.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Scans are cut alike inside, even if executors come or go between two jobs."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def _sequences(n_tokens: int, length: int) -> int:
    """Sequences of a text of so many ids and the end mark."""
    return n_tokens // length + 1


def _count(rows: DataFrame, sent, length: int) -> dict[int, tuple[int, int]]:
    """Sequences in each task of a scan, and a checksum of its ids and lengths: one row per task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total, check = _encoder(sent.value), 0, 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                n = len(encoder.encode(text.as_py() or ""))
                total += _sequences(n, length)
                check = zlib.crc32(b"%r %d" % (doc_id.as_py(), n), check)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (TaskContext.get().partitionId(), total, check)], ["task", "n", "check"])

    return {r["task"]: (r["n"], r["check"]) for r in rows.mapInArrow(run, "task long, n long, check long").collect()}


def stride(length: int, width: int = 2) -> int:
    """Bytes of one record: header, ids, and the line end the writer puts after each."""
    return HEADER.itemsize + width * length + 1


def locate(slot: int, length: int, shard_records: int, width: int = 2) -> tuple[int, int]:
    """Shard number and byte offset of a slot."""
    return slot // shard_records, slot % shard_records * stride(length, width)


def write_shards(
    docs: DataFrame, path: str, length: int = 512, shard_records: int = 32768, key: str = "epoch-0",
    vocabulary: str = VOCABULARY, end: int = END_OF_TEXT, stored: bool = False,
) -> int:
    """Write all sequences of ``docs(doc_id, text, ...)`` in permuted order; returns their number.

    A text's ids and ``end`` are cut into sequences of ``length``, the last filled up with ``end``. A
    keyed permutation gives each sequence a slot; shard ``s`` holds the slots from ``s *
    shard_records``, in order, as the file ``part-<s>``. Slots are dense and known before the
    shuffle, so the partition of a record follows from its slot: every shard but the last has exactly
    ``shard_records`` records, however the texts or sources are spread.

    The texts are encoded twice: once to count the sequences of each task of the scan, once to write
    them, which takes less than storing the ids in between. A sequence's number is its place in
    its task after those of earlier tasks, so both scans must be cut alike. ``stored`` says that
    ``docs`` is a plain read of files; any other plan is first written to the shared folder. Each
    task checks its ids and lengths against the count and fails the job when they differ.

    Null text is empty and gives one sequence; null doc_id is written as the least long. Repeated
    rows are written as often as they occur. No rows give no shard. One row per task comes to the
    driver, which also reads the vocabulary and sends it along.
    """
    spark = docs.sparkSession
    if not stored:
        docs = materialize(docs.select("doc_id", "text"), "texts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    width = Encoder(sent.value).kind.itemsize
    with _same_splits(spark):
        counted = _count(rows, sent, length)
        total, plan = 0, {}
        for task in sorted(counted):
            plan[task] = (total, *counted[task])
            total += counted[task][0]
        if not total:
            return 0
        plans = spark.sparkContext.broadcast(plan)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, order = _encoder(sent.value), Permutation(total, key)
            first, expected, expected_check = plans.value[TaskContext.get().partitionId()]
            number, check, records = first, 0, []
            size, last = width * length, np.array([end], encoder.kind).tobytes()

            def flush() -> pa.RecordBatch:
                slots = order.slots(np.arange(number - len(records), number))
                return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(records, pa.binary())], ["slot", "record"])

            for batch in batches:
                for doc_id, text in zip(*batch.columns, strict=True):
                    doc_id, ids = doc_id.as_py(), encoder.encode(text.as_py() or "")
                    check = zlib.crc32(b"%r %d" % (doc_id, len(ids)), check)
                    data = np.array(ids, encoder.kind).tobytes() + last
                    for part in range(_sequences(len(ids), length)):
                        piece = data[part * size : (part + 1) * size]
                        head = np.array((NO_ID if doc_id is None else doc_id, part, len(piece) // width), HEADER)
                        records.append(head.tobytes() + piece + last * ((size - len(piece)) // width))
                        number += 1
                        if len(records) >= 4096:
                            yield flush()
                            records = []
            if records:
                yield flush()
            if (number - first, check) != (expected, expected_check):
                raise ValueError("the texts were read in another order than when they were counted")

        shards = -(-total // shard_records)
        placed = rows.mapInArrow(run, "slot long, record binary")
        dealt = placed.repartitionById(shards, F.floor(F.col("slot") / shard_records).cast("int"))
        write_raw(dealt.sortWithinPartitions("slot"), "record", path, "\n")
    return total


SCHEMA = "slot long, shard int, offset long, doc_id long, part int, n_tokens int, tokens binary"


def read_shards(
    spark: SparkSession, path: str, length: int = 512, shard_records: int = 32768, width: int = 2, first_slot: int = 0,
    tokens: bool = True,
) -> DataFrame:
    """Records from ``first_slot`` on, in the order of slots within each shard.

    Shards before that slot are not opened: their number is in the file name. A shard whose size is
    not a whole number of strides, or more than ``shard_records`` of them, raises.
    """
    size = stride(length, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = np.dtype([("head", HEADER), ("ids", f"V{width * length}"), ("line", "V1")])
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                data, shard = content.as_py(), int(re.search(r"part-(\d+)", name.as_py())[1])
                if len(data) % size or len(data) > size * shard_records:
                    raise ValueError(f"{name.as_py()}: {len(data)} bytes are no whole records of {size}")
                rows = np.frombuffer(data, layout)
                at = max(0, first_slot - shard * shard_records)
                for start in range(at, len(rows), 4096):
                    some = rows[start : start + 4096]
                    place = np.arange(start, start + len(some), dtype=np.int64)
                    ids = [r.tobytes()[: width * int(n)] for r, n in zip(some["ids"], some["head"]["length"], strict=True)]
                    doc = some["head"]["doc_id"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place + shard * shard_records), pa.array(np.full(len(some), shard, np.int32)),
                         pa.array(place * size), pa.array(doc, mask=doc == NO_ID),
                         pa.array(some["head"]["part"].astype(np.int32)),
                         pa.array(some["head"]["length"].astype(np.int32)),
                         pa.array(ids if tokens else [zlib.crc32(i).to_bytes(4, "big") for i in ids], pa.binary())],
                        ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "tokens"])

    files = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)
    number = F.regexp_extract("path", "part-(\\d+)[^/]*$", 1).cast("long")
    return files.where(number >= first_slot // shard_records).select("path", "content").mapInArrow(run, SCHEMA)


def materialised_order(
    docs: DataFrame, length: int = 512, shard_records: int = 32768, key: str = "epoch-0", stored: bool = False
) -> DataFrame:
    """Write the shards to the shared folder and read them back: a row per slot, with a checksum of its ids."""
    spark = docs.sparkSession
    path = shared_folder(spark, "shards")
    if not write_shards(docs, path, length, shard_records, key, stored=stored):
        spark.createDataFrame([], "value string").write.text(path)
    found = read_shards(spark, path, length, shard_records, tokens=False)
    return found.select("slot", "shard", "offset", "doc_id", "part", "n_tokens",
                        F.conv(F.hex("tokens"), 16, 10).cast("long").alias("tokens_crc32"))
