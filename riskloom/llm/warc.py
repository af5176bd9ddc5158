"""WARC archives compressed record by record with a shared Zstandard dictionary."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.tables import write_raw
from riskloom.session import materialize

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # a skippable frame without content, all ASCII
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
FEED = 1 << 16


def bare_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    """The url on one line: bytes that a header can't hold are percent-coded; null gets the page's own name."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url.encode())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone.

    The HTTP header of both states the length of the full payload.
    """
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n")
    block = http.encode() + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{bare_digest(payload)}", f"WARC-Block-Digest: sha1:{bare_digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def train_dictionary(pages: DataFrame, samples: int = 256, sample_chars: int = 8192, size: int = 16384) -> bytes:
    """A dictionary learnt from at most ``samples`` pages, ``sample_chars`` of each.

    Pages are drawn by the hashes of their ids, about as many as wanted over all tasks together, so
    what comes to the driver is bounded whatever the number of pages. Too few pages to train on
    give a dictionary of plain content.
    """
    some = pages.where("html is not null")
    share = min(1.0, 2.0 * samples / max(some.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit("dictionary"), "page_id"), F.lit(1 << 30))
    rows = (
        some.where(drawn < int(share * (1 << 30)))
        .select(F.substring("html", 1, sample_chars).alias("html"), drawn.alias("h"))
        .orderBy("h", "html").limit(samples).collect()
    )
    texts = [record(0, None, r["html"].encode(), None, "1970-01-01T00:00:00Z") for r in rows]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        plain = b"".join(texts) + record(0, None, b"", None, "1970-01-01T00:00:00Z")
        return plain[-size:]


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the largest page_id of equal payloads, null on that page itself.

    Only payloads that occur more than once are joined, so what is joined has a row per group of
    copies; pages move only if that is too large to send to every task. Payloads under
    ``least_bytes`` and pages without an id refer to nothing.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    groups = materialize(
        marked.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha1", "size").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
        .where("n > 1").select("sha1", "size", "newest"),
        "payload-groups",
    )
    return marked.join(groups, ["sha1", "size"], "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") != F.col("newest"), F.col("newest")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 8 << 20, level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write ``pages(page_id, url, html)`` as archives of about ``archive_bytes`` of records each.

    An archive begins with a skippable frame that holds the dictionary; each record is a frame of its
    own. Null html is an empty payload. Of records with equal payloads of at least ``least_bytes``
    bytes the one with the largest page_id is a response and the others are revisits of it; rows
    that repeat that page_id are responses as well. Null page_id: a response named ``null``. No
    pages: no archive. Extra columns are ignored.
    """
    dictionary = train_dictionary(pages)
    lead = dictionary_frame(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True
        )
        frames, held = [lead], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                one = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), date)
                frames.append(packer.compress(one))
                held += len(one)
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], ["content"])
                    frames, held = [lead], 0
        if len(frames) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(frames)], pa.binary())], ["content"])

    archives = with_references(pages, least_bytes).mapInArrow(run, "content binary")
    # One row is one archive; the writer ends each with an empty skippable frame.
    write_raw(archives, "content", path, EMPTY_FRAME, per_file=1)


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and decoded bytes of every record frame; the dictionary comes from the first frame."""
    view = memoryview(content)
    if len(view) < 8 or struct.unpack_from("<I", view)[0] != DICTIONARY_MAGIC:
        raise ValueError("archive does not begin with a dictionary frame")
    size = struct.unpack_from("<I", view, 4)[0]
    if len(view) < 8 + size:
        raise ValueError("dictionary frame is cut short")
    dictionary = bytes(view[8 : 8 + size])
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    at = 8 + size
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"rest of {len(view) - at} bytes at {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            at += 8 + size
            if at > len(view):
                raise ValueError("skippable frame is cut short")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        decoder, parts, fed = unpacker.decompressobj(), [], at
        while not decoder.eof:
            if fed >= len(view):
                raise ValueError(f"frame at {at} is cut short")
            try:
                parts.append(decoder.decompress(bytes(view[fed : fed + FEED])))
            except zstandard.ZstdError as error:
                raise ValueError(f"frame at {at}: {error}") from error
            fed = min(fed + FEED, len(view))
        yield at, b"".join(parts)
        at = fed - len(decoder.unused_data)


def parse(data: bytes) -> dict:
    """Fields of one record; a wrong version, header, length or digest raises."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1") or not blank:
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ValueError(f"headers missing: {missing}")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"record has {len(rest) - 4} bytes, its header says {length}")
    block = rest[:length]
    if headers.get("WARC-Block-Digest") not in (None, "sha1:" + bare_digest(block)):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"\r\nContent-Length: (\d+)", http)
    if stated is None:
        raise ValueError("HTTP header states no length")
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != int(stated[1]) or bare_digest(payload) != digest:
            raise ValueError("payload differs from its length or digest")
    elif kind != "revisit" or payload or headers.get("WARC-Profile") != PROFILE or "WARC-Refers-To" not in headers:
        raise ValueError(f"not a proper record of type {kind}")

    def number(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", headers.get(name, ""))
        return int(found[1]) if found else None

    return {"page_id": number("WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "record_type": kind,
            "payload_bytes": int(stated[1]), "payload_digest": digest, "refers_to": number("WARC-Refers-To"),
            "payload": payload if kind == "response" else None}


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(),
          "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
SCHEMA = ("archive string, offset long, page_id long, url string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long, payload binary")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, with the place of its frame.

    Each frame is decoded on its own with the archive's dictionary, and headers, lengths and
    digests are verified; damage raises with the archive's name. ``payloads=False`` leaves the
    payload column null. An archive is read whole, so it should stay within some tens of MB.
    """
    names = ["archive", "offset", *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                rows, offsets, held = [], [], 0
                try:
                    for at, data in frames(content.as_py()):
                        rows.append(parse(data))
                        offsets.append(at)
                        if not payloads:
                            rows[-1]["payload"] = None
                        held += len(rows[-1]["payload"] or b"") + 256
                        if held > 4 << 20:
                            yield _batch(names, path.as_py(), offsets, rows)
                            rows, offsets, held = [], [], 0
                except (ValueError, KeyError) as error:
                    raise ValueError(f"{path.as_py()}: {error}") from error
                yield _batch(names, path.as_py(), offsets, rows)

    found = spark.read.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)
    return found.select("path", "content").mapInArrow(run, SCHEMA)


def _batch(names: list[str], archive: str, offsets: list[int], rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([archive] * len(rows), pa.string()), pa.array(offsets, pa.int64())]
    columns += [pa.array([r[n] for r in rows], t) for n, t in FIELDS.items()]
    return pa.RecordBatch.from_arrays(columns, names)
