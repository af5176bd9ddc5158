import base64
import hashlib
import struct

import pytest
import zstandard

from riskloom.llm import warc

PAGES = "page_id long, url string, html string, refers_to int, sha1 string, size string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], PAGES)


def awkward():
    big = "<p>" + "é long " * 60_000
    rows = [(n, f"http://h/{n}?a b\r\nX: y", f"<html>{n % 7}</html>") for n in range(30)]
    return rows + [(100, None, None), (101, "u", ""), (102, "ü", big), (103, "u", big), (104, "u", "x\r\n\r\nWARC/1.1\r\n"),
                   (None, "u", "<html>3</html>"), (105, "u", "same"), (105, "u", "same"), (90, "u", "same")]


def expected(rows, least=0):
    newest = {}
    for i, _, h in rows:
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        refer = newest[h or ""] if i is not None and len(data) >= least and newest[h or ""] != i else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refer is not None else "response", refer))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, tmp_path, least):
    rows, path = awkward(), str(tmp_path / "w")
    warc.write_archives(pages(spark, rows).repartition(3), path, least, archive_bytes=20_000)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, least)
    texts = {i: h for i, _, h in rows}
    for r in got:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload).decode() == (texts[r.page_id] or "")
    assert len({r.archive for r in got}) > 3


def test_archive_is_plain_zstandard_with_a_dictionary_in_front(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archives(pages(spark, awkward()).coalesce(1), str(path))
    data = next(path.glob("part-*")).read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data[8 + size :], read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\nWARC-Type: re") == len(awkward())


def frame(data):
    dictionary = b"some plain content for a dictionary"
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.dictionary_frame(dictionary) + packer.compress(data)


@pytest.mark.parametrize("spoil, says", [
    (lambda r: r.replace(b"WARC/1.1", b"WARD/1.1"), "not a WARC"),
    (lambda r: r.replace(b"WARC-Date: ", b"WARC-Dote: "), "missing"),
    (lambda r: r[:-1], "bytes, its header says"),
    (lambda r: r.replace(b"hello", b"hallo"), "digest"),
    (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: resource"), "not a proper"),
])
def test_damaged_records_raise(spoil, says):
    good = warc.record(1, "u", b"hello", None, "2020-01-01T00:00:00Z")
    (_, data), = warc.frames(frame(good))
    assert warc.parse(data)["payload"] == b"hello"
    with pytest.raises(ValueError, match=says):
        (_, data), = warc.frames(frame(spoil(good)))
        warc.parse(data)


@pytest.mark.parametrize("cut", [4, 20, -3])
def test_cut_archives_raise(cut):
    with pytest.raises(ValueError):
        list(warc.frames(frame(warc.record(1, "u", b"hello", None, "d"))[:cut]))
    with pytest.raises(ValueError, match="begin"):
        list(warc.frames(b"\x28\xb5\x2f\xfd" * 4))


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, awkward()).limit(0), path)
    assert warc.read_archives(spark, path).collect() == []
