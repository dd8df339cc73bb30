import base64
import hashlib
import struct

import pytest
import zstandard

from eventloom.llm import warc
from eventloom.llm.queries import op9_warc_archives


def brute(rows):
    first, out = {}, []
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in rows:
        p = (h or "").encode()
        again = i != first[h or ""]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out)


def result(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(op9_warc_archives(spark, small)) == brute(rows)


def test_odd_rows(spark):
    rows = [(3, "http://x/a b\n", None), (1, None, ""), (2, "u", "café \r\n\r\n WARC/1.1"), (5, "u", "café \r\n\r\n WARC/1.1"), (4, "ü", "z" * 3_000_000), (7, "u", "q"), (7, "u", "q")]
    d = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, bytes int")
    assert result(warc.round_trip(d, archive_bytes=1 << 16)) == brute(rows)
    got = {r.page_id: bytes(r.payload) for r in warc.records(warc.archives(d), payloads=True).collect() if r.record_type == "response"}
    assert got[2] == rows[2][2].encode() and len(got[4]) == 3_000_000
    assert {r.record_type for r in warc.round_trip(d, least=1 << 30).collect()} == {"response"}
    assert warc.round_trip(d.limit(0)).collect() == []


def test_files(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(warc.write_archive([warc.record("response", str(i), "u", b"p%d" % i) for i in range(50)]))
    assert sorted(r.page_id for r in warc.records(warc.load(spark, str(tmp_path))).collect()) == list(range(50))


def test_one_frame_per_record_after_the_dictionary():
    a = warc.write_archive([warc.record("response", str(i), "u", b"text %d" % i * 40) for i in range(300)])
    magic, n = struct.unpack_from("<II", a)
    assert magic == 0x184D2A5D
    d = zstandard.ZstdDecompressor().decompress(a[8 : 8 + n])
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d))
    at, frames = 8 + n, 0
    while at < len(a):
        o = z.decompressobj()
        assert o.decompress(a[at:]).startswith(b"WARC/1.1\r\n")
        at, frames = len(a) - len(o.unused_data), frames + 1
    assert frames == 300


def broken():
    good = warc.write_archive([warc.record("response", "1", "u", b"payload")])
    yield b""
    yield good[8:]
    yield good[:-3]
    yield good + b"junk"
    yield warc.write_archive([warc.record("response", "1", "u", b"payload").replace(b"payload", b"paYload", 1)])
    yield warc.write_archive([warc.record("response", "1", "u", b"payload").replace(b"WARC-Date", b"X-Date")])
    yield warc.write_archive([warc.record("response", "1", "u", b"payload") + b"x"])
    yield warc.write_archive([b"GET / HTTP/1.1\r\n\r\n"])


@pytest.mark.parametrize("content", list(broken()))
def test_wrong_archives_are_refused(content):
    with pytest.raises(ValueError):
        list(warc.read_archive(content))


def test_long_frames_and_many_repeats(spark, monkeypatch):
    """Frames longer than a step are read whole, archives of many records in linear time; repeats by join instead of broadcast."""
    import os
    import time

    noise = [os.urandom(1000 * (i % 7) * 40) for i in range(20)]
    a = warc.write_archive([warc.record("response", str(i), "u", p) for i, p in enumerate(noise)])
    assert [p for _, p in warc.read_archive(a)] == noise
    a = warc.write_archive([warc.record("response", str(i), "u", b"%d" % i * 300) for i in range(20_000)])
    t = time.time()
    assert sum(1 for _ in warc.read_archive(a)) == 20_000
    assert time.time() - t < 60
    monkeypatch.setattr(warc, "REPEATED", 0)
    rows = [(i, "u", f"page {i % 3}") for i in range(30)]
    assert result(warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))) == brute(rows)
