"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are rows of (archive, content): written by tasks in bounded size, kept in any store that Spark reads, and read back
from such rows or, with `load`, from .warc.zst files of any Spark path.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.runtime import cut

#: First bytes of the skippable frame that holds a dictionary, and of a Zstandard frame and dictionary. Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
#: Bytes of an archive that are decompressed at a time.
STEP = 1 << 16
#: Repeated payloads up to which their table is broadcast; beyond, it is joined by hash.
REPEATED = 500_000
EPOCH = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, ident: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit names the record it repeats and keeps no payload, but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the first records of an archive; raw content where they are too few or too plain."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def write_archive(records: list[bytes], dictionary_bytes: int = 16 << 10, level: int = 3, samples: int = 200) -> bytes:
    d = _dictionary(records[:samples], dictionary_bytes)
    packed = zstandard.ZstdCompressor(level=level).compress(d)
    kind = zstandard.DICT_TYPE_FULLDICT if d.startswith(DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(c.compress, records)])


def read_archive(content: bytes):
    """Yield (headers, payload) of each record; raises ValueError where a frame, a header or a length is wrong."""
    if len(content) < 8:
        raise ValueError("no leading skippable frame")
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE or 8 + size > len(content):
        raise ValueError("no leading skippable frame with a dictionary")
    d = content[8 : 8 + size]
    if d.startswith(FRAME):
        d = zstandard.ZstdDecompressor().decompressobj().decompress(d)
    kind = zstandard.DICT_TYPE_FULLDICT if d.startswith(DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind))
    at, view = 8 + size, memoryview(content)
    while at < len(content):
        if bytes(view[at : at + 4]) != FRAME:
            raise ValueError(f"no frame at byte {at}")
        # In steps, as what is left of a step after the end of the frame is copied.
        one, raw, end = z.decompressobj(), [], at
        while not one.eof:
            if end >= len(content):
                raise ValueError(f"the frame at byte {at} ends early")
            raw.append(one.decompress(view[end : end + STEP]))
            end = min(end + STEP, len(content))
        at = end - len(one.unused_data)
        yield parse_record(b"".join(raw))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(k):
            raise ValueError(f"{k} is missing")
    n = int(headers["content-length"]) if headers["content-length"].isdigit() else -1
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the length of the record's block is not as stated")
    http, mark, payload = rest[:n].partition(b"\r\n\r\n")
    m = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", http)
    if not mark or not m:
        raise ValueError("the block has no HTTP head")
    headers["http-length"] = m[1].decode()
    if headers["warc-type"] == "response":
        if int(m[1]) != len(payload):
            raise ValueError("the payload's length is not as stated")
        if headers.get("warc-payload-digest") != "sha1:" + digest(payload):
            raise ValueError("the payload's digest is not as stated")
    return headers, payload


def archives(pages: DataFrame, page: str = "page_id", url: str = "url", markup: str = "html", least: int = 0, archive_bytes: int = 4 << 20) -> DataFrame:
    """(archive, content): every row of pages as one record, in archives of about `archive_bytes` before compression.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page are responses, and others
    revisit it; null markup is an empty payload. Rows without a page id are responses only where all rows of
    their payload lack one.
    """
    p = pages.select(F.col(page).cast("long").alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(markup), F.lit("")).alias("html"))
    p = p.withColumn("key", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    first = p.where(F.col("bytes") >= least).groupBy("key").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = cut(first.select("key", "first"))
    p = p.join(F.broadcast(first) if first.count() <= REPEATED else first, "key", "left").drop("key", "bytes")

    def write(batches):
        held, size, n = [], 0, 0
        for b in filter(len, batches):
            for i, u, h, f in zip(b["page"], b["url"], b["html"], b["first"], strict=True):
                payload = h.encode("utf-8", "surrogatepass")
                ident = "null" if pd.isna(i) else str(int(i))
                again = not pd.isna(f) and (pd.isna(i) or int(i) != int(f))
                held.append(record("revisit" if again else "response", ident, u, payload, str(int(f)) if again else None))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"content": [write_archive(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"content": [write_archive(held)]})

    return p.mapInPandas(write, "content binary").select(F.format_string("%016d.warc.zst", F.monotonically_increasing_id()).alias("archive"), "content")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of .warc.zst files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def records(content: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (, payload) of all records of all archives."""

    def number(x: str | None):
        m = re.fullmatch(r"<urn:page:(-?\d+)>", x or "")
        return int(m[1]) if m else None

    def read(batches):
        for b in filter(len, batches):
            for c in b["content"]:
                rows = []
                for h, payload in read_archive(bytes(c)):
                    rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), int(h["http-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("warc-refers-to"))) + (payload,) * payloads)
                out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return content.select("content").mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write all pages into archives, keep those in the shared folder, and read every record back."""
    return records(cut(archives(pages, **how)))
