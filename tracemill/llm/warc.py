"""Legacy archive converter: ARC files, versions 1 and 2, to WARC 1.1.

An ARC file begins with a filedesc record that names the version of its header lines; each header line
ends in the declared length of what follows, and nothing else says where a record ends. The converter
keeps target, date and content, and synthesises what WARC wants besides: a record id from the content, the
date in ISO form, the type of record, and digests of block and payload.

Whole archives are written by Spark's own text writer (a record is a line that ends in an empty one), so
that any file system that Spark knows will do and a task that is run again leaves no half file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._shared import joined, scratch_dir, written

REVISIT_BYTES = 100  # equal payloads of at least so many bytes are stored once
RECORDS_PER_FILE = 2000
FILE_BYTES = 64 << 20  # of payloads in a file, at the mean size
ARC_BYTES = 1 << 20  # of an archive that is put together in memory
ARC_DATE = "20200101000000"
UNKNOWN_URI = "urn:unknown"

#: The header lines of ARC files, by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class ArchiveError(ValueError):
    """An archive that doesn't follow its format."""


@dataclass
class ArcRecord:
    url: str
    date: str  # 14 digits
    type: str
    body: bytes
    more: dict[str, str] = field(default_factory=dict)


def _field(s: str) -> str:
    """A header field, without line ends."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", s)


def arc_file(records: list[ArcRecord], version: int, name: str = "archive") -> bytes:
    """The records as an ARC file."""
    head = f"{version} 0 tracemill\n".encode() + ARC_NAMES[version] + b"\n"
    out = []
    for r in [ArcRecord(f"filedesc://{name}", ARC_DATE, "text/plain", head), *records]:
        own = {"url": _field(r.url) or UNKNOWN_URI, "ip": "0.0.0.0", "date": r.date, "type": r.type, "code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(r.body))} | r.more
        # The first line has the fields of version 1 or 2, as all others have.
        out += [" ".join(own[f] for f in ARC_FIELDS[version]).encode(), b"\n", r.body, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the filedesc record first. A header's fields are counted from its right, as urls may hold spaces."""
    at, version = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].rstrip(b"\r")
        at = len(data) if end < 0 else end + 1
        if not line:
            continue  # records are set apart by empty lines
        if not version:
            m = re.match(rb"filedesc://\S*( \S+)+$", line)
            if not m:
                raise ArchiveError("an ARC file begins with filedesc")
            length = int(line.rsplit(b" ", 1)[1])
            version = int(data[at : at + length].split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ArchiveError(f"unknown ARC version {version}")
        names = ARC_FIELDS[version]
        parts = line.rsplit(b" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ArchiveError(f"bad header line {line[:100]!r}")
        own = {k: v.decode("utf-8", "surrogateescape") for k, v in zip(names, parts, strict=True)}
        length = int(own["length"])
        if at + length > len(data):
            raise ArchiveError("a record ends before its declared length")
        yield ArcRecord(own.pop("url"), own.pop("date"), own.pop("type"), data[at : at + length], own)
        at += length


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes

    def __bytes__(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in (self.headers | {"Content-Length": str(len(self.block))}).items())
        return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + self.block + b"\r\n\r\n"


def http_payload(block: bytes) -> bytes:
    """What follows the head of an HTTP response."""
    return block[block.index(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""


def iso_date(arc_date: str) -> str:
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, of)))}>"


def to_warc(r: ArcRecord) -> WarcRecord:
    """The WARC record of an ARC record."""
    block_digest = "sha1:" + base64.b32encode(hashlib.sha1(r.body).digest()).decode()
    h = {"WARC-Type": "resource", "WARC-Target-URI": r.url, "WARC-Date": iso_date(r.date), "WARC-Record-ID": record_id(r.url, r.date, block_digest)}
    if r.url.startswith("filedesc:"):
        h = {"WARC-Type": "warcinfo", "WARC-Date": h["WARC-Date"], "WARC-Record-ID": h["WARC-Record-ID"], "WARC-Filename": r.url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}
        return WarcRecord(h, b"software: tracemill\r\nformat: WARC File Format 1.1\r\n")
    if re.match(rb"HTTP/\d", r.body):
        payload = http_payload(r.body)
        h |= {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(), "WARC-Payload-Length": str(len(payload))}
    else:
        h |= {"Content-Type": "text/dns" if r.url.startswith("dns:") else r.type}
    return WarcRecord(h | {"WARC-Block-Digest": block_digest}, r.body)


def as_revisit(w: WarcRecord, refers_to: str) -> WarcRecord:
    """A response without its payload, which record refers_to has."""
    h = w.headers | {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": refers_to}
    h.pop("WARC-Block-Digest", None)
    return WarcRecord(h, w.block[: len(w.block) - len(http_payload(w.block))])


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of an uncompressed WARC file, by their declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ArchiveError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head[k] = v.strip(" ")
        length = int(head["Content-Length"])
        if end + 8 + length > len(data):
            raise ArchiveError("a record ends before its declared length")
        yield WarcRecord(head, data[end + 4 : end + 4 + length])
        at = end + 8 + length


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def convert_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ARC files (plain or gzip) -> path, number, headers and block of the WARC records they turn into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                found = [to_warc(r) for r in parse_arc(gunzip(data) if data[:2] == b"\x1f\x8b" else data)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array([list(w.headers.items()) for w in found], pa.map_(pa.string(), pa.string())), pa.array([w.block for w in found], pa.binary())],
                    ["path", "number", "headers", "block"],
                )

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, number long, headers map<string,string>, block binary")


def _page_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html, first -> WARC records as text, by way of ARC files of either version."""
    number = 0
    for batch in batches:
        ids, urls, pages, firsts = (batch.column(k).to_pylist() for k in range(4))
        i = 0
        while i < len(ids):
            part, size, j = [], 0, i
            while j < len(ids) and (j == i or size < ARC_BYTES):
                body = (pages[j] or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                part.append(ArcRecord(urls[j] or UNKNOWN_URI, ARC_DATE, "text/html", head.encode() + body))
                size += len(body)
                j += 1
            number += 1
            info, *records = map(to_warc, parse_arc(arc_file(part, 1 + number % 2)))
            out = [info] if number == 1 else []
            for w, page, first in zip(records, ids[i:j], firsts[i:j], strict=True):
                digest = w.headers["WARC-Payload-Digest"]
                w.headers["WARC-Record-ID"] = record_id(page, digest)
                if page is not None:
                    w.headers["X-Page-Id"] = str(page)
                if first is not None and first != page:
                    w = as_revisit(w, record_id(first, digest))
                    w.headers["X-Refers-To-Page"] = str(first)
                out.append(w)
            # The writer ends the line of a record, which itself ends in two line ends.
            yield pa.RecordBatch.from_arrays([pa.array([bytes(w)[:-2].decode() for w in out], pa.string())], ["value"])
            i = j


def write_pages(pages: DataFrame, path: str) -> None:
    """A WARC record for each row of pages (page_id, url, html), in gzip files under path.

    Of rows with equal payloads of REVISIT_BYTES or more that with the least id is a response, as are others
    with the same id; the rest revisit it. If none has an id, all are responses. A null html is empty.
    Only digests are shuffled to tell which is which; pages are where they were read, unless very many payloads repeat.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= REVISIT_BYTES, F.unhex(F.sha2("html", 256)))
    seen = written(rows.select("page_id", F.octet_length("html").alias("size"), digest.alias("digest")))
    firsts = written(seen.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    mean = seen.agg(F.avg("size")).first()[0] or 0
    per_file = int(max(1, min(RECORDS_PER_FILE, FILE_BYTES / (mean + 512))))
    records = joined(rows.withColumn("digest", digest), firsts, "digest", "left").select("page_id", "url", "html", "first").mapInArrow(_page_records, "value string")
    _write(records, path, per_file)


def _write(records: DataFrame, path: str, per_file: int) -> None:
    """value, a record without its last line end, as a line of gzip files. The writer passes bytes on as they are."""
    records.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).text(path)


def write_records(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Records (headers, block), as of convert_files, in gzip WARC files under path; blocks of any bytes."""
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\r\n")
    size = F.concat(F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"))
    value = F.concat(F.lit("WARC/1.1\r\n").cast("binary"), lines.cast("binary"), size.cast("binary"), F.lit("\r\n\r\n").cast("binary"), "block", F.lit("\r\n").cast("binary"))
    _write(records.select(value.cast("string").alias("value")), path, per_file)


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for w in parse_warc(gunzip(data.as_py())):
                h = w.headers
                if h["WARC-Type"] not in ("response", "revisit"):
                    continue
                page, first = (int(h[k]) if k in h else None for k in ("X-Page-Id", "X-Refers-To-Page"))
                if h["WARC-Type"] == "response":
                    payload = http_payload(w.block)
                    rows.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "response", None))
                else:
                    rows.append((page, int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", first))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the archives under path say of each page; payloads are measured anew."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back.

    A null html is an empty payload, a null url a placeholder; rows without id are kept. Repeated rows give a record each,
    with the same id all responses, if theirs is the least. Columns beyond page_id, url and html, whatever their names,
    are ignored. Pages of any size are kept whole; an empty table gives no rows.
    """
    path = scratch_dir(spark)
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path)


QUERIES = {"op5_warc": op5_warc}
ORACLES = {
    "op5_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), q AS (
  SELECT page_id, payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""
}
