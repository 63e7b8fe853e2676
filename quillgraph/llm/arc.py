r"""Legacy ARC archives to WARC.

An ARC file opens with a record whose body states the version and names the fields of the header lines:
version 1 has five, version 2 ten. Each record is one header line, then as many bytes as its last field
declares, then a line feed. to_warc() turns each record into a WARC/1.0 record with a synthesised
identifier, date, type and digests: a body that opens with an HTTP header is a response, whose payload is
what follows the header; any other is a resource.

convert_archives() does so with stored ARC files. write_pages() takes a table of pages that way: rows become
ARC bytes, the converter turns these into WARC records, Spark writes the archives into the shared folder,
and read_archives() reads them again.

Defined cases: null html is an empty payload, a null url is "unknown:", and white space in a url is
percent-encoded, since it separates an ARC header's fields. Of rows with equal payloads of `least` bytes
or more, all that have the group's largest page_id are responses; a group of null page_ids is responses
only. Repeated rows are archived each. A very long payload makes its file longer than others. Other
columns are not read; an empty table makes an empty archive.
"""
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_blobs, shared_dir, stored, write_blobs

CRLF, BETWEEN = b"\r\n", "\r\n\r\n"
#: Fields of the header lines by version (public format description).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Rows of the groups of equal payloads up to which they are broadcast; a row takes under 100 bytes.
BROADCAST_GROUPS = 100_000
#: Bytes of records that are written as one piece, and pieces of one archive file: a reader's memory is
#: bounded by 64 MB and one record.
PIECE_BYTES, FILE_PIECES = 4_000_000, 16
HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    status: str
    body: bytes


def write_arc(records: list[ArcRecord], version: int) -> bytes:
    names = " ".join(FIELDS[version])
    about = f"{version} 0 quillgraph\n{names}\n\n".encode()
    out = [_line(ArcRecord("filedesc://pages.arc", "0.0.0.0", "19960101000000", "text/plain", "200", about), version), about, b"\n"]
    for r in records:
        out += [_line(r, version), r.body, b"\n"]
    return b"".join(out)


def _line(r: ArcRecord, version: int) -> bytes:
    more = [r.status, "-", "-", "0", "pages.arc"] if version == 2 else []
    return (" ".join([r.url, r.ip, r.date, r.mime, *more, str(len(r.body))]) + "\n").encode()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records behind the opening one. Raises ValueError where a line or a length is wrong."""
    fields, at = None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line doesn't end")
        parts = data[at:end].decode("utf-8").split(" ")
        if fields is None and not parts[0].startswith("filedesc://"):
            raise ValueError("an ARC file opens with its own description")
        if fields is not None and len(parts) != len(fields):
            raise ValueError(f"an ARC header line of {len(parts)} fields; {len(fields)} are declared")
        n = int(parts[-1])
        body = data[end + 1 : end + 1 + n]
        if len(body) != n:
            raise ValueError("an ARC record is shorter than it declares")
        at = end + 1 + n
        if data[at : at + 1] == b"\n":
            at += 1
        if fields is None:
            version = int(body.split(b" ", 1)[0])
            fields = FIELDS.get(version)
            if fields is None:
                raise ValueError(f"ARC version {version}")
            continue
        x = dict(zip(fields, parts))
        yield ArcRecord(x["URL"], x["IP-address"], x["Archive-date"], x["Content-type"], x.get("Result-code", "200"), body)


def record_id(page_id: int | None, sha1: str) -> uuid.UUID:
    """A version 8 UUID whose free 122 bits hold the page_id, whether there is one, and 57 bits of the
    payload's digest: the same on every run, and the page can be read off a reference to it."""
    v = ((page_id or 0) % 2**64) << 58 | (page_id is None) << 57 | int(sha1[:15], 16) >> 3
    return uuid.UUID(int=(v >> 74) << 80 | 8 << 76 | (v >> 62 & 0xFFF) << 64 | 0b10 << 62 | v & (2**62 - 1))


def page_of(record: str) -> int | None:
    u = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    v = (u >> 80) << 74 | (u >> 64 & 0xFFF) << 62 | u & (2**62 - 1)
    page = v >> 58
    return None if v >> 57 & 1 else page - 2**64 if page >= 2**63 else page


def iso_date(date: str) -> str:
    """14 digits; a shorter date is filled up, as old crawlers cut it."""
    d = (date + "19960101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def payload_of(body: bytes) -> bytes:
    """What follows the HTTP header, if there is one."""
    return body.partition(b"\r\n\r\n")[2] if body.startswith(b"HTTP/") else body


def to_warc(r: ArcRecord, page_id: int | None, refers_to: int | None) -> bytes:
    """The WARC record without the two line ends that follow every record. With refers_to it is a
    revisit: it has no body and tells the length and the digest of the payload that it stands for."""
    payload, http = payload_of(r.body), r.body.startswith(b"HTTP/")
    sha1 = hashlib.sha1(payload).hexdigest()
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id(page_id, sha1)}>"), ("WARC-Date", iso_date(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{record_id(refers_to, sha1)}>"), ("X-Payload-Length", str(len(payload)))]
    else:
        head += [("WARC-Block-Digest", f"sha1:{hashlib.sha1(r.body).hexdigest()}"), ("Content-Type", "application/http; msgtype=response" if http else r.mime)]
    body = b"" if refers_to is not None else r.body
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and body of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one is due")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        body = data[end + 4 : end + 4 + int(head["content-length"])]
        at = end + 4 + len(body)
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where it declares")
        at += 4
        yield head, body


def with_original(pages: DataFrame, least: int) -> DataFrame:
    """pages(page_id, url, body) with original: the page that a row's payload is kept under, if another."""
    big = F.octet_length("body") >= least
    groups = stored(pages.filter(big).groupBy(F.sha1("body").alias("sha1")).agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").select("sha1", "original"))
    keyed = pages.withColumn("sha1", F.when(big, F.sha1("body")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    few = groups.count() <= BROADCAST_GROUPS
    out = keyed.join(F.broadcast(groups) if few else groups, "sha1", "left")
    return out.withColumn("original", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))).drop("sha1")


def _pieces(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Records in a row, joined by their line ends up to PIECE_BYTES."""
    held: list[bytes] = []
    size = 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= PIECE_BYTES:
            yield pa.record_batch([pa.array([BETWEEN.encode().join(held)], pa.binary())], ["records"])
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array([BETWEEN.encode().join(held)], pa.binary())], ["records"])


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                rows = b.slice(i, 128).to_pylist()
                for version in FIELDS:  # both kinds of archive pass through the converter
                    own = [r for r in rows if (r["page_id"] or 0) % 2 == version % 2]
                    arc = write_arc([ArcRecord(re.sub(r"\s", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), r["url"] or "unknown:"), "0.0.0.0", "19960101000000", "text/html", "200", HTTP + r["body"]) for r in own], version)
                    yield from (to_warc(a, r["page_id"], r["original"]) for a, r in zip(read_arc(arc), own, strict=True))

    return _pieces(records())


def _convert_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = (c.as_buffer().to_pybytes() for b in batches for c in b.column(0))
    return _pieces(to_warc(r, None, None) for data in files for r in read_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))


def convert_archives(spark, source: str, to: str) -> None:
    """The ARC files under source (of either version, gzipped or not, of up to 2 GB) as WARC files under to."""
    files = spark.read.format("binaryFile").load(source).select("content")
    write_blobs(files.mapInArrow(_convert_files, "records binary"), "records", to, BETWEEN, FILE_PIECES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for b in batches:
        for content in b.column(0):
            rows = []
            for head, body in read_warc(content.as_buffer().to_pybytes()):
                sha1 = head["warc-payload-digest"].removeprefix("sha1:")
                revisit = head["warc-type"] == "revisit"
                if not revisit and hashlib.sha1(body).hexdigest() != head["warc-block-digest"].removeprefix("sha1:"):
                    raise ValueError("a record doesn't match its digest")
                body = payload_of(body)
                if not revisit and hashlib.sha1(body).hexdigest() != sha1:
                    raise ValueError("a payload doesn't match its digest")
                rows.append((page_of(head["warc-record-id"]), int(head["x-payload-length"]) if revisit else len(body), sha1, head["warc-type"], page_of(head["warc-refers-to"]) if revisit else None, head["warc-target-uri"]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)


def write_pages(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Archives of pages(page_id, url, html) under path."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body"))
    records = with_original(own, least).select("page_id", "url", "body", "original").mapInArrow(_convert, "records binary")
    write_blobs(records, "records", path, BETWEEN, FILE_PIECES)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record under path."""
    return read_blobs(spark, path).select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    path = shared_dir(pages.sparkSession)
    write_pages(pages, path)
    return read_archives(pages.sparkSession, path).drop("url")
