"""Legacy archives: ARC records parsed and rewritten as WARC records.

An ARC archive is a version block and a run of records. The version block names its version (1
or 2) and the fields of the record lines; each record is such a line, then as many bytes as the
line's last field declares, then a line feed:

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

The converter makes a WARC/1.0 response of each record: the identifier, the date, the content
type, the payload digest (base32 SHA-1) and the lengths are made from what the record holds. Of
records with equal payloads of at least `min_bytes`, that with the largest page id stays a
response and the others become revisits (identical-payload-digest) without the payload: their
WARC-Refers-To is the identifier of that response, and their HTTP head still tells the payload's
length. An identifier is made of page id, digest and the record's place (archive and offset), so
rows that repeat have identifiers of their own. Each record is a gzip member of its own, so that
readers can seek to one.

Null or empty html is an empty payload. Null urls are written as `-`. Rows with equal page_id and
equal payload are all responses if theirs is the largest id (revisits refer to the one of the last
place); rows without a page_id refer to the response and lose against any id; where no row of a
group has one, all are responses. An empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import cut, shared_path, with_group

FILE_BYTES = 24 << 20
#: The record lines of both versions.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "20240101000000"
#: Field of our own, for revisits whose head doesn't tell the length of their payload.
OWN_LENGTH = "X-Payload-Length"


# --- ARC ---------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    at: int  # where its line begins
    url: str
    ip: str
    date: str
    mime: str
    status: int
    content: bytes


def arc_version_block(version: int, name: str) -> bytes:
    """The first record of an archive: it declares the version and the fields."""
    body = b"%d 0 karst\n%s\n" % (version, ARC_FIELDS[version])
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain {len(body)}\n"
    else:
        line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str | None, content: bytes, at: int, name: str) -> bytes:
    """One record. White space in a URL is escaped, for it separates the fields."""
    safe = re.sub(r"\s", lambda m: quote(m[0]), url or "-") or "-"
    if version == 1:
        line = f"{safe} 0.0.0.0 {DATE} text/html {len(content)}\n"
    else:
        line = f"{safe} 0.0.0.0 {DATE} text/html 200 - - {at} {name} {len(content)}\n"
    return line.encode("utf-8", "surrogatepass") + content + b"\n"


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of an archive of either version, by the fields that its version block declares."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(raw):
        end = raw.find(b"\n", at)
        if end < 0:
            if raw[at:].strip():
                raise ValueError(f"record line at byte {at} is cut short")
            break
        line = raw[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        values = line.split(b" ")
        if line.startswith(b"filedesc://"):
            n = int(values[-1])
            body = raw[end + 1 : end + 1 + n].split(b"\n")
            version = int(body[0].split()[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = body[1].split() if len(body) > 1 and body[1] else ARC_FIELDS[version].split()
            at = end + 1 + n + 1
            continue
        if len(values) != len(fields):
            raise ValueError(f"record line with {len(values)} of {len(fields)} fields at byte {at}")
        x = dict(zip(fields, values))
        n = int(x[b"Archive-length"])
        content = raw[end + 1 : end + 1 + n]
        if len(content) < n:
            raise ValueError(f"record at byte {at} is cut short")
        yield ArcRecord(
            at,
            x[b"URL"].decode("utf-8", "replace"),
            x[b"IP-address"].decode(),
            x[b"Archive-date"].decode(),
            x[b"Content-type"].decode(),
            int(x.get(b"Result-code", b"200")),
            content,
        )
        at = end + 1 + n + 1


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; content without a head is all payload."""
    if content.startswith(b"HTTP/"):
        k = content.find(b"\r\n\r\n")
        if k >= 0:
            return content[: k + 4], content[k + 4 :]
    return b"", content


# --- WARC --------------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str, place: str) -> str:
    """A version 8 UUID that holds the page id, and 48 bits of a hash of digest and place."""
    own = int.from_bytes(hashlib.sha1(f"{digest} {place}".encode()).digest()[:6], "big")
    low = (page_id or 0) & (2**64 - 1)
    mid = (0x400 if page_id is not None else 0) | (low >> 62)
    x = own << 80 | 0x8 << 76 | mid << 64 | 0b10 << 62 | (low & (2**62 - 1))
    h = f"{x:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(ref: str) -> int | None:
    """The page id in a record identifier."""
    x = int(ref.strip("<>").removeprefix("urn:uuid:").replace("-", ""), 16)
    mid = x >> 64 & 0xFFF
    if not mid & 0x400:
        return None
    low = (mid & 3) << 62 | x & (2**62 - 1)
    return low - 2**64 if low >= 2**63 else low


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    head = ["WARC/1.0", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def gzip_row(record: bytes) -> bytes:
    """A record and the two line ends after it as a gzip member, but for its last byte, which is 0.

    A member ends with its length in little-endian order, so the last byte of one under 16 MB is 0;
    a longer one is followed by an empty member, which ends with 0 too.
    """

    def member(x: bytes) -> bytes:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        return pack.compress(x) + pack.flush()

    out = member(record + b"\r\n\r\n")
    return (out if out[-1] == 0 else out + member(b""))[:-1]


def gunzip_members(raw: bytes | memoryview, step: int = 1 << 14) -> bytes:
    """The content of all members of a gzip file. The input is fed in steps, as what follows a member is copied at its end."""
    view, at, out = memoryview(raw), 0, []
    while at < len(view):
        one = zlib.decompressobj(31)
        while not one.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            out.append(one.decompress(view[at : at + step]))
            at += min(step, len(view) - at)
        at -= len(one.unused_data)
    return b"".join(out)


def told_length(head: bytes) -> int | None:
    """The length that an HTTP head tells."""
    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", head)
    return int(m[1]) if m else None


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record."""
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(raw):
            return
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        yield head, raw[end + 4 : end + 4 + n]
        at = end + 4 + n


# --- Spark -------------------------------------------------------------------------------------


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """ARC archives of the pages, one for each batch of rows, versions in turn. A record's HTTP head holds the page id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            version, name = 1 + (part + i) % 2, f"pages-{part}-{i}.arc"
            out = [arc_version_block(version, name)]
            at = len(out[0])
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
                body = html or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n"
                out.append(arc_record(version, url, head % (own, len(body)) + body, at, name))
                at += len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], ["name", "content"])

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("binary").alias("html"),
    )
    return rows.mapInArrow(build, "name string, content binary")


def arc_to_records(archives: DataFrame) -> DataFrame:
    """One row per record of the archives: `name` tells them apart, `content` holds them, gzipped or not. `packed` is the payload, zlib."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for r in parse_arc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    head, payload = split_http(r.content)
                    m = re.search(rb"(?i)\r\nX-Page-Id: (-?\d+)\r\n", head)
                    page, place = int(m[1]) if m else None, f"{name}:{r.at}"
                    rows.append((page, place, r.url, r.ip, r.date, r.mime, head, zlib.compress(payload, 4), b32_sha1(payload), len(payload)))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.string(), pa.int64()]
                cols = list(zip(*rows)) if rows else [()] * 10
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], _RECORD)

    return archives.select("name", "content").mapInArrow(
        parse,
        "page_id long, place string, url string, ip string, date string, mime string, head binary, packed binary, digest string, size long",
    )


_RECORD = ["page_id", "place", "url", "ip", "date", "mime", "head", "packed", "digest", "size"]


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = True
    for b in batches:
        out = []
        if first:
            info = b"software: karst\r\nformat: WARC File Format 1.0\r\n"
            ident = record_id(None, b32_sha1(info), f"info {TaskContext.get().partitionId()}")
            out.append(
                warc_record(
                    "warcinfo",
                    [("WARC-Record-ID", ident), ("WARC-Date", warc_date(DATE)), ("Content-Type", "application/warc-fields")],
                    info,
                )
            )
            first = False
        for r in b.to_pylist():
            best = r["response"]
            revisit = best is not None and best["page_id"] is not None and best["page_id"] != r["page_id"]
            fields = [
                ("WARC-Record-ID", record_id(r["page_id"], r["digest"], r["place"])),
                ("WARC-Target-URI", r["url"]),
                ("WARC-Date", warc_date(r["date"])),
                ("WARC-IP-Address", r["ip"]),
                ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
                ("WARC-Identified-Payload-Type", r["mime"]),
                ("Content-Type", "application/http; msgtype=response" if r["head"] else r["mime"]),
            ]
            if revisit:
                fields += [
                    ("WARC-Profile", REVISIT_PROFILE),
                    ("WARC-Refers-To", record_id(best["page_id"], r["digest"], best["place"])),
                ]
                if told_length(r["head"]) != r["size"]:
                    fields.append((OWN_LENGTH, str(r["size"])))
            out.append(
                warc_record("revisit" if revisit else "response", fields, r["head"] + (b"" if revisit else zlib.decompress(r["packed"])))
            )
        yield pa.RecordBatch.from_arrays([pa.array(map(gzip_row, out), pa.binary())], ["record"])


def write_warc(records: DataFrame, out: str, per_file: int, min_bytes: int = 0) -> None:
    """Write records of arc_to_records, a written table, as WARC files of at most `per_file` records.

    Only digests, ids and places are grouped; a digest that a third of all records share is dealt out by
    a salt. Payloads move once, to meet what their digest's group decided. Spark's text writer puts
    each record's member into the file, then the byte 0 that it lacks.
    """
    same = F.when(F.col("size") >= min_bytes, F.col("digest")).otherwise(
        F.concat_ws(" ", "digest", F.col("page_id").cast("string"))
    )
    named = records.withColumn("__same", same).withColumn("__own", F.struct("page_id", "place"))
    grouped = with_group(named, ["__same"], "__own", "response", "copies").withColumn(
        "response", F.when(F.col("size") >= min_bytes, F.col("response"))
    )
    rows = grouped.select(*_RECORD, "response").mapInArrow(_to_warc, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").option(
        "maxRecordsPerFile", per_file
    ).text(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit of the archives; a response's digest is made from its payload anew."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = []
                for head, block in parse_warc(gunzip_members(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = head["warc-payload-digest"].partition(":")[2]
                    if kind == "response":
                        payload = split_http(block)[1]
                        if b32_sha1(payload) != digest:
                            raise ValueError(f"digest of {head['warc-record-id']} differs from its payload's")
                        size, refers = len(payload), None
                    else:
                        size = int(head[OWN_LENGTH.lower()]) if OWN_LENGTH.lower() in head else told_length(block)
                        refers = page_of(head["warc-refers-to"])
                    rows.append((page_of(head["warc-record-id"]), head["warc-target-uri"], size, digest, kind, refers))
                cols = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], _READ)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        parse,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


_READ = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def run(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC files in the shared folder, and the files read back."""
    out = shared_path(spark, "warc")
    size = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    records = cut(arc_to_records(pages_to_arc(pages)), "records")
    write_warc(records, out, int(FILE_BYTES / (size + 500)) + 1, min_bytes)
    return read_warc(spark, out)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# SQL has no base32: ten bits at a time through list functions of the SHA-1.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((('0x' || substr(h || '00', CAST(1 + (i * 5) // 4 AS INT), 2))::INT) // CAST(pow(2, 3 - (i * 5) % 4) AS INT)) % 32 AS INT), 1)),
    'string_agg', '') AS b32
  FROM p
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
