"""Legacy archive converter: ARC records become equivalent WARC records.

An ARC file starts with a version block (``filedesc://``) whose first line names the version and whose
last line names the header fields: five for version 1 (URL, IP-address, Archive-date, Content-type,
Archive-length), ten for version 2 (with Result-code, Checksum, Location, Offset, Filename). A record is
a header line, then as many bytes as its length says, then a line feed. The converter reads the version,
splits each header line by that version's fields, takes the declared length, and makes a WARC record:
identifier (a name-based UUID of URL, date and digest), ISO timestamp from the 14 digits, type,
payload digest, HTTP block.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page id stays a
response; the others become revisit records that refer to it and carry no payload. Digests are counted
by a partially aggregated maximum over the converted records, which are a table by then, and sent back to
them on (digest, length); payloads are not shuffled while the repeated digests are few.

A WARC file is a row of one gzip member for each record and ends with the record that brings it to
``file_bytes``, so it is read whole with bounded memory, and its records can be told apart without their
neighbours. Spark's text writer writes the files, so any file system that Spark reaches will do; the byte
that it adds to each, a zero, is padding that readers of gzip skip. Very long pages are records like others.

A null html is an empty payload, a null url ``unknown:``, a null page id an absent header (null again
on reading). Repeated rows are records of their own; of those with the largest page id all stay
responses. Empty tables give no archive and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, small_batches, small_side

FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
END = b"\r\n\r\n"


def arc_record(version: str, url: str, date: str, block: bytes, offset: int = 0) -> bytes:
    known = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": "pages.arc", "Archive-length": str(len(block))}
    return " ".join(known[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def arc_head(version: str, date: str) -> bytes:
    body = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n\n".encode()
    return f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


def read_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record after the version block."""
    fields = FIELDS["1"]
    while line := stream.readline():
        parts = line.decode("utf-8", "replace").split()
        if not parts:
            continue
        if parts[0].startswith("filedesc://"):
            body = stream.read(int(parts[-1])).decode("utf-8", "replace").splitlines()
            version = body[0].split()[0]
            fields = body[1].split() if len(body) > 1 and body[1].strip() else FIELDS[version]
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} header values for {len(fields)} fields")
        head = dict(zip(fields, parts, strict=True))
        block = stream.read(int(head["Archive-length"]))
        if len(block) != int(head["Archive-length"]):
            raise ValueError("the archive ends inside a record")
        yield head, block


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(END)
    pairs = (x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {p[0]: p[1] for p in pairs if len(p) == 2}, payload


def from_arc(head: dict[str, str], block: bytes) -> dict:
    """What the WARC record needs, synthesised from an ARC header and block."""
    http, payload = http_payload(block)
    d, digest = head["Archive-date"], hashlib.sha1(payload)
    return {
        "page_id": int(http["X-Page-Id"]) if "X-Page-Id" in http else None,
        "uri": head["URL"],
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{head['URL']} {d} {http.get('X-Page-Id')} {digest.hexdigest()}")),
        "digest": digest.hexdigest(),
        "size": len(payload),
        "payload": payload,
    }


RECORD = [("page_id", pa.int64(), "long"), ("uri", pa.string(), "string"), ("date", pa.string(), "string"), ("record_id", pa.string(), "string"), ("digest", pa.string(), "string"), ("size", pa.int64(), "long"), ("payload", pa.binary(), "binary")]


def pages_as_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "19970101000000", records: int = 64) -> DataFrame:
    """``content``: ARC files of at most ``records`` records, versions 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for b in batches:
            for at in range(0, b.num_rows, records):
                version, part = str(1 + nth % 2), b.slice(at, records)
                nth += 1
                out = io.BytesIO()
                out.write(arc_head(version, date))
                for i, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = "" if i is None else f"X-Page-Id: {i}\r\n"
                    block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n".encode() + (html or b"")
                    out.write(arc_record(version, quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "unknown:", date, block, out.tell()))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["content"])

    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long"), url_col, F.col(html_col).cast("binary")).mapInArrow(run, "content binary")


def convert(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """One row for each record of ARC files, with its WARC fields."""

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind, _ in RECORD], [n for n, _, _ in RECORD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[dict] = []
                for head, block in read_arc(io.BytesIO(content.as_py())):
                    rows.append(from_arc(head, block))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return arcs.select(content_col).mapInArrow(run, ", ".join(f"{n} {sql}" for n, _, sql in RECORD))


def warc_record(r: dict) -> bytes:
    """A record's header, block and closing line breaks."""
    own = "" if r["page_id"] is None else f"X-Page-Id: {r['page_id']}\r\n"
    block = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n".encode() + (r["payload"] or b"")
    head = {
        "WARC-Type": "revisit" if r["refers_id"] else "response", "WARC-Record-ID": f"<urn:uuid:{r['record_id']}>", "WARC-Date": r["date"],
        "WARC-Target-URI": r["uri"], "WARC-Payload-Digest": f"sha1:{r['digest']}", "X-Payload-Length": r["size"],
    }
    if r["refers_id"]:
        head |= {"WARC-Refers-To": f"<urn:uuid:{r['refers_id']}>", "X-Refers-To-Page": r["refers_page"], "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head.items()), b"\r\n", block, END])


def with_revisits(records: DataFrame, least: int = 1000) -> DataFrame:
    """Add ``refers_page`` and ``refers_id``, the response that a revisit stands for, else null; revisits lose their payload."""
    large = records.select("digest", "size", "page_id", "record_id").where(F.col("size") >= least)
    kept = large.groupBy("digest", "size").agg(F.max_by("record_id", "page_id").alias("first_id"), F.max("page_id").alias("first_page"), F.count("*").alias("times"))
    kept = small_side(materialise(kept.where("times > 1").select(F.col("digest").alias("kd"), F.col("size").alias("ks"), "first_id", "first_page"), "repeated"))
    joined = records.join(kept, (F.col("digest") == F.col("kd")) & (F.col("size") == F.col("ks")), "left")
    repeat = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    columns = [c for c in records.columns if c != "payload"]
    return joined.select(*columns, F.when(~repeat, F.col("payload")).alias("payload"), F.when(repeat, F.col("first_page")).alias("refers_page"), F.when(repeat, F.col("first_id")).alias("refers_id"))


def write(records: DataFrame, path: str, file_bytes: int = 16 << 20) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0
        for b in batches:
            for r in b.to_pylist():
                members.append(gzip.compress(warc_record(r), 4, mtime=0))
                size += len(members[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["content"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["content"])

    small_batches(records.sparkSession)
    files = records.mapInArrow(run, "content binary").select(F.col("content").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every WARC record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while line := stream.readline().strip():
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]):
            raise ValueError("the archive ends inside a record")
        yield head, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives: id, type, full payload's size and digest, reference."""
    kinds = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def row(head: dict[str, str], block: bytes) -> dict:
        http, payload = http_payload(block)
        size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError("a payload differs from its digest")
        refers = head.get("X-Refers-To-Page")
        return {"page_id": int(http["X-Page-Id"]) if "X-Page-Id" in http else None, "uri": unquote(head["WARC-Target-URI"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(refers) if refers else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[dict] = []
                for head, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(row(head, block))
                    if len(rows) == 1024:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Convert pages from ARC to WARC, write the archives and read them back."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "warc")
    records = materialise(convert(pages_as_arc(pages, id_col, url_col, html_col)), "records")
    write(with_revisits(records, least), path)
    return read(spark, path)
