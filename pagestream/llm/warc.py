"""WARC archives: writing, normalising monolithic gzip, and reading back by offset.

``write_archives`` turns records into archives, each one gzip stream over all
its records (as some crawlers leave them).  ``normalise`` inflates such a
stream once, in pieces, rewrites every record as its own gzip member, and notes
(offset, length, record id, type, payload digest) of each in a sidecar index,
so that single records can be read without inflating the rest.  ``read_records``
reads the members back by their index.

An archive is a row (archive, content): the tables are written to the shared
folder by Spark, so any file system it knows will do, and real files come in
with ``spark.read.format("binaryFile")``.  Archives hold about
``ARCHIVE_BYTES`` of records, or one longer record.

Of records with equal payloads of at least ``least_bytes`` bytes the one with
the smallest id is the response; the others are revisits that name it and carry
no payload.  Smaller payloads are responses always.

Edge cases: a null payload is empty; a null url is written as "urn:none"; of
repeated rows with one id (equal payload) each refers to that id only if
another, smaller id has the payload, so they are responses alike; null ids
count as one id before all others; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R

ARCHIVE_BYTES = 8 << 20
#: Compressed bytes taken from a stream at once, and bytes taken out of it at once.
CHUNK, WINDOW = 1 << 16, 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_GZIP = 31  # zlib's window bits for gzip framing


def _header(kind: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _one_line(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text) or "urn:none"


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload, but its digest and length."""
    fields = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    return _header("response" if refers_to is None else "revisit", [*fields, ("Content-Type", "text/html; charset=utf-8")], len(payload)) + payload + b"\r\n\r\n"


class WarcError(ValueError):
    """A stream that isn't whole or well formed."""


class RecordReader:
    """Cuts an inflated byte stream, fed in pieces, into records (header fields, header and block as bytes)."""

    def __init__(self) -> None:
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += data
        while True:
            split = self.buffer.find(b"\r\n\r\n")
            if split < 0:
                return
            lines = bytes(self.buffer[:split]).decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise WarcError(f"not a record: {lines[0][:40]!r}")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            end = split + 4 + int(fields["content-length"])
            if len(self.buffer) < end + 4:
                return
            if self.buffer[end : end + 4] != b"\r\n\r\n":
                raise WarcError("a record isn't closed")
            whole = bytes(self.buffer[: end + 4])
            del self.buffer[: end + 4]
            fields["_block"] = str(split + 4)
            yield fields, whole

    def close(self) -> None:
        if self.buffer:
            raise WarcError(f"{len(self.buffer)} bytes after the last record")


def inflate(content: bytes) -> Iterator[bytes]:
    """The inflated stream in pieces; members may follow one another."""
    at = 0
    machine = zlib.decompressobj(_GZIP)
    while at < len(content) or machine.unconsumed_tail:
        data = machine.unconsumed_tail
        if not data:
            data = content[at : at + CHUNK]
            at += len(data)
        yield machine.decompress(data, WINDOW)
        if machine.eof:
            rest = machine.unused_data
            at -= len(rest)
            machine = zlib.decompressobj(_GZIP)
            if at >= len(content):
                return
    yield machine.flush()
    if not machine.eof:
        raise WarcError("the stream ends too early")


def member(data: bytes) -> bytes:
    machine = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    return machine.compress(data) + machine.flush()


def normalise_bytes(content: bytes) -> tuple[bytes, list[tuple[int, int, str, str]]]:
    """(archive with a member for each record, index of (offset, length, record id, type))."""
    out, index, reader = bytearray(), [], RecordReader()
    for piece in inflate(content):
        for fields, whole in reader.feed(piece):
            packed = member(whole)
            index.append((len(out), len(packed), fields["warc-record-id"], fields["warc-type"]))
            out += packed
    reader.close()
    return bytes(out), index


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id (null: NULL_ID), url, payload, payload_digest, refers_to."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(R.NULL_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    long_ = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "payload_digest")
    first = long_.groupBy(F.col("payload_digest").alias("_d")).agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).where("_first < _last")
    links = long_.join(first, F.col("payload_digest") == F.col("_d")).where("page_id > _first").select(F.col("page_id").alias("_p"), "_d", F.col("_first").alias("refers_to")).distinct()
    joined = rows.join(links, (F.col("page_id") == F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", "refers_to")


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, content: monolithic gzip streams of about ``archive_bytes`` inflated, or one longer record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, out, size = None, bytearray(), 0

        def close() -> pa.RecordBatch:
            whole = bytes(out) + machine.flush()
            name = hashlib.sha256(whole).hexdigest()[:24]
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"], pa.string()), pa.array([whole], pa.binary())], names=["archive", "content"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if machine is None:
                    machine = zlib.compressobj(1, zlib.DEFLATED, _GZIP)
                raw = record(*row)
                out += machine.compress(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
                    machine, out, size = None, bytearray(), 0
        if machine is not None:
            yield close()

    return R.map_arrow(records.select("page_id", "url", "payload", "payload_digest", "refers_to"), work, "archive string, content binary")


def normalise(archives: DataFrame) -> DataFrame:
    """archive, content (a member for each record), index: offset, length, record_id, record_type."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made, index = normalise_bytes(content)
                rows = [dict(zip(("offset", "length", "record_id", "record_type"), x, strict=True)) for x in index]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([made], pa.binary()), pa.array([rows], pa.list_(entry))], names=["archive", "content", "index"])

    return R.map_arrow(archives.select("archive", "content"), work, "archive string, content binary, index array<struct<offset: long, length: long, record_id: string, record_type: string>>")


def read_records(archives: DataFrame) -> DataFrame:
    """page_id, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to, archive, offset, length."""

    def page(field: str | None) -> int | None:
        return int(field.removeprefix("<urn:page:").removesuffix(">")) if field else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ("page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "archive", "offset", "length")
        for b in batches:
            for name, content, index in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = []
                for e in index or []:
                    raw = zlib.decompress(content[e["offset"] : e["offset"] + e["length"]], _GZIP)
                    (fields, whole), *more = RecordReader().feed(raw)
                    if more or fields["warc-record-id"] != e["record_id"]:
                        raise WarcError(f"{name}: the index doesn't fit at {e['offset']}")
                    response = fields["warc-type"] == "response"
                    payload = whole[int(fields["_block"]) : -4] if response else None
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if response and hashlib.sha256(payload).hexdigest() != digest:
                        raise WarcError(f"{name}: a payload differs from its digest at {e['offset']}")
                    rows.append((page(e["record_id"]), fields["warc-type"], payload, int(fields["warc-payload-length"]), digest, page(fields.get("warc-refers-to")), name, e["offset"], e["length"]))
                for lo in range(0, len(rows), 500):
                    columns = list(zip(*rows[lo : lo + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return R.map_arrow(archives.select("archive", "content", "index"), work, "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long")


def round_trip(pages: DataFrame, least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages, normalises the archives, and reads them back; see :func:`read_records`."""
    R.prepare(pages.sparkSession)
    written = R.stage(write_archives(with_revisits(pages, least_bytes), archive_bytes), "warc")
    return read_records(R.stage(normalise(written), "warc-members"))
