"""Token ids as length-delimited binary records, with an offset index beside each file.

A file is a row of frames, each of them

    uint64 length | uint32 masked CRC-32C of the length | payload | uint32 masked CRC-32C of the payload

all little-endian: the framing of TFRecord files, whose readers can open these.
A payload is the serialised sequence: int64 document id, uint8 1 if the id is
null, uint8 bytes of a token id (2 for vocabularies of up to 65,536 ids, else
4), uint16 zero, and the token ids.  Beside ``x.rec`` lies ``x.idx``: for each
record int64 document id, uint64 offset and uint64 length of its frame, so that
records can be fetched in any order.

:func:`write_records` sorts the documents by id over all files, encodes them in
the tasks and writes one file a task.  File names are new in every attempt of a
task, and only files whose task has ended are in the manifest (a Parquet table
that Spark commits), so that lost executors and repeated attempts leave nothing
in the result.  :func:`read_records` reads files front to back,
:func:`read_shuffled` fetches all records in a random order by their offsets.
Both check lengths and checksums and raise on any difference.

Files are opened by ``pyarrow.fs`` from the tasks: the folder has to be one
that it can resolve on all executors (a shared mount, HDFS, S3, GCS).

Edge cases: null and empty texts are the end id alone; a null id is kept as
null and comes first; rows of one id follow one another in an order given by
their text; equal rows are all kept; texts of any length are one record; extra
columns are ignored; an empty table has no files, and reads back as no rows.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R
from .packing import tokenizer

#: Bytes read or fetched at once.
READ_BYTES = 4 << 20
#: Stored bytes of documents for each file.
FILE_BYTES = 16 << 20
#: Lengths of frame parts: length and its checksum, payload's head, payload's checksum.
FRAME_HEAD, PAYLOAD_HEAD, FRAME_TAIL = 12, 12, 4
INDEX_ROW = 24
MANIFEST_SCHEMA = "file int, name string, records long, tokens long, bytes long"
RECORD_SCHEMA = "file int, start long, doc_id long, ids binary"

# --- CRC-32C, for many byte ranges at once ------------------------------------------------------------------------

_POLYNOMIAL, _MASK_DELTA, _BLOCK = 0x82F63B78, 0xA282EAD8, 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


@functools.lru_cache(maxsize=64)
def _zeros_table(level: int) -> np.ndarray:
    """4 x 256 words: what a state's bytes become after ``_BLOCK * 2**level`` zero bytes."""
    if level:
        half = _zeros_table(level - 1)
        return _advance(_advance_basis(half), half)
    state = _advance_basis(None)
    for _ in range(_BLOCK):
        state = _TABLE[state & 0xFF] ^ (state >> 8)
    return state


def _advance_basis(table: np.ndarray | None) -> np.ndarray:
    if table is not None:
        return table
    return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])


def _advance(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][state & 0xFF] ^ table[1][state >> 8 & 0xFF] ^ table[2][state >> 16 & 0xFF] ^ table[3][state >> 24]


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32C of ``data[start:end]`` for each pair; ranges have four bytes at least.

    The checksum is linear: leading zeros change nothing, so every range is
    padded in front to whole blocks, all blocks are folded side by side, and a
    block's state is carried to its range's end by tables for 2**k blocks.
    """
    n = end - start
    if not len(n):
        return np.zeros(0, np.uint32)
    blocks = -(-n // _BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    padded = np.zeros(total * _BLOCK, np.uint8)
    at = first[1:] * _BLOCK - n
    inside = np.repeat(at, n) + A.spread(n)
    padded[inside] = data[np.repeat(start, n) + A.spread(n)]
    for k in range(4):
        padded[at + k] ^= 0xFF  # the state starts with all bits set
    columns = np.ascontiguousarray(padded.reshape(total, _BLOCK).T)
    state = np.zeros(total, np.uint32)
    for c in columns:
        state = _TABLE[(state ^ c) & 0xFF] ^ (state >> 8)
    left = np.repeat(blocks, blocks) - 1 - A.spread(blocks)  # blocks that follow in the range
    level = 0
    while (left >> level).any():
        hit = np.flatnonzero(left >> level & 1)
        state[hit] = _advance(state[hit], _zeros_table(level))
        level += 1
    return ~np.bitwise_xor.reduceat(state, first[:-1])


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums are stored rotated and shifted, as checksums of data that holds checksums are weak."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)


# --- frames ---------------------------------------------------------------------------------------------------


def frames(doc: np.ndarray, null: np.ndarray, ids: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all frames, offsets of the frames)."""
    size = np.diff(offsets) * width + PAYLOAD_HEAD
    at = np.concatenate([[0], np.cumsum(size + FRAME_HEAD + FRAME_TAIL)])
    out = np.zeros(int(at[-1]), np.uint8)
    begin, n = at[:-1], len(doc)

    def put(where: np.ndarray, values: np.ndarray, kind: str) -> None:
        raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(n, -1)
        out[where[:, None] + np.arange(raw.shape[1])] = raw

    if not n:
        return out, at
    put(begin, size, "<u8")
    put(begin + 8, masked(crc32c(out, begin, begin + 8)), "<u4")
    body = begin + FRAME_HEAD
    put(body, doc, "<i8")
    put(body + 8, null, "u1")
    put(body + 9, np.full(n, width), "u1")
    run = np.diff(offsets) * width
    out[np.repeat(body + PAYLOAD_HEAD, run) + A.spread(run)] = ids.astype(f"<u{width}").view(np.uint8)
    put(body + size, masked(crc32c(out, body, body + size)), "<u4")
    return out, at


def unframe(data: np.ndarray, at: np.ndarray, where: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, null, ids as uint32, offsets) of whole frames that begin at ``at[:-1]``; raises on damage."""
    begin, n = at[:-1], len(at) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def get(start: np.ndarray, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.ascontiguousarray(data[start[:, None] + np.arange(width)]).view(kind).ravel()

    size = get(begin, "<u8").astype(np.int64)
    body = begin + FRAME_HEAD
    if (size + FRAME_HEAD + FRAME_TAIL != np.diff(at)).any() or (masked(crc32c(data, begin, begin + 8)) != get(begin + 8, "<u4")).any():
        raise ValueError(f"{where}: a record's length is damaged")
    if (masked(crc32c(data, body, body + size)) != get(body + size, "<u4")).any():
        raise ValueError(f"{where}: a record's payload is damaged")
    doc, null, width = get(body, "<i8"), get(body + 8, "u1") == 1, get(body + 9, "u1").astype(np.int64)
    if (width != width[0]).any() or width[0] not in (2, 4):
        raise ValueError(f"{where}: records of unknown width")
    run = size - PAYLOAD_HEAD
    flat = data[np.repeat(body + PAYLOAD_HEAD, run) + A.spread(run)].view(f"<u{width[0]}").astype(np.uint32)
    return doc, null, flat, np.concatenate([[0], np.cumsum(run // width[0])])


# --- files ------------------------------------------------------------------------------------------------------


def _open(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else os.path.abspath(folder))


def _records(rows: dict[str, list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in schema], names=[k for k, _ in schema])


MANIFEST = [("file", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Encode all texts, close each with ``end_id`` and write them in the order of doc_id; returns the manifest, in the order of files."""
    spark = docs.sparkSession
    R.prepare(spark)
    spark.sparkContext.addFile(tokenizer_path)
    model = os.path.basename(tokenizer_path)
    n = int(max(1, -(-R.plan_bytes(docs) // FILE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(F.coalesce(id_, F.lit(R.NULL_ID)).alias("doc_id"), id_.isNull().alias("none"), F.xxhash64(text).alias("turn"), F.spark_partition_id().alias("part"), text.alias("text"))
    # Null ids first; the text's hash and the split part the rows of one id, however many.
    order = ["doc_id", F.desc("none"), "turn"]
    spread = keyed.repartitionByRange(n, *order, "part").sortWithinPartitions(*order, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        name = f"part-{file:06d}-{uuid.uuid4().hex}"
        encoder, out, side, at, tokens, records = tokenizer(SparkFiles.get(model)), None, None, 0, 0, 0
        width = 2 if max(encoder.inner.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, root = _open(folder)
                fs.create_dir(root, recursive=True)
                out, side = fs.open_output_stream(f"{root}/{name}.rec"), fs.open_output_stream(f"{root}/{name}.idx")
            doc, null = b.column("doc_id").to_numpy(), b.column("none").to_numpy(zero_copy_only=False)
            _, where = A.strings(b.column("text"))
            for lo, hi in A.slices(where):
                ids, offsets, _ = encoder.encode(b.column("text").slice(lo, hi - lo), end_id)
                data, begin = frames(doc[lo:hi], null[lo:hi], ids, offsets, width)
                out.write(data.tobytes())
                rows = np.stack([doc[lo:hi], at + begin[:-1], np.diff(begin)], 1).astype("<i8")
                side.write(rows.tobytes())
                at, tokens, records = at + int(begin[-1]), tokens + len(ids), records + hi - lo
        if out is not None:
            out.close()
            side.close()
            yield _records({"file": [file], "name": [name], "records": [records], "tokens": [tokens], "bytes": [at]}, MANIFEST)

    R.map_arrow(spread.select("doc_id", "none", "text"), write, MANIFEST_SCHEMA).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file; ``start``: ids in all files before it.  (The window orders one row a file, not the records.)"""
    files = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/manifest")
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _batch(file: int, start: np.ndarray, doc: np.ndarray, null: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    body = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
    columns = [pa.array(np.full(len(doc), file, np.int32)), pa.array(start.astype(np.int64)), pa.array(doc, pa.int64(), mask=null), body.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "start", "doc_id", "ids"])


def _whole_frames(data: bytes) -> list[int]:
    """Offsets of the whole frames at the head of ``data``, and of what is left."""
    at, out = 0, [0]
    while at + FRAME_HEAD <= len(data):
        at += FRAME_HEAD + FRAME_TAIL + struct.unpack_from("<Q", data, at)[0]
        if at > len(data):
            break
        out.append(at)
    return out


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records: file, start (ids of all records before it), doc_id, ids (uint32, little-endian); a task reads files front to back."""
    R.prepare(spark)
    files = manifest(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            name, start, left, records, want = f"{root}/{row['name']}.rec", row["start"], b"", 0, READ_BYTES
            with fs.open_input_stream(name) as source:
                while got := source.read(want):
                    left += got
                    at = _whole_frames(left)
                    if len(at) == 1:  # a record longer than what was read: take more of it at a time
                        want *= 2
                        continue
                    doc, null, ids, offsets = unframe(np.frombuffer(left, np.uint8, at[-1]), np.array(at, np.int64), name)
                    yield _batch(row["file"], start + offsets[:-1], doc, null, ids, offsets)
                    start, records, left, want = start + len(ids), records + len(doc), left[at[-1] :], READ_BYTES
            if left or (records, start - row["start"]) != (row["records"], row["tokens"]):
                raise ValueError(f"{name}: the file is cut, or isn't the one of its manifest")

    tasks = max(1, files.count())
    return R.map_arrow(files.repartition(tasks, "file"), read, RECORD_SCHEMA)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """All records' places from the index files: file, name, record, doc_id, offset, length."""
    R.prepare(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            at = 0
            with fs.open_input_stream(f"{root}/{row['name']}.idx") as source:
                while got := source.read(INDEX_ROW << 16):
                    if len(got) % INDEX_ROW:
                        raise ValueError(f"{row['name']}.idx is cut")
                    rows = np.frombuffer(got, "<i8").reshape(-1, 3)
                    n = len(rows)
                    columns = [pa.array(np.full(n, row["file"], np.int32)), pa.array([row["name"]] * n, pa.string()), pa.array(at + np.arange(n))]
                    columns += [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "name", "record", "doc_id", "offset", "length"])
                    at += n
            if at != row["records"]:
                raise ValueError(f"{row['name']}.idx is cut")

    files = manifest(spark, folder)
    return R.map_arrow(files.repartition(max(1, files.count()), "file"), read, "file int, name string, record long, doc_id long, offset long, length long")


def read_shuffled(spark: SparkSession, folder: str, seed: int, tasks: int) -> DataFrame:
    """All records in a random order that ``seed`` gives: turn long, file, doc_id, ids; ``tasks`` partitions, one after the other in order.

    Only index rows are shuffled; records are fetched by offset, so that an
    epoch needs no copy of the data.
    """
    places = read_index(spark, folder).withColumn("turn", F.xxhash64(F.lit(seed), "file", "record"))
    dealt = places.repartitionByRange(tasks, "turn", "file", "record").sortWithinPartitions("turn", "file", "record")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for b in batches:
            rows = b.to_pandas()
            cut = (rows["length"].cumsum() // READ_BYTES).to_numpy()
            for lo, hi in R.runs(np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]])), len(rows)):
                part = rows.iloc[lo:hi]
                found: dict[int, bytes] = {}
                for name, of in part.sort_values(["name", "offset"]).groupby("name", sort=False):
                    with fs.open_input_file(f"{root}/{name}.rec") as source:
                        for k, offset, length in zip(of.index, of["offset"], of["length"], strict=True):
                            source.seek(int(offset))
                            found[k] = source.read(int(length))
                data = b"".join(found[k] for k in part.index)
                at = np.concatenate([[0], np.cumsum(part["length"].to_numpy())])
                doc, null, ids, offsets = unframe(np.frombuffer(data, np.uint8), at, folder)
                out = _batch(0, part["turn"].to_numpy(), doc, null, ids, offsets)
                yield pa.RecordBatch.from_arrays([out.column("start"), pa.array(part["file"].to_numpy(), pa.int32()), out.column("doc_id"), out.column("ids")], names=["turn", "file", "doc_id", "ids"])

    return R.map_arrow(dealt, fetch, "turn long, file int, doc_id long, ids binary")
