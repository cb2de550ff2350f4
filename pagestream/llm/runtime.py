"""Session helpers: shared staging tables, sizes, and packed exchanges by bucket."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestream.shipping import ship

#: Sorts before every real id; stands for a null id inside the operators.
NULL_ID = -(2**63)
#: Bytes of (stored) input for each bucket of a packed exchange.
BUCKET_BYTES = 8 << 20
#: Ids that may be broadcast: about 64 MB in a hashed relation. Beyond, tables meet in a shuffle.
BROADCAST_IDS = 1 << 21


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, keep Arrow batches small (documents may be long), and have shuffle files go with their query."""
    ship(spark)
    settings = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    for key, value in settings.items():
        with contextlib.suppress(Exception):
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share, from spark.checkpoint.dir; a local one only if that is unset and all runs in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"{tempfile.gettempdir()}/checkpoints"  # the setting itself can't be changed in a running session
    return where.rstrip("/")


#: Staged tables that still exist, and what removes them.
_STAGED: dict[str, SparkSession] = {}


def stage(df: DataFrame, label: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation.

    ``done``: staged tables that ``df`` was the last to read; they go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    drop(*done)
    # The plans of many small steps pile up in a driver of bounded memory until the finished ones are let go.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, for files that tasks write; it goes at the end of the application."""
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    _STAGED[path] = spark
    return path


def _delete(path: str) -> None:
    spark = _STAGED.pop(path, None)
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "staged_path", None):
            _delete(path)


@atexit.register
def _drop_all() -> None:
    for path in list(_STAGED):
        _delete(path)


def small_side(ids: DataFrame) -> DataFrame:
    """A staged table of ids, to be broadcast if its counted rows stay within ``BROADCAST_IDS``."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose id isn't in the staged table ``gone`` (gone_id; null ids: NULL_ID)."""
    gone = small_side(gone)
    return docs.join(gone, F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == gone["gone_id"], "left_anti")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for files, their size.  Where it has none, the texts are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    wide = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    total = df.select(F.sum(sum((F.coalesce(c, F.lit(0)) for c in wide), F.lit(16).cast("long")))).head()[0]
    return int(total or 0)


def bucket_count(df: DataFrame) -> int:
    """Buckets for a packed exchange: they grow with the input, so that one bucket stays bounded."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(1 << 20, max(least, plan_bytes(df) // BUCKET_BYTES)))


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id (null: NULL_ID) and the named columns only: clashing extra columns never reach an operator."""
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), *columns)


def plain_id(name: str = "doc_id"):
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


# --- packed exchange ---------------------------------------------------------------------------------------------
# A row holds many entries for one bucket as binary columns, so that the shuffle moves a few large rows.

SPAN_SCHEMA = "bucket int, places binary, size binary"
KEY_SCHEMA = "bucket int, k1 binary, k2 binary, known binary, places binary, side binary, side_size binary"


def small(values: np.ndarray) -> np.ndarray:
    """Unsigned values in the narrowest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _part(values: np.ndarray) -> bytes:
    values = small(values)
    return np.array([len(values), values.itemsize], np.int64).tobytes() + values.tobytes()


def _take(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = np.frombuffer(blob, np.int64, 2, at).tolist()
    at += 16
    return np.frombuffer(blob, f"u{width}", n, at).astype(np.int64), at + n * width


def pack_places(doc: np.ndarray, start: np.ndarray) -> bytes:
    """(doc, start) rows, documents as runs; compact if each document's rows are together."""
    if not len(doc):
        return b""
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ids = doc[at]
    base = int(ids.min())
    wide = int(ids.max()) - base >= 1 << 32
    head = np.array([wide, base, len(ids)], np.int64).tobytes()
    return head + (ids.tobytes() if wide else _part(ids - base)) + _part(np.diff(np.append(at, len(doc)))) + _part(start)


def places(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    docs, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in table.column(name).to_pylist():
        if not blob:
            continue
        wide, base, n = np.frombuffer(blob, np.int64, 3).tolist()
        if wide:
            ids, at = np.frombuffer(blob, np.int64, n, 24), 24 + 8 * n
        else:
            ids, at = _take(blob, 24)
            ids = ids + base
        runs_, at = _take(blob, at)
        start, _ = _take(blob, at)
        docs.append(np.repeat(ids, runs_))
        starts.append(start)
    return np.concatenate(docs), np.concatenate(starts)


def pack_docs(doc: np.ndarray) -> bytes:
    """Document numbers as runs."""
    return pack_places(doc, np.zeros(0, np.int64)) if len(doc) else b""


def docs_of(table: pa.Table, name: str) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for blob in table.column(name).to_pylist():
        if blob:
            wide, base, n = np.frombuffer(blob, np.int64, 3).tolist()
            ids, at = (np.frombuffer(blob, np.int64, n, 24), 24 + 8 * n) if wide else _take(blob, 24)
            out.append(np.repeat(ids if wide else ids + base, _take(blob, at)[0]))
    return np.concatenate(out)


def pack_sizes(size: np.ndarray) -> bytes:
    return _part(size) if len(size) else b""


def sizes(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_take(x, 0)[0] for x in table.column(name).to_pylist() if x)])


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    from .arrays import mix

    return (mix(doc.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % buckets


def runs(at: np.ndarray, n: int):
    """(start, end) of the runs that begin at ``at``; the last one ends at ``n``."""
    return zip(at, [*at[1:], n], strict=True) if len(at) else ()


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, row numbers in their old order)."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(bucket) else np.zeros(0, int)
    for lo, hi in runs(at, len(bucket)):
        yield int(sorted_[lo]), order[lo:hi]


def batch(rows: list[tuple], names: list[str], first: pa.DataType = pa.int32()) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], first), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)


def span_batches(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, buckets: int) -> pa.RecordBatch:
    from .arrays import merge_spans

    doc, start, stop = merge_spans(doc, start, stop)
    rows = [(b, pack_places(doc[i], start[i]), pack_sizes(stop[i] - start[i])) for b, i in by_bucket(doc_bucket(doc, buckets))]
    return batch(rows, ["bucket", "places", "size"])


def column(table: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in table.column(name).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def spans_of(rows: DataFrame) -> DataFrame:
    """Packed spans to one row per document: doc_id, spans (int32 start, stop pairs, maximal and sorted)."""

    def merge(table: pa.Table) -> pa.Table:
        from .arrays import merge_spans

        doc, start = places(table, "places")
        doc, start, stop = merge_spans(doc, start, start + sizes(table, "size"))
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
        pairs = np.stack([start, stop], 1).astype(np.int32) if len(doc) else np.zeros((0, 2), np.int32)
        return pa.table({"doc_id": pa.array(doc[at], pa.int64()), "spans": pa.array([pairs[a:b].tobytes() for a, b in runs(at, len(doc))], pa.binary())})

    return group_arrow(rows, merge, "doc_id long, spans binary")


def key_batch(k1: np.ndarray, k2: np.ndarray | None, doc: np.ndarray, start: np.ndarray, reach: tuple[int, int], buckets: int, later: bool) -> pa.RecordBatch:
    """Entries of one chunk with equal keys collapsed; an entry at ``start`` speaks for [start - reach[0], start + reach[1]).

    The first entry (by doc, start) of each key goes to the key's bucket.  The others are settled already
    (``later``: they start after it; else: they have a partner) and travel beside, dealt by document.
    """
    from .arrays import merge_spans

    columns = (start, doc, k1) if k2 is None else (start, doc, k2, k1)
    order = np.lexsort(columns)
    k1, doc, start = k1[order], doc[order], start[order]
    fresh = np.ones(len(k1), bool)
    fresh[1:] = k1[1:] != k1[:-1]
    if k2 is not None:
        k2 = k2[order]
        fresh[1:] |= k2[1:] != k2[:-1]
    at = np.flatnonzero(fresh)
    known = np.diff(np.append(at, len(k1))) > 1
    side = np.flatnonzero(~fresh)
    if later and len(side):  # equal (doc, start): a repeated row is no earlier place
        lead = at[np.cumsum(fresh) - 1][side]
        side = side[(doc[side] != doc[lead]) | (start[side] != start[lead])]
    sd, sa, sz = merge_spans(doc[side], np.maximum(start[side] - reach[0], 0), start[side] + reach[1])
    sides = dict(by_bucket(doc_bucket(sd, buckets)))
    turn = np.argsort(order[at], kind="stable")  # back to the order of the text: a document's entries together
    at, known = at[turn], known[turn]
    mains = dict(by_bucket((k1[at] >> np.uint64(40)).astype(np.int64) % buckets))
    none, rows = np.zeros(0, np.int64), []
    for b in sorted(sides.keys() | mains.keys()):
        i, s = mains.get(b, none), sides.get(b, none)
        m = at[i]
        if k2 is None:  # 40 bits beside the bucket's: a chance agreement only costs a second look
            first, second = k1[m].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), b""
        else:
            first, second = k1[m].tobytes(), k2[m].astype(np.uint32).tobytes()
        rows.append((b, first, second, np.packbits(known[i]).tobytes(), pack_places(doc[m], start[m]), pack_places(sd[s], sa[s]), pack_sizes(sz[s] - sa[s])))
    return batch(rows, ["bucket", "k1", "k2", "known", "places", "side", "side_size"])


def shared_spans(rows: DataFrame, reach: tuple[int, int], buckets: int, later: bool, wide: bool) -> DataFrame:
    """Spans of the entries whose key occurs elsewhere (``later``: occurs earlier), per document.  ``wide``: keys of 96 bits."""

    def settle(table: pa.Table) -> pa.Table:
        from .arrays import group_starts

        doc, start = places(table, "places")
        if wide:
            k1, k2 = column(table, "k1", np.uint64), column(table, "k2", np.uint32)
        else:
            packed = column(table, "k1", np.uint8).reshape(-1, 5)
            full = np.zeros((len(packed), 8), np.uint8)
            full[:, :5] = packed
            k1 = full.view(np.uint64).ravel()
            k2 = np.zeros(len(k1), np.uint32)
        order = np.lexsort((start, doc, k2, k1)) if wide else np.argsort(k1)
        fresh = group_starts(k1[order], k2[order])
        at = np.flatnonzero(fresh)
        of = np.cumsum(fresh) - 1
        if later:
            d, s = doc[order], start[order]
            lead = at[of]
            hit = (d != d[lead]) | (s != s[lead])
        else:
            bits = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(k) // 5] for x, k in zip(table.column("known").to_pylist(), table.column("k1").to_pylist(), strict=True)]
            known = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
            hit = (np.diff(np.append(at, len(order)))[of] > 1) | known[order]
        hit = order[hit]
        sd, sa = places(table, "side")
        spans = span_batches(np.concatenate([doc[hit], sd]), np.concatenate([np.maximum(start[hit] - reach[0], 0), sa]), np.concatenate([start[hit] + reach[1], sa + sizes(table, "side_size")]), buckets)
        return pa.Table.from_batches([spans])

    return spans_of(group_arrow(rows, settle, SPAN_SCHEMA))


def release() -> None:
    """Give freed memory back: workers live on between tasks and share their executor's limit."""
    gc.collect()
    with contextlib.suppress(Exception):
        pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def group_arrow(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each bucket of ``df``."""

    def whole(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            release()

    return df.groupBy("bucket").applyInArrow(whole, schema)
