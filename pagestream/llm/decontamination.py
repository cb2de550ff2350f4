"""Benchmark decontamination with suffix arrays over the training text.

Each task cuts its documents into shards and builds a suffix array of each
shard's words; every test suffix (a window of ``window`` words, or a whole
shorter item) is binary-searched in every shard.  Suffixes whose first two
words begin no test window can't match and are left out of the arrays.  The
ranges found give all places; matches on the same diagonal join to the longest
verbatim matches.  A document never leaves its task, so nothing is shuffled.

The benchmark is sent to all tasks in blocks of at most ``BLOCK_BYTES`` of
text; with several blocks the reports of each document are merged.

Edge cases: a null or wordless document has no words, no hits; an item without
words never matches; items may share an id (they count once); a null item_id
counts as the empty id; repeated document rows are each reported; an empty
benchmark leaves all documents clean; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R

BLOCK_BYTES = 8 << 20
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word codes in one 64-bit column of a suffix.
CODE_BITS, CODES = 21, 3
REPORT_SCHEMA = "doc_id long, n_words long, spans binary, items array<string>, longest long"


class TestWindows:
    """The distinct windows of some items: word codes, lengths, and their places in the items."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        self.ids = [i for i, _ in items]
        data, offsets = A.strings(pa.array([t for _, t in items], pa.large_string()))
        data = _LOWER[data]
        starts, ends, first = A.words(data, offsets, SEPARATORS)
        hashes = A.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(hashes)
        if len(self.vocabulary) >= (1 << CODE_BITS) - 1:
            raise ValueError("a block of items holds too many different words")
        codes = np.searchsorted(self.vocabulary, hashes) + 1
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        item, place = np.repeat(np.arange(len(items)), count), A.spread(count)
        size = np.minimum(n[item], window)
        columns = _columns(codes, first[item] + place, size, window)
        order = np.lexsort((size, *columns[::-1]))
        fresh = A.group_starts(size[order], *(c[order] for c in columns))
        lead = order[fresh]
        self.columns, self.size = [c[lead] for c in columns], size[lead]
        self.place_window = (np.cumsum(fresh) - 1).astype(np.int64)
        self.place_item, self.place_at = item[order], place[order]
        self.place_first = np.append(np.flatnonzero(fresh), len(order))
        heads = self.columns[0] >> np.uint64(CODE_BITS * (CODES - 2))
        self.pairs = np.unique(heads[self.size > 1])
        self.singles = np.unique(heads[self.size == 1] >> np.uint64(CODE_BITS))

    def _suffixes(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Places at which a test window may begin."""
        at = np.flatnonzero(codes > 0)
        after = np.append(codes, 0)[at + 1] * (left[at] > 1)
        pair = codes[at].astype(np.uint64) << np.uint64(CODE_BITS) | after.astype(np.uint64)
        return at[_in(pair, self.pairs) | _in(codes[at].astype(np.uint64), self.singles)]

    def search(self, hashes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of all occurrences in a shard; ``left``: words from each place to its document's end."""
        if not len(self.vocabulary) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[found] == hashes, found + 1, 0)
        at = self._suffixes(codes, left)
        columns = _columns(codes, at, np.minimum(left[at], self.window), self.window)
        order = np.lexsort(columns[::-1])
        at, columns = at[order], [c[order] for c in columns]
        low = _bound(columns, self.columns)
        high = _bound(columns, _ceiling(self.columns, self.size))
        n = high - low
        return np.repeat(np.arange(len(n)), n), at[np.repeat(low, n) + A.spread(n)]


def _in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _columns(codes: np.ndarray, at: np.ndarray, size: np.ndarray, window: int) -> list[np.ndarray]:
    """The first ``size`` codes from each place, then zeros, packed into 64-bit columns of the whole window."""
    padded = np.concatenate([codes, np.zeros(window + CODES, codes.dtype)])
    out = []
    for k in range(0, window, CODES):
        c = np.zeros(len(at), np.uint64)
        for j in range(k, k + CODES):
            c = c << np.uint64(CODE_BITS) | np.where(j < size, padded[at + j], 0).astype(np.uint64)
        out.append(c)
    return out


def _ceiling(columns: list[np.ndarray], size: np.ndarray) -> list[np.ndarray]:
    """Above everything that begins with each window."""
    top, out = np.uint64((1 << CODE_BITS) - 1), []
    for k, c in enumerate(columns):
        for j in range(CODES):
            shift = np.uint64(CODE_BITS * (CODES - 1 - j))
            c = np.where(k * CODES + j >= size, c | top << shift, c)
        out.append(c)
    return out


def _bound(columns: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """For each wanted row the number of (sorted) rows below it, by binary search."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(columns[0]))
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        below, equal = np.zeros(len(live), bool), np.ones(len(live), bool)
        for c, w in zip(columns, wanted, strict=True):
            below |= equal & (c[mid] < w[live])
            equal &= c[mid] == w[live]
        low[live] = np.where(below, mid + 1, low[live])
        high[live] = np.where(below, high[live], mid)
    return low


def _shard(test: TestWindows, text: np.ndarray, where: np.ndarray):
    """Per document of a shard: words, hit spans, items and the longest match."""
    docs = len(where) - 1
    text = _LOWER[text]
    starts, ends, first = A.words(text, where, SEPARATORS)
    n = np.diff(first)
    place = A.spread(n)
    hashes = A.word_hashes(text, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    window, at = test.search(hashes, np.repeat(n, n) - place)
    doc = np.searchsorted(first, at, "right") - 1
    d, a, z = A.merge_spans(doc, at - first[doc], at - first[doc] + test.size[window])
    spans = np.split(np.stack([a, z], 1).astype(np.int32), np.searchsorted(d, np.arange(1, docs))) if docs else []
    # All places of the windows found, in the items: equal diagonals of one item and document join.
    count = np.diff(test.place_first)[window] if len(window) else window
    to = np.repeat(test.place_first[window], count) + A.spread(count)
    item, of = test.place_item[to], np.repeat(doc, count)
    row, size = np.repeat(at, count), np.repeat(test.size[window], count)
    diagonal = row - test.place_at[to]
    order = np.lexsort((row, diagonal, item, of))
    fresh = A.group_starts(of[order], item[order], diagonal[order] )
    fresh[1:] |= row[order][1:] != row[order][:-1] + 1
    edge = np.flatnonzero(fresh)
    length = np.diff(np.append(edge, len(order))) - 1 + size[order][edge]
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, of[order][edge], length)
    pair = np.unique(np.stack([of, item], 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
    items = [[test.ids[i] for i in x] for x in np.split(pair[:, 1], np.searchsorted(pair[:, 0], np.arange(1, docs)))] if docs else []
    return n, spans, items, longest


def _report(test: TestWindows):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.strings(b.column(1))
            words, spans, items, longest = [np.zeros(0, np.int64)], [], [], [np.zeros(0, np.int64)]
            for lo, hi in A.slices(offsets):
                n, s, i, best = _shard(test, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                words.append(n)
                spans += [x.tobytes() for x in s]
                items += i
                longest.append(best)
            beside = {"row": b.column("row")} if "row" in b.schema.names else {}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(words), pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(np.concatenate(longest), pa.int64()), *beside.values()], names=["doc_id", "n_words", "spans", "items", "longest", *beside])

    return work


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    items, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        items.append((r.i, r.t))
        size += len(r.t.encode())
        if size >= BLOCK_BYTES:
            yield items
            items, size = [], 0
    yield items


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
        hit, number, digest, lists = [], [], [], []
        for spans, ids in zip(parts, items, strict=True):
            pairs = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
            _, a, z = A.merge_spans(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
            ids = sorted({x for y in ids for x in y})
            hit.append(int((z - a).sum()))
            number.append(len(ids))
            digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            lists.append(ids)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string()), pa.array(lists, pa.list_(pa.string())), b.column("longest")], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "items", "longest"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, items, longest (words of the longest verbatim match), contaminated."""
    R.prepare(docs.sparkSession)
    texts = R.keyed(docs, "text")
    marked = R.keyed(docs, "text", F.xxhash64("text").alias("row"))
    parts: list[DataFrame] = []
    for k, items in enumerate(blocks := list(_blocks(benchmark)) if R.plan_bytes(benchmark) <= BLOCK_BYTES else _blocks(benchmark)):
        if isinstance(blocks, list) and len(blocks) == 1:
            parts.append(R.map_arrow(texts, _report(TestWindows(items, window)), REPORT_SCHEMA))
        else:
            parts.append(R.stage(R.map_arrow(marked, _report(TestWindows(items, window)), f"{REPORT_SCHEMA}, row long"), f"block{k}"))
    if len(parts) == 1:
        whole = parts[0].select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"), "longest")
    else:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        # Rows of one id are told apart by their text, whatever order the blocks read them in; equal rows come out as often as they went in.
        copies = (F.count("*") / len(parts)).cast("int").alias("copies")
        whole = whole.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"), F.max("longest").alias("longest"), copies)
        whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("row", "copies", "copy")
    out = R.map_arrow(whole, _finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, longest long")
    return out.select(R.plain_id(), "n_words", "n_hit", "n_items", "items_sha256", "items", "longest", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents (all columns) without those that hold a test window."""
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.coalesce("doc_id", F.lit(R.NULL_ID)).alias("gone_id")).distinct()
    return R.without(docs, R.stage(bad, "contaminated"))
