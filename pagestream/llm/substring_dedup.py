"""Exact substring dedup over words, by difference-cover anchors.

A window is ``length`` consecutive words.  Positions p of a document with
``p mod PERIOD`` in COVER carry an anchor: the hash of the ``length - PERIOD + 1``
words there.  COVER is a perfect difference set, so for any two starts i and j
some shift below PERIOD puts both i + shift and j + shift on anchors; two equal
windows therefore share an aligned anchor inside them.  Anchors seen only once
in the corpus rule out all other windows.  Around the anchors that are left,
matches are extended to whole windows: these are hashed with 96 bits and all
but the first place of each are marked.

Edge cases: a null or blank text has no words; texts shorter than a window keep
all words; of repeated rows (same id and text) each gets the same verdict, as
equal (doc_id, start) is not earlier; null ids count as one id before all
others; ids are taken as unique per text; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R

PERIOD, COVER = 13, (0, 1, 3, 9)
#: An anchor at p speaks for the windows that start in [p - PERIOD + 1, p].
ANCHOR_REACH = (PERIOD - 1, 1)
#: Entries gathered by a task before a packed row goes out.
FLUSH = 600_000


class _Gather:
    """Collects arrays until enough are there to make packed rows."""

    def __init__(self, make):
        self.parts, self.n, self.make = [], 0, make

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(arrays[0]):
            self.parts.append(arrays)
            self.n += len(arrays[0])
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            whole = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.n = [], 0
            yield self.make(*whole)


def _anchors(length: int, buckets: int):
    size = length - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gather(lambda k, d, p: R.key_batch(k, None, d, p, ANCHOR_REACH, buckets, False))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = A.strings(b.column(1))
            for lo, hi in A.slices(offsets):
                text, where = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = A.words(text, where)
                n = np.diff(first)
                place = A.spread(n)
                doc = np.repeat(np.arange(lo, hi), n)
                left = np.repeat(n, n) - place
                at = np.flatnonzero(cover[place % PERIOD] & (left >= size) & (np.repeat(n, n) >= length))
                sums = A.prefix(A.word_hashes(text, starts, ends), 1)
                yield from out.add(A.ranged(sums, at, at + size, 1), ids[doc[at]], place[at])
        yield from out.flush()

    return work


def _windows(length: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gather(lambda k1, k2, d, p: R.key_batch(k1, k2, d, p, (0, length), buckets, True))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = A.strings(b.column(1))
            marks, where_marks = A.strings(b.column(2))
            for lo, hi in A.slices(offsets):
                text, where = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = A.words(text, where)
                n = np.diff(first)
                pairs = marks[where_marks[lo] : where_marks[hi]].view(np.int32).reshape(-1, 2).astype(np.int64)
                of = np.repeat(np.arange(hi - lo), np.diff(where_marks[lo : hi + 1]) // 8)
                keep = pairs[:, 0] <= n[of] - length
                a, z, of = pairs[keep, 0], pairs[keep, 1], of[keep]
                z = np.minimum(z, n[of] - length + 1)
                at = np.repeat(first[of] + a, z - a) + A.spread(z - a)
                hashes = A.word_hashes(text, starts, ends)
                one, two = A.prefix(hashes, 1), A.prefix(A.mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)), 2)
                yield from out.add(A.ranged(one, at, at + length, 1), A.ranged(two, at, at + length, 2), np.repeat(ids[lo + of], z - a), at - np.repeat(first[of], z - a))
        yield from out.flush()

    return work


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = A.strings(b.column(1))
        marks, where_marks = A.strings(b.column(2))
        n_words, n_removed, kept = [], [], []
        for lo, hi in A.slices(offsets):
            text, where = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = A.words(text, where)
            pairs = marks[where_marks[lo] : where_marks[hi]].view(np.int32).reshape(-1, 2).astype(np.int64)
            base = np.repeat(first[:-1], np.diff(where_marks[lo : hi + 1]) // 8)
            gone = A.covered(base + pairs[:, 0], base + pairs[:, 1], len(starts))
            stay = np.flatnonzero(~gone)
            # Kept words with one byte more each, which becomes the joining space.
            size = ends[stay] - starts[stay] + 1
            flat = np.repeat(starts[stay], size) + A.spread(size)
            body = np.append(text, np.uint8(32))[flat]
            close = np.cumsum(size)
            body[close - 1] = 32
            total = np.concatenate([[0], close])
            edge = total[np.searchsorted(stay, first)]
            raw = body.tobytes()
            kept += [raw[x : max(x, y - 1)].decode("utf-8", "replace") for x, y in zip(edge[:-1], edge[1:], strict=True)]
            n_words.append(np.diff(first))
            n_removed.append(np.diff(np.concatenate([[0], np.cumsum(gone)])[first]))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), cat(n_words), cat(n_removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def repeated_word_spans(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id (null: NULL_ID), spans: word ranges covered by a window that also starts earlier."""
    if length < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    R.prepare(docs.sparkSession)
    texts = R.keyed(docs, "text")
    buckets = R.bucket_count(texts)
    marked = R.stage(R.shared_spans(R.map_arrow(texts, _anchors(length, buckets), R.KEY_SCHEMA), ANCHOR_REACH, buckets, False, False), "anchors")
    near = texts.join(marked, "doc_id").select("doc_id", "text", "spans")
    return R.stage(R.shared_spans(R.map_arrow(near, _windows(length, buckets), R.KEY_SCHEMA), (0, length), buckets, True, True), "windows")


def substring_dedup(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by one space)."""
    spans = repeated_word_spans(docs, length)
    joined = R.keyed(docs, "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    out = R.map_arrow(joined, _kept, "doc_id long, n_words long, n_removed long, text string")
    return out.select(R.plain_id(), "n_words", "n_removed", F.col("text"))
