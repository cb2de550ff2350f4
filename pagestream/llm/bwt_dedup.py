"""Exact dedup of long byte strings with run-compressed Burrows-Wheeler indexes.

A window is ``length`` consecutive bytes of one document.  It goes by its
minimizer: the k-gram in it with the least hash (the leftmost such).  Equal
windows have equal minimizers, so only windows with a minimizer that occurs
twice in the corpus can repeat.  Neighbouring windows with the same minimizer
form one segment; segments are dealt by minimizer, so that all places of a
window meet in one bucket, whatever documents they come from.

In a bucket, equal segments are collapsed onto their first place, and a
run-length compressed BWT is built over the rest, with the text positions of
all run starts and run ends as samples.  At a run start the sampled
predecessor and the matching length are known; inside runs both follow from
the text position before, so the matching statistics of all positions are
streamed from the samples alone.  Positions whose match reaches ``length``
chain equal windows; in each chain all but the first place are marked.

Edge cases: a null text is empty; texts below ``length`` bytes are kept; of
repeated rows (same id and text) each gets the same verdict; null ids count as
one id before all others; extra columns are ignored; an empty table gives no
rows.  A long document is handled in overlapping blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R

#: Long enough that equal grams by chance, whose number grows with the square of the corpus, hardly count beside true repeats.
GRAM = 48
POS_MASK = np.uint64((1 << 22) - 1)
#: Bytes of segments in one index; a minimizer's segments stay together.
INDEX_BYTES = 1 << 20
FLUSH_BYTES = 12 << 20
SEGMENT_SCHEMA = "bucket int, gram binary, c1 binary, c2 binary, places binary, size binary, body binary, side binary, side_size binary"


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if width > have else v


def _blocks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last + 1, first byte, last + 1); a long document comes in blocks that share length - 1 bytes."""
    for lo, hi in A.slices(offsets):
        a, z = int(offsets[lo]), int(offsets[hi])
        while z - a > 2 * A.SLICE_BYTES:
            yield lo, hi, a, a + A.SLICE_BYTES + length - 1
            a += A.SLICE_BYTES
        yield lo, hi, a, z


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """For each block: its bytes, prefix sums, gram hashes, and the segments' (document, byte of document, gram place, start, stop) in the block."""
    for lo, hi, a, z in _blocks(offsets, length):
        n = z - a
        if n < length:
            continue
        text = data[a:z]
        sums = A.byte_sums(text)
        grams = A.mix((sums[GRAM:] - sums[:-GRAM]) * A.powers(0, n + 1, True)[: n - GRAM + 1])
        place = np.arange(n - GRAM + 1, dtype=np.uint64)
        least = (sliding_min((grams & ~POS_MASK) | place, length - GRAM + 1) & POS_MASK).astype(np.int64)
        ends = np.clip(offsets[lo + 1 : hi + 1] - a, 0, n)
        begins = np.clip(offsets[lo:hi] - a, 0, n)
        windows = np.maximum(ends - begins - length + 1, 0)
        doc = np.repeat(np.arange(lo, hi), windows)
        at = np.repeat(begins, windows) + A.spread(windows)
        if not len(at):
            continue
        gram = least[at]
        fresh = A.group_starts(gram, doc)
        first = np.flatnonzero(fresh)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        yield text, sums, grams, doc[first], a - offsets[doc[first]], gram[first], at[first], at[last] + length


def _minimizers(length: int, buckets: int):
    from .substring_dedup import _Gather

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gather(lambda k, d, p: R.key_batch(k, None, d, p, (0, 1), buckets, False))
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = A.strings(b.column(1))
            for _, _, grams, doc, shift, gram, _, _ in segments(data, offsets, length):
                yield from out.add(grams[gram], ids[doc], gram + shift)
        yield from out.flush()

    return work


def _pack_segments(gram, c1, c2, doc, start, size, body, buckets: int) -> pa.RecordBatch:
    order = np.lexsort((start, doc, c2, c1))
    fresh = A.group_starts(c1[order], c2[order])
    lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    side = (doc[order] != doc[lead]) | (start[order] != start[lead])
    side, keep = order[~fresh & side], order[fresh]
    at = np.concatenate([[0], np.cumsum(size)])
    sd, sa, sz = A.merge_spans(doc[side], start[side], start[side] + size[side])
    sides = dict(R.by_bucket(R.doc_bucket(sd, buckets)))
    keep = np.sort(keep)  # in the order of the text
    mains = {b: keep[i] for b, i in R.by_bucket((gram[keep] >> np.uint64(40)).astype(np.int64) % buckets)}
    rows, none = [], np.zeros(0, np.int64)
    for b in sorted(sides.keys() | mains.keys()):
        m, s = mains.get(b, none), sides.get(b, none)
        flat = np.repeat(at[m], size[m]) + A.spread(size[m])
        rows.append((b, gram[m].tobytes(), c1[m].tobytes(), c2[m].astype(np.uint32).tobytes(), R.pack_places(doc[m], start[m]), R.pack_sizes(size[m]), body[flat].tobytes(), R.pack_places(sd[s], sa[s]), R.pack_sizes(sz[s] - sa[s])))
    return R.batch(rows, ["bucket", "gram", "c1", "c2", "places", "size", "body", "side", "side_size"])


def _segments(length: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = A.strings(b.column(1))
            marks, where = A.strings(b.column(2))
            pairs = marks.view(np.int32).reshape(-1, 2).astype(np.int64)
            base = np.repeat(offsets[:-1], np.diff(where) // 8)
            marked = A.covered(base + pairs[:, 0], base + pairs[:, 1], len(data))
            for text, sums, grams, doc, shift, gram, start, stop in segments(data, offsets, length):
                hit = np.flatnonzero(marked[offsets[doc] + shift + gram])
                if not len(hit):
                    continue
                doc, shift, gram, start, stop = doc[hit], shift[hit], gram[hit], start[hit], stop[hit]
                more = A.byte_sums(text ^ np.uint8(0x5A), 3)
                size = stop - start
                body = text[np.repeat(start, size) + A.spread(size)]
                parts.append((grams[gram], A.ranged(sums, start, stop, 0), A.ranged(more, start, stop, 3), ids[doc], start + shift, size, body))
                held += len(body)
                if held >= FLUSH_BYTES:
                    yield _pack_segments(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets)
                    parts, held = [], 0
        if parts:
            yield _pack_segments(*(np.concatenate(x) for x in zip(*parts, strict=True)), buckets)

    return work


class RunIndex:
    """Run-length compressed BWT of strings, with text positions sampled at run starts and run ends.

    ``body`` holds the strings one after the other, ``size`` their lengths.
    ``heads`` and ``runs`` are the BWT's run symbols (0: a string's start) and
    run starts; ``start_at`` and ``end_at`` are the samples.
    """

    def __init__(self, body: np.ndarray, size: np.ndarray):
        m, n = len(size), len(body) + len(size)
        self.symbols = np.zeros(n, np.uint16)
        inside = np.ones(n, bool)
        inside[np.cumsum(size + 1) - 1] = False
        self.symbols[inside] = body.astype(np.uint16) + 1
        self.left = np.repeat(np.cumsum(size + 1), size + 1) - np.arange(n) - 1  # bytes to the string's end
        self.string = np.repeat(np.arange(m), size + 1)
        suffixes = self._sort()
        before = self.symbols[suffixes - 1]
        fresh = np.ones(n, bool)
        fresh[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        at = np.flatnonzero(fresh)
        self.heads, self.runs = before[at], at
        self.start_at = suffixes[at]
        self.end_at = suffixes[np.concatenate([at[1:], [n]]) - 1]

    def _packed(self, count: int) -> np.ndarray:
        """The first ``count`` (at most 7) symbols of each suffix as one number; what follows a string's end counts as 0."""
        out = np.zeros(len(self.symbols), np.uint64)
        for k in range(count):
            out <<= np.uint64(9)
            out[: len(out) - k or None] |= np.where(self.left[: len(out) - k or None] >= k, self.symbols[k:], 0).astype(np.uint64)
        return out

    def _sort(self) -> np.ndarray:
        """Suffix array by prefix doubling; suffixes that reach their string's end differ there, by string."""
        n, depth = len(self.symbols), 7
        key = self._packed(depth)
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (sorted_[1:] != sorted_[:-1]) | (self.left[order][1:] < depth)
        while True:
            at = np.flatnonzero(fresh)
            rank = np.empty(n, np.int64)
            rank[order] = at[np.cumsum(fresh) - 1]
            size = np.diff(np.concatenate([at, [n]]))
            open_ = np.repeat(size > 1, size)
            todo = np.flatnonzero(open_)
            if not len(todo):
                return order
            i = order[todo]
            key = rank[i].astype(np.uint64) * np.uint64(n + 1) + rank[np.minimum(i + depth, n - 1)].astype(np.uint64)
            turn = np.argsort(key, kind="stable")
            order[todo] = i[turn]
            key = key[turn]
            new = np.ones(len(todo), bool)
            new[1:] = (key[1:] != key[:-1]) | (todo[1:] != todo[:-1] + 1)
            fresh[todo] |= new
            depth *= 2

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(match, length) for each text position: its predecessor among the suffixes and the common bytes, streamed from the run samples."""
        n = len(self.symbols)
        here, there = self.start_at[1:], self.end_at[:-1]
        most = np.minimum(self.left[here], self.left[there])
        common = np.zeros(len(here), np.int64)
        packed = self._packed(7)
        live = np.flatnonzero(most > 0)
        while len(live):
            same = packed[here[live] + common[live]] == packed[there[live] + common[live]]
            for k in range(7):  # the last few symbols one by one
                slow = live[~same]
                if k == 0:
                    tail = slow
                go = tail[(common[tail] < most[tail])]
                go = go[self.symbols[here[go] + common[go]] == self.symbols[there[go] + common[go]]] if len(go) else go
                common[go] += 1
                tail = go
            fast = live[same]
            common[fast] += 7
            live = fast[common[fast] < most[fast]]
        common = np.minimum(common, most)
        order = np.argsort(here)
        here, there, common = here[order], there[order], common[order]
        last = np.searchsorted(here, np.arange(n), "right") - 1
        ok = last >= 0
        step = np.arange(n) - here[np.maximum(last, 0)]
        length = np.where(ok, np.maximum(common[np.maximum(last, 0)] - step, 0), 0)
        match = np.where(length > 0, there[np.maximum(last, 0)] + step, -1)
        return match, length


def repeats(body: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows that occur at an earlier (doc, start) too; strings are distinct and given by place."""
    index = RunIndex(body, size)
    match, common = index.statistics()
    chain = np.arange(len(match))
    linked = (common >= length) & (index.left >= length)
    chain[linked] = match[linked]
    while True:
        up = chain[chain]
        if np.array_equal(up, chain):
            break
        chain = up
    heads = np.unique(chain[linked])
    at = np.concatenate([np.flatnonzero(linked), heads])
    offset = at - (np.cumsum(size + 1) - size - 1)[index.string[at]]
    where, root, of = start[index.string[at]] + offset, chain[at], doc[index.string[at]]
    order = np.lexsort((where, of, root))
    root, of, where = root[order], of[order], where[order]
    fresh = A.group_starts(root)
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(root) else np.zeros(0, int)
    later = (of != of[lead]) | (where != where[lead])
    return of[later], where[later]


def _mark(length: int, buckets: int):
    def settle(table: pa.Table) -> pa.Table:
        gram, c1, c2 = R.column(table, "gram", np.uint64), R.column(table, "c1", np.uint64), R.column(table, "c2", np.uint32)
        doc, start = R.places(table, "places")
        size, body = R.sizes(table, "size"), R.column(table, "body", np.uint8)
        side, at = R.places(table, "side")
        spans = [(side, at, at + R.sizes(table, "side_size"))]
        at = np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((start, doc, c2, c1))
        fresh = A.group_starts(c1[order], c2[order])
        lead = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else order
        later = order[~fresh & ((doc[order] != doc[lead]) | (start[order] != start[lead]))]
        spans.append((doc[later], start[later], start[later] + size[later]))
        keep = order[fresh]
        keep = keep[np.lexsort((start[keep], doc[keep], gram[keep]))]
        fresh = A.group_starts(gram[keep])
        edge = np.flatnonzero(fresh)
        count = np.diff(np.concatenate([edge, [len(keep)]]))
        keep = keep[np.repeat(count > 1, count)]  # one distinct string alone repeats nowhere
        edge = np.append(np.flatnonzero(A.group_starts(gram[keep])), len(keep))
        total = np.concatenate([[0], np.cumsum(size[keep])])
        lo = 0
        while lo < len(edge) - 1:
            hi = max(lo + 1, int(np.searchsorted(total[edge], total[edge[lo]] + INDEX_BYTES, "right")) - 1)
            part = keep[edge[lo] : edge[hi]]
            flat = np.repeat(at[part], size[part]) + A.spread(size[part])
            d, s = repeats(body[flat], size[part], doc[part], start[part], length)
            spans.append(A.merge_spans(d, s, s + length))
            lo = hi
        d, s, e = (np.concatenate([np.asarray(x[k]).astype(np.int64) for x in spans]) for k in range(3))
        return pa.Table.from_batches([R.span_batches(d, s, e, buckets)])

    return settle


def repeated_byte_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id (null: NULL_ID), spans: byte ranges covered by a string of ``length`` bytes that also starts earlier."""
    if not GRAM <= length <= 180:
        raise ValueError(f"length has to be between {GRAM} and 180 bytes")
    R.prepare(docs.sparkSession)
    texts = R.keyed(docs, "text")
    buckets = R.bucket_count(texts)
    marked = R.stage(R.shared_spans(R.map_arrow(texts, _minimizers(length, buckets), R.KEY_SCHEMA), (0, 1), buckets, False, False), "minimizers")
    near = texts.join(marked, "doc_id").select("doc_id", "text", "spans")
    # Segments carry their bytes: buckets of half the size.
    rows = R.map_arrow(near, _segments(length, 2 * buckets), SEGMENT_SCHEMA)
    return R.stage(R.spans_of(R.group_arrow(rows, _mark(length, buckets), R.SPAN_SCHEMA)), "repeats", (marked,))


def _cut(text: pa.Array, spans: pa.Array, whole_characters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(bytes, removed bytes, removed spans, what is kept) of each text."""
    data, offsets = A.strings(text)
    marks, where = A.strings(spans)
    pairs = marks.view(np.int32).reshape(-1, 2).astype(np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(where) // 8)
    a, z = offsets[of] + pairs[:, 0], offsets[of] + pairs[:, 1]
    if whole_characters:  # a removed run keeps the parts of characters at its ends
        inner = lambda x: (x < offsets[of + 1]) & ((np.append(data, np.uint8(0))[np.minimum(x, len(data))] & 0xC0) == 0x80)
        for _ in range(3):
            a = np.where((a < z) & inner(a), a + 1, a)
            z = np.where((a < z) & inner(z), z - 1, z)
    gone = A.covered(a, z, len(data))
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = pa.Array.from_buffers(pa.large_binary(), len(left) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
    n = np.diff(offsets)
    return n, n - np.diff(left), np.diff(where) // 8, kept


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, kept = _cut(b.column(1), b.column(2), False)
            whole = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), whole(n), whole(removed), whole(spans), kept.cast(pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = R.keyed(docs, "text").join(repeated_byte_spans(docs, length), "doc_id", "left").select("doc_id", "text", "spans")
    out = R.map_arrow(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(R.plain_id(), "n_bytes", "n_removed", "n_spans", "kept")


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The documents (all columns) without repeated byte strings; characters stay whole, and a text of which nothing stays goes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            _, removed, _, kept = _cut(text, b.column("spans"), True)
            kept = pc.if_else(pc.is_null(text), pa.scalar(None, pa.string()), kept.cast(pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rest"), kept, pa.array(removed > 0)], names=["doc_id", "rest", "kept", "cut"])

    spans = repeated_byte_spans(docs, length)
    # The columns travel inside a struct, where their names can't clash.
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(R.NULL_ID)).alias("doc_id"), docs["text"], F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("rest"))
    joined = rows.join(spans, "doc_id", "left")
    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    out = R.map_arrow(joined, work, f"doc_id long, rest struct<{kind}>, kept string, cut boolean").where("not cut or trim(kept) <> ''")
    columns = {"text": F.col("kept"), "n_chars": F.when(F.col("cut"), F.length("kept").cast("long")).otherwise(F.col("rest.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*((columns[c] if c in columns else F.col("rest")[c]).alias(c) for c in docs.columns))
