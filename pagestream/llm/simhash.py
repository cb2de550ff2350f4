"""SimHash near-dedup with Golay-code keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The binary
Golay code of length 23 covers every 23-bit word within distance 3, and
``golay_keys`` gives a word the data part (12 bits) of each codeword within
distance 4: one key, or six.  Two words at distance 2 or less have a middle
word at distance 1 of both, whose codeword is within 4 of both, so that they
share a key.  With at most 2 differing bits over three segments, one segment
is free of errors (pigeonhole): candidates agree in one whole segment and in a
Golay key of the next.  Candidates are joined by these keys and verified.

Only distinct fingerprints take part.  A key's group is compared in a task up
to ``GROUP_LIMIT`` fingerprints; the fingerprints of larger groups go through
an exact way without pairs: two fingerprints are within 2 bits exactly if one
flip of at most one bit in each makes them equal, so each is linked to the
least fingerprint at each of its 65 flips.

Edge cases: null and blank texts have no shingles and fingerprint zero, which
is linked like any other; fewer words than a shingle make one of all words;
repeated rows are returned as they are; null ids count as one id before all
others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R
from .components import components

#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
GROUP_LIMIT = 2048
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@functools.cache
def _golay_table() -> tuple[np.ndarray, np.ndarray]:
    """(errors, count): by syndrome, the error patterns of weight 4 or less, padded, and how many there are."""
    single = _syndromes(1 << np.arange(23))
    found: list[list[int]] = [[] for _ in range(2048)]
    patterns, syndromes = np.zeros(1, np.int64), np.zeros(1, np.int64)
    top = np.full(1, -1)
    for _ in range(5):
        for p, s in zip(patterns.tolist(), syndromes.tolist(), strict=True):
            found[s].append(p)
        grown = [(patterns[top < b] | 1 << b, syndromes[top < b] ^ single[b], np.full((top < b).sum(), b)) for b in range(23)]
        patterns, syndromes, top = (np.concatenate(x) for x in zip(*grown, strict=True))
    count = np.array([len(x) for x in found])
    errors = np.zeros((2048, count.max()), np.int64)
    for s, x in enumerate(found):
        errors[s, : len(x)] = x
    return errors, count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the 12-bit indices of all codewords within distance 4 of each 23-bit word."""
    errors, count = _golay_table()
    words = words.astype(np.int64)
    syndrome = _syndromes(words)
    n = count[syndrome]
    row = np.repeat(np.arange(len(words)), n)
    return row, (words[row] ^ errors[syndrome[row], A.spread(n)]) >> 11


def candidate_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): whole segment and Golay key of the next one, for each of the three segments."""
    prints = prints.view(np.uint64)
    part = [((prints >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    rows, keys = [], []
    for s in range(3):
        row, key = golay_keys(part[(s + 1) % 3])
        rows.append(row)
        keys.append((part[s][row] << 12 | key) << 2 | s)
    return np.concatenate(rows), np.concatenate(keys)


def _digests(raw: bytes, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[x:y], 42) for x, y in zip(a.tolist(), z.tolist(), strict=True)), np.uint64, len(a))


def _shingles(text: np.ndarray, where: np.ndarray, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, starts, ends, count by document) of the shingles, lower-cased, words joined by one space."""
    text = _LOWER[text]
    starts, ends, first = A.words(text, where)
    length = ends - starts + 1
    close = np.cumsum(length)
    body = np.append(text, np.uint8(32))[np.repeat(starts, length) + A.spread(length)] if len(starts) else text[:0]
    if len(close):
        body[close - 1] = 32
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    at = np.repeat(first[:-1], count) + A.spread(count)
    last = np.minimum(at + size, np.repeat(first[1:], count)) - 1
    return body.tobytes(), close[at] - length[at], close[last] - 1, count


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """A bit is set if it is set in over half the shingles' XXH64 (seed 42)."""
    out = [np.zeros(0, np.uint64)]
    for lo, hi in A.slices(offsets, A.SLICE_BYTES // 4):
        raw, a, z, count = _shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
        edge = np.concatenate([[0], np.cumsum(count)])
        sums = np.zeros((hi - lo, 64), np.int64)
        for b in range(0, len(a), 1 << 17):  # in blocks: bits take 64 bytes a shingle
            e = min(b + (1 << 17), len(a))
            bits = np.unpackbits(_digests(raw, a[b:e], z[b:e]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            x = int(np.searchsorted(edge, b, "right")) - 1
            y = int(np.searchsorted(edge, e, "left"))
            docs = np.arange(x, y)[count[x:y] > 0]
            sums[docs] += np.add.reduceat(bits, np.maximum(edge[docs], b) - b, axis=0, dtype=np.int64)
        set_ = 2 * sums > count[:, None]
        out.append(np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out)


def with_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id (null: NULL_ID), fingerprint as a signed 64-bit number."""
    R.prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.strings(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(data, offsets, size).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return R.map_arrow(R.keyed(docs, "text"), work, "doc_id long, fp long")


def _pairs(bits: int):
    """Rows of one group's distinct fingerprints to links that join all that are reachable within the group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            groups = b.column(0)
            values, offsets = groups.flatten().to_numpy(zero_copy_only=False).astype(np.int64), groups.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            two = offsets[:-1][sizes == 2]
            x, y = values[two], values[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= bits
            left.append(x[near])
            right.append(y[near])
            for a, n in zip(offsets[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                v = np.sort(values[a : a + n])
                root = np.arange(n)
                for i in range(n - 1):  # one row of the group's triangle at a time
                    hit = np.flatnonzero(np.bitwise_count((v[i + 1 :] ^ v[i]).view(np.uint64)) <= bits) + i + 1
                    # A link to the first near one before it is kept for each pair that isn't joined yet.
                    new = hit[root[hit] != root[i]]
                    if len(new):
                        left.append(np.full(len(new), v[i]))
                        right.append(v[new])
                        joined = np.isin(root, root[new])
                        root[joined] = root[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())], names=["a", "b"])

    return work


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, enough to join all that are linked at 2 or fewer bits."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = candidate_keys(v)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(v[row], pa.int64())], names=["key", "fp"])

    def flips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = np.concatenate([[0], np.int64(1) << np.arange(64, dtype=np.int64)])
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((v[:, None] ^ flip).ravel(), pa.int64()), pa.array(np.repeat(v, 65), pa.int64())], names=["hub", "fp"])

    keyed = R.stage(R.map_arrow(prints.select("fp"), keys, "key long, fp long"), "golay-keys")
    count = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = R.stage(keyed.join(count, "key"), "golay-shared")
    groups = shared.where(F.col("n") <= GROUP_LIMIT).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    small = R.map_arrow(groups.select("fps"), _pairs(2), "a long, b long")
    hubs = R.map_arrow(shared.where(F.col("n") > GROUP_LIMIT).select("fp").distinct(), flips, "hub long, fp long")
    least = hubs.groupBy("hub").agg(F.min("fp").alias("a"))
    large = hubs.join(least, "hub").where("fp <> a").select("a", F.col("fp").alias("b"))
    return small.unionByName(large).distinct()


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: least doc_id reachable over links of at most 2 differing bits."""
    marked = R.stage(with_fingerprints(docs, size), "fingerprints")
    classes = R.stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id")
    out = marked.join(by_print, "fp")
    return out.select(R.plain_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), R.plain_id("component_id"))
