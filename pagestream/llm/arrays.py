"""Vectorised text primitives shared by the corpus operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column: the
bytes of many documents lie behind one another in ``data`` and document ``i``
is ``data[offsets[i]:offsets[i + 1]]``.  A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays of one slice.
SLICE_BYTES = 1 << 20

_SEED = np.random.default_rng(20240607)
_BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_BASES = [int(x) | 1 for x in _SEED.integers(2**40, 2**62, 4)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}

#: Word separators of the word-based contracts: space and \\t to \\r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2**64 (or of its inverse)."""
    got = _POWERS.get((which, inverse))
    if got is None or len(got) < n:
        base = pow(_BASES[which], -1, 2**64) if inverse else _BASES[which]
        size = max(n, SLICE_BYTES + 1)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if size <= 4 * SLICE_BYTES:
            _POWERS[which, inverse] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the constants are those of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """Running polynomial sums; see :func:`ranged`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(which, len(values)), out=out[1:])
    return out


def ranged(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Position-independent 64-bit hash of ``values[start:end]`` for each pair."""
    return mix((sums[end] - sums[start]) * powers(which, len(sums), True)[start])


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, body = column.buffers()
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together; a longer document stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words; words of document i are first[i]:first[i+1]."""
    inside = ~separators[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ranged(prefix(_BYTE_CODE[data], 0), starts, ends, 0)


def byte_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums for hashing byte ranges of ``data`` with :func:`ranged`."""
    return prefix(_BYTE_CODE[data], which)


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Mask over 0..n of the positions inside any [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of half-open spans per document, as maximal spans in (doc, start) order."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    # A running maximum per document: lift each document above the one before it.
    lift = (np.cumsum(fresh) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    opens = fresh.copy()
    opens[1:] |= (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(opens)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    return doc[at], start[at], reach[last] - lift[last]


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Mask of the rows at which any of the (sorted) columns changes."""
    fresh = np.zeros(len(columns[0]), bool)
    if len(fresh):
        fresh[0] = True
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
    return fresh
