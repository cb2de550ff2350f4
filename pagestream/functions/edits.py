"""Edit distance of two sequences, bit-parallel within a band of diagonals."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

#: Width of the first band on each side of the main diagonal.
FIRST_BAND = 32


def _within(p: Sequence[Hashable], q: Sequence[Hashable], k: int) -> int:
    """Edits from ``p`` to ``q`` if these are at most ``k`` (no less than the lengths' difference), else some number above.

    A column of the table is held as differences between neighbours, one bit a row; bit ``t`` of column ``j`` is row
    ``j - k + t``, so that the band moves down by one row a column.  Rows outside only ever count too high, and what
    takes at most ``k`` edits never leaves the band.  The number followed is the one on the diagonal that ends in the
    last cell.
    """
    width = 2 * k + 1
    mask, top, at = (1 << width) - 1, 1 << 2 * k, len(p) - len(q) + k
    # Places of each element as bits, in pieces as wide as the band: a window meets two of them.
    places: dict[tuple[Hashable, int], int] = {}
    for i, x in enumerate(p, k):
        key = (x, i // width)
        places[key] = places.get(key, 0) | 1 << i % width
    up, down = mask ^ ((1 << k + 1) - 1), 0  # rows below the first rise by one each; those above it don't exist
    edits = max(0, len(p) - len(q))
    for j, x in enumerate(q):
        piece, off = divmod(j, width)
        same = (places.get((x, piece), 0) | places.get((x, piece + 1), 0) << width) >> off & mask
        up, down = up >> 1 | top, down >> 1
        level = ((((same & up) + up) ^ up) | same | down) & mask
        right_up, right_down = down | mask ^ (level | up), level & up
        if not level >> at & 1:
            edits += 1
            if edits > k:
                return edits
        right_up, right_down = (right_up << 1 | 1) & mask, right_down << 1 & mask
        up, down = right_down | mask ^ (level | right_up), right_up & level
    return edits


def edits(p: Sequence[Hashable], q: Sequence[Hashable]) -> int:
    """Fewest insertions, deletions and replacements that turn ``p`` into ``q``.

    Equal ends are cut off; the band is doubled until it holds the answer, so that time grows with the length times the
    edits over a machine word's bits, and memory with the length.
    """
    start, n = 0, min(len(p), len(q))
    while start < n and p[start] == q[start]:
        start += 1
    end = 0
    while end < n - start and p[len(p) - 1 - end] == q[len(q) - 1 - end]:
        end += 1
    p, q = p[start : len(p) - end], q[start : len(q) - end]
    if not p or not q:
        return max(len(p), len(q))
    k = max(FIRST_BAND, abs(len(p) - len(q)))
    while (found := _within(p, q, k)) > k:
        k *= 2
    return found
