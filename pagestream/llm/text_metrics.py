"""Per-document text metrics for the quality rules, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np

from . import arrays as A

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_BYTES = np.arange(256)
_LEAD = (_BYTES & 0xC0) != 0x80  # bytes that begin a character
WINDOW = 5


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def _later_equal(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal one before it in its document, has any equal one in its document), by 64-bit key; rows are in text order."""
    order = np.lexsort((key, doc))
    fresh = A.group_starts(doc[order], key[order])
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(order)))
    later, many = np.empty(len(order), bool), np.empty(len(order), bool)
    later[order] = ~fresh
    many[order] = np.repeat(size > 1, size)
    return later, many


def _slice_metrics(text: np.ndarray, where: np.ndarray) -> dict[str, np.ndarray]:
    docs = len(where) - 1
    starts, ends, first = A.words(text, where)
    n = np.diff(first)
    doc = np.repeat(np.arange(docs), n)
    inside = ~A.SPACES[text]
    sums = A.byte_sums(text)
    hashes = A.ranged(sums, starts, ends, 0)
    # Lines: cut at \n and at the documents' ends; a line counts if it has a word.
    cuts = np.union1d(np.flatnonzero(text == 10) + 1, where)
    cuts = cuts[cuts > 0]
    begin = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
    stop = cuts - (text[cuts - 1] == 10) if len(cuts) else cuts
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[worded], stop[worded]
    line_doc = np.searchsorted(where, begin, "right") - 1
    lines = A.ranged(sums, begin, stop, 0)
    later, _ = _later_equal(line_doc, lines)
    # Windows of five words that occur twice in their document.
    place = A.spread(n)
    at = np.flatnonzero(np.repeat(n, n) - place >= WINDOW)
    _, many = _later_equal(doc[at], A.ranged(A.prefix(hashes, 1), at, at + WINDOW, 1))
    again = A.covered(at[many], at[many] + WINDOW, len(starts))
    return {
        "n_words": n,
        "word_chars": _sums(inside & _LEAD[text], where),
        "n_symbols": _sums(_SYMBOLS[text], where),
        "n_dup_lines": np.bincount(line_doc[later], minlength=docs),
        "n_repeat_words": np.bincount(doc[again], minlength=docs),
        "n_lines": np.bincount(line_doc, minlength=docs),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def metrics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    parts = [_slice_metrics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in A.slices(offsets)]
    return {k: np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]).astype(np.int64) for k in NAMES}
