"""Vector bin packing of tokenised documents into training sequences.

Documents become token ids with an end id.  A document may be cut; each id
lies in exactly one piece.  Every sequence has limits on three quantities at
once: tokens, segments (pieces), and loss-bearing tokens.  A document's first
``prompt_lines`` lines are its prompt (if it has more), whose tokens bear no
loss; all others do.  Documents that are longer than a sequence fill whole ones
as far as the limits allow.  The rest goes to bins by the dot-product
heuristic: of the pieces that fit, a bin takes the one whose demand vector
(tokens, 1, loss-bearing tokens) has the largest dot product with the bin's
free capacity, each quantity weighted by how scarce it is among what is left;
what no piece fills is topped up by a part cut from the longest one left.  If a
loss limit below the sequence's length binds and nothing but loss-bearing
tokens is left, a sequence closes early.

Packing is done within shards of documents (the input's splits), each of which
ends with one open sequence; a sequence that ends at a power of two needs no
padding.  Sequence ids are the shard's number and a count.

Edge cases: null and empty texts are the end id alone; repeated rows are packed
each; texts of any length are cut; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R

#: Documents packed together: bounds the ids a task holds.
SHARD_TOKENS = 1 << 22
#: Pieces sent at once: their ids are held by the worker and by the JVM.
BATCH_PIECES = 512
#: Bytes of text encoded at once: bounds what encoding holds beside the ids.
SLICE_BYTES = 1 << 20
#: Slices after which a worker gives freed memory back, which else piles up until its task ends.
RELEASE_SLICES = 4
#: Words whose ids a worker remembers: about 12 MB.
MEMORY_WORDS = 1 << 19
PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048

    def __post_init__(self):
        if self.tokens < 1 or self.segments < 1 or self.loss_tokens < 1:
            raise ValueError("limits have to be positive")


class WordTokenizer:
    """Ids of a tokenizer that lower-cases and never joins words, nor letters with marks.

    Each text is split at spaces, line ends and between letters and closing
    marks; a worker encodes each distinct word once and remembers its ids by
    hash and length.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        alike = [self.inner.encode(t, add_special_tokens=False).ids for t in ("Ab Été, c!\nd", "ab Été , c !  d")]
        if alike[0] != alike[1]:
            raise ValueError("the tokenizer has to lower-case, and to cut at spaces, line ends and marks")
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known words, by hash
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # their ids

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ends): the new ones are encoded, and remembered while there is room."""
        data, offsets = A.strings(words)
        key = A.mix(A.word_hashes(data, offsets[:-1], offsets[1:]) + np.diff(offsets).view(np.uint64))
        at = np.minimum(np.searchsorted(self.hash, key), max(len(self.hash) - 1, 0))
        known = self.hash[at] == key if len(self.hash) else np.zeros(len(key), bool)
        new = np.flatnonzero(~known)
        flats, sizes = [], []
        for k in range(0, len(new), 16384):
            part = words.take(pa.array(new[k : k + 16384])).to_pylist()
            made = self.inner.encode(part, is_pretokenized=True, add_special_tokens=False)  # one call: word_ids tell the words apart
            flats.append(np.array(made.ids, np.uint32))
            sizes.append(np.bincount(np.array(made.word_ids, np.int64), minlength=len(part)))
        flat = np.concatenate([self.flat, *flats])
        ends = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])
        row = np.empty(len(key), np.int64)
        row[known] = self.row[at[known]]
        row[new] = len(self.at) - 1 + np.arange(len(new))
        out = ends[row], ends[row + 1]
        n = out[1] - out[0]
        body = flat[np.repeat(out[0], n) + A.spread(n)]
        if len(new) and len(self.hash) + len(new) <= MEMORY_WORDS:
            order = np.argsort(key[new], kind="stable")
            where = np.searchsorted(self.hash, key[new][order])
            self.hash, self.row = np.insert(self.hash, where, key[new][order]), np.insert(self.row, where, row[new][order])
            self.flat, self.at = flat, ends
        return body, np.concatenate([[0], np.cumsum(n)])

    @staticmethod
    def _split(texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring(texts, "\n", " ")
        # Marks are cut off ahead, so that words meet that differ in these or in case only.
        return pc.replace_substring_regex(pc.ascii_lower(texts), r"(\p{L})([.,!?;:]+ )", r"\1 \2")

    def encode(self, column: pa.Array, end: int, prompt_lines: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end``; offsets; ids of each text's prompt)."""
        texts = column.fill_null("").cast(pa.large_string())
        lists = pc.split_pattern(self._split(texts), " ")
        words = lists.flatten().dictionary_encode()
        flat, at = self._ids(words.dictionary)
        index = words.indices.to_numpy(zero_copy_only=False)
        n = np.diff(at)[index]
        body = flat[np.repeat(at[:-1][index], n) + A.spread(n)]
        first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        total = np.concatenate([[0], np.cumsum(n)])
        upto = total[first]
        prompt = np.zeros(len(texts), np.int64)
        if prompt_lines:
            lines = pc.split_pattern(texts, "\n", max_splits=prompt_lines)
            have = np.flatnonzero(np.diff(lines.offsets.to_numpy()) > prompt_lines)
            text = lambda x: pa.scalar(x, pa.large_string())
            heads = pc.binary_join(pc.list_slice(lines.take(pa.array(have)), 0, prompt_lines), text("\n"))
            spaces = pc.count_substring(self._split(pc.binary_join_element_wise(heads, text(""), text(" "))), " ").to_numpy()
            prompt[have] = total[first[have] + spaces] - upto[have]
        return np.insert(body, upto[1:], end), upto + np.arange(len(upto)), prompt


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _is_power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


class _Pool:
    """Pieces that wait, by length; of each length by loss-bearing tokens."""

    def __init__(self, cap: int):
        self.lists: list[list[tuple[int, int, int]]] = [[] for _ in range(cap + 1)]  # (loss, -document, start)
        self.most = np.full(cap + 1, -1)  # the largest loss of each length, -1: none
        self.size = np.arange(cap + 1)
        self.tokens = self.count = self.loss = 0

    def put(self, doc: int, start: int, n: int, loss: int) -> None:
        bisect.insort(self.lists[n], (loss, -doc, start))
        self.most[n] = self.lists[n][-1][0]
        self.tokens, self.count, self.loss = self.tokens + n, self.count + 1, self.loss + loss

    def take(self, n: int, most_loss: int) -> tuple[int, int, int]:
        """(document, start, loss) of the piece of length n with the largest loss up to the given one."""
        own = self.lists[n]
        loss, doc, start = own.pop(bisect.bisect_right(own, (most_loss, 1, 0)) - 1)
        self.most[n] = own[-1][0] if own else -1
        self.tokens, self.count, self.loss = self.tokens - n, self.count - 1, self.loss - loss
        return -doc, start, loss

    def best(self, free: int, loss: int, by_token: float, by_loss: float) -> int:
        """The length whose piece has the largest dot product among those that fit; 0: none does."""
        most = self.most[: free + 1]
        if loss < free and (most > loss).any():
            most = most.copy()
            for n in np.flatnonzero(most > loss).tolist():
                own = self.lists[n]
                at = bisect.bisect_right(own, (loss, 1, 0)) - 1
                most[n] = own[at][0] if at >= 0 else -1
        score = np.where(most >= 0, by_token * self.size[: free + 1] + by_loss * most, -1.0)
        n = len(score) - 1 - int(score[::-1].argmax())  # of equals the longest
        return n if score[n] >= 0 else 0


def pack(lengths: np.ndarray, limits: Limits, prompts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset, loss) of all pieces, for documents of ``lengths`` tokens (each at least 1).

    The first ``prompts`` tokens of a document bear no loss.
    """
    cap = limits.tokens
    prompts = np.zeros(len(lengths), np.int64) if prompts is None else np.minimum(prompts, lengths)
    bears = lambda d, s, n: max(0, s + n - max(s, int(prompts[d])))
    full = lengths // cap if limits.loss_tokens >= cap else np.zeros(len(lengths), np.int64)
    doc, start = np.repeat(np.arange(len(lengths)), full), A.spread(full) * cap
    whole = (doc, start, np.full(len(doc), cap), np.arange(len(doc)), np.zeros(len(doc), np.int64))
    pool = _Pool(cap)
    for d in np.flatnonzero(lengths > full * cap).tolist():
        s = int(full[d]) * cap
        while s < lengths[d]:  # more than one piece only if the loss limit is below a sequence's length
            n = int(min(lengths[d] - s, cap, max(prompts[d] - s, 0) + limits.loss_tokens))
            pool.put(d, s, n, bears(d, s, n))
            s += n
    sequence = len(doc)
    out: list[tuple[int, int, int, int, int]] = []
    free, slots, loss, used = cap, limits.segments, limits.loss_tokens, 0
    while pool.count:
        # Each quantity weighs by its share of what is left over what a bin has; all pieces are one segment.
        by_token = pool.tokens / cap * free / cap**2
        by_loss = pool.loss / limits.loss_tokens * loss / limits.loss_tokens**2
        n = pool.best(free, loss, by_token, by_loss) if slots > 1 else 0
        if n:
            d, s, _ = pool.take(n, loss)
            take = n
        else:  # nothing fits, or the last slot: fill up by cutting the longest that is left
            n = int(np.flatnonzero(pool.most >= 0)[-1])
            d, s, _ = pool.take(n, cap)
            take = min(n, free, max(int(prompts[d]) - s, 0) + loss)
            if take < n:
                pool.put(d, s + take, n - take, bears(d, s + take, n - take))
        if take:
            out.append((d, s, take, sequence, used))
            used, free, slots, loss = used + take, free - take, slots - 1, loss - bears(d, s, take)
        if not free or not slots or not take:
            sequence, free, slots, loss, used = sequence + 1, cap, limits.segments, limits.loss_tokens, 0
    if used and not _is_power(used):
        out = _even(out, used)
    tail = np.array(out, np.int64).reshape(-1, 5).T
    d, s, n, q, o = (np.concatenate([a, b]) for a, b in zip(whole, tail, strict=True))
    return d, s, n, q, o, np.maximum(0, s + n - np.maximum(s, prompts[d])) if len(d) else d


def _even(out: list[tuple[int, int, int, int, int]], used: int) -> list[tuple[int, int, int, int, int]]:
    """The open sequence of ``used`` tokens becomes sequences whose sizes are powers of two."""
    last = out[-1][3]
    keep = [x for x in out if x[3] != last]
    open_ = [x for x in out if x[3] == last]
    sizes = [1 << b for b in reversed(range(used.bit_length())) if used >> b & 1]
    sequence, free, at = last, sizes.pop(0), 0
    for d, s, n, _, _ in open_:
        while n:
            if not free:
                sequence, free, at = sequence + 1, sizes.pop(0), 0
            take = min(n, free)
            keep.append((d, s, take, sequence, at))
            s, n, free, at = s + take, n - take, free - take, at + take
    return keep


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (id, text) of about ``SLICE_BYTES`` of text; a longer text is one part."""
    upto = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def _packed(path: str, end: int, limits: Limits, prompt_lines: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        shard, held, size = 0, [], 0
        base = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0

        def close() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([x[0] for x in held])
            lengths = np.concatenate([np.diff(x[1]) for x in held])
            prompts = np.concatenate([x[2] for x in held])
            names = np.concatenate([x[3] for x in held])
            at = np.concatenate([[0], np.cumsum(lengths)])
            doc, start, length, sequence, offset, loss = pack(lengths, limits, prompts)
            for lo in range(0, len(doc), BATCH_PIECES):
                part = slice(lo, lo + BATCH_PIECES)
                a = at[doc[part]] + start[part]
                raw = [ids[x : x + n].astype("<u4").tobytes() for x, n in zip(a.tolist(), length[part].tolist(), strict=True)]
                whole = lambda x: pa.array(x[part], pa.int64())
                yield pa.RecordBatch.from_arrays([whole(names[doc]), whole(start), whole(length), pa.array(raw, pa.binary()), whole(lengths[doc]), whole(base + (shard << 24) + sequence), whole(offset), whole(loss)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        for b in (part for whole in batches for part in _slices(whole)):
            held.append((*model.encode(b.column(1), end, prompt_lines), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            if len(held) % RELEASE_SLICES == 0:
                R.release()
            size += len(held[-1][0])
            if size >= SHARD_TOKENS:
                yield from close()
                shard, held, size = shard + 1, [], 0
        if size:
            yield from close()

    return work


def packed(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end: int = 1, prompt_lines: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, loss_tokens."""
    R.prepare(docs.sparkSession)
    out = R.map_arrow(R.keyed(docs, "text"), _packed(tokenizer_path, end, limits, prompt_lines), PIECE_SCHEMA)
    return out.select(R.plain_id(), *(c for c in out.columns if c != "doc_id"))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
