"""Phrase collocation mining with depth-limited count tries.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\n-\\r]`` and pieces
into words at spaces and tabs.  A phrase is two to ``longest`` words in a row
inside a piece; everything is counted per language (null: ``und``).

1. One pass counts words.  A phrase that occurs ``least`` times has only words
   that do, so all other words end a piece from here on; if the frequent words
   can be broadcast (their number is counted first), they are dropped before
   tries are built, else the tries hold them as well, with the same result.
2. Each shard (some millions of words of one language in a task) becomes a
   count trie of depth ``longest``: its distinct word sequences in sorted order,
   each stored as what it doesn't share with the one before it.  The tries are
   cut at boundaries of the sorted space of all sequences, which are quantiles
   of a sample of distinct sequences, so that a very common word, pair or
   passage is spread over several ranges.
3. A task merges the k sorted runs of one prefix range, sums counts, and walks
   the merged trie: each node with enough occurrences gets the counts of its
   ancestors, the left parts of its cuts.  The few nodes on a range's border
   have parts in two ranges; they are summed, and fill the gaps they left.
4. Suffix links (a phrase without its first word) are joins of one depth with
   the depth below; right parts are passed along them.  Because a longer phrase
   never occurs more often than what it holds, a phrase that is absorbed by any
   longer one is absorbed by one of a single word more: its children in the
   trie and the phrases that link to it are enough.
5. Scores are exact (decimals of 38 digits).  Phrases of equal score and count
   are ordered by their UTF-8 bytes.

Words are keyed by 64-bit hashes; two frequent words of one key are found when
words are counted, and the keys are made anew with another base.

Edge cases: null and empty texts have no words; a language without a phrase has
no rows; equal texts and rows count each time; texts of any length are whole;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R

#: Words of one trie: bounds what a task holds.
SHARD_WORDS = 1 << 20
#: Bytes of text whose words are counted at once.
COUNT_BYTES = 2 << 20
#: Frequent words that may be broadcast (8 bytes each).
FILTER_WORDS = 1 << 20
#: Sampled sequences for each range, and of all ranges together.
SAMPLE_EACH, SAMPLE_ALL = 64, 1 << 16
#: Sampled sequences of one batch.
SAMPLE_BATCH = 64

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

COUNT_SCHEMA = "lang string, kind int, key long, word string, n long, path binary"
TRIE_SCHEMA = "lang string, bucket int, words binary, codes binary, tails binary, counts binary"
TOTAL, WORD, SAMPLE = 0, 1, 2


def tokens(data: np.ndarray, offsets: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, ends, first word of each text, mask of the words that begin a piece) of lower-cased texts."""
    starts, ends, first = A.words(data, offsets, SEPARATORS)
    keys = A.ranged(A.byte_sums(data, base), starts, ends, base)
    keys[keys == 0] = 1  # 0 ends a piece
    before = np.concatenate([[0], np.cumsum(BREAKS[data])])[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = before[1:] != before[:-1]
    fresh[first[:-1][first[:-1] < len(starts)]] = True
    return keys, starts, ends, first, fresh


def sequences(keys: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the ``depth`` words from each position on (0 from the end of the piece on), and the positions with two words at least."""
    ok, columns = keys != 0, [keys]
    for d in range(1, depth):
        ahead = np.concatenate([keys[d:], np.zeros(min(d, len(keys)), keys.dtype)])
        ok = ok & (ahead != 0)
        columns.append(np.where(ok, ahead, 0))
    return columns, np.flatnonzero((keys != 0) & (columns[1] != 0))


def _langs(column: pa.Array) -> tuple[list[str], np.ndarray]:
    codes = column.fill_null("und").dictionary_encode()
    return codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)


def _texts(b: pa.RecordBatch, base: int, limit: int = A.SLICE_BYTES) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, lowered bytes, keys, starts, ends, piece mask) of each language of each slice."""
    names, code = _langs(b.column("lang"))
    for k, lang in enumerate(names):
        column = b.column("text").take(pa.array(np.flatnonzero(code == k))) if len(names) > 1 else b.column("text")
        data, offsets = A.strings(column)
        for lo, hi in A.slices(offsets, limit):
            part = LOWER[data[offsets[lo] : offsets[hi]]]
            keys, starts, ends, _, fresh = tokens(part, offsets[lo : hi + 1] - offsets[lo], base)
            if len(keys):
                yield lang, part, keys, starts, ends, fresh


def _with_breaks(keys: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    return np.insert(keys, np.flatnonzero(fresh), 0)


def _word_counts(base: int, depth: int):
    """Counts of each slice; the JVM sums them before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, data, keys, starts, ends, fresh in _texts(b, base, COUNT_BYTES):
                known, at, n = np.unique(keys, return_index=True, return_counts=True)
                where = np.concatenate([[0], np.cumsum(ends[at] - starts[at])])
                body = data[np.repeat(starts[at], np.diff(where)) + A.spread(np.diff(where))]
                words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(body)]).cast(pa.string())
                columns, rows = sequences(_with_breaks(keys, fresh), depth)
                total = np.zeros(len(rows), np.uint64)
                for d, c in enumerate(columns):
                    total = A.mix(total + c[rows] + np.uint64(d))
                least = np.argpartition(total, SAMPLE_BATCH)[:SAMPLE_BATCH] if len(total) > SAMPLE_BATCH else np.arange(len(total))
                paths = np.stack([c[rows[least]] for c in columns], 1)
                kinds = np.repeat(np.array([TOTAL, WORD, SAMPLE], np.int32), [1, len(known), len(least)])
                m = len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang]).take(pa.array(np.zeros(m, np.int32))),
                        pa.array(kinds),
                        pa.array(np.concatenate([[0], known.view(np.int64), total[least].view(np.int64)])),
                        pa.concat_arrays([pa.nulls(1, pa.string()), words, pa.nulls(len(least), pa.string())]),
                        pa.array(np.concatenate([[len(keys)], n, np.ones(len(least), np.int64)])),
                        pa.concat_arrays([pa.nulls(1 + len(known), pa.binary()), pa.array([p.tobytes() for p in paths], pa.binary())]),
                    ],
                    names=["lang", "kind", "key", "word", "n", "path"],
                )

    return work


# --- tries ------------------------------------------------------------------------------------------------------


def _order(columns: list[np.ndarray], top: int) -> np.ndarray:
    """Sorted order of rows of small numbers (0..top), packed into few keys."""
    bits = max(1, int(top).bit_length())
    each = 63 // bits
    packed = []
    for k in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[k : k + each]:
            key = key << bits | c
        packed.append(key)
    return np.lexsort(packed[::-1])


def _collapse(columns: list[np.ndarray], counts: np.ndarray | None, top: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in sorted order, with their summed counts."""
    order = _order(columns, top)
    columns = [c[order] for c in columns]
    at = np.flatnonzero(A.group_starts(*columns))
    counts = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return [c[at] for c in columns], counts


def _place(columns: list[np.ndarray], words: np.ndarray, boundary: tuple[int, ...]) -> int:
    """The first of the sorted rows that isn't below ``boundary`` (keys; rows hold places in ``words`` from 1 on)."""
    lo, hi = 0, len(columns[0])
    for c, key in zip(columns, boundary, strict=True):
        at = int(np.searchsorted(words, np.uint64(key))) if key else -1
        exact = not key or at < len(words) and int(words[at]) == key
        a = lo + int(np.searchsorted(c[lo:hi], at + 1, "left"))
        if not exact:
            return a
        lo, hi = a, lo + int(np.searchsorted(c[lo:hi], at + 1, "right"))
        if lo == hi:
            return lo
    return lo


def encode(columns: list[np.ndarray], counts: np.ndarray, words: np.ndarray, known: np.ndarray | None = None) -> tuple[bytes, bytes, bytes, bytes]:
    """(words, codes, tails, counts): the sorted trie; a row is a code (shared * 8 + depth) and its words beyond the shared ones.

    Words are keys, or steps between their places in ``known``, the sorted keys that all tasks have.
    """
    depth = sum((c != 0).astype(np.int64) for c in columns)
    shared, equal = np.zeros(len(depth), np.int64), np.ones(len(depth), bool)
    equal[:1] = False
    for c in columns:
        equal[1:] &= c[1:] == c[:-1]
        shared += equal & (c != 0)
    used = np.zeros(len(words) + 1, bool)
    table = np.stack(columns, 1)
    used[table] = True
    used[0] = False
    number = np.cumsum(used)
    level = np.arange(len(columns))
    tails = number[table[(level >= shared[:, None]) & (level < depth[:, None])]] - 1
    pack = zstandard.ZstdCompressor(level=1).compress
    words = words[used[1:]]
    names = words.tobytes() if known is None else pack(R._part(np.diff(np.searchsorted(known, words), prepend=0)))
    return names, pack((shared << 3 | depth).astype(np.uint8).tobytes()), pack(R._part(tails)), pack(R._part(counts))


def decode(words: bytes, codes: bytes, tails: bytes, counts: bytes, depth: int, known: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words, columns with places in words from 1 on, counts)."""
    unpack = zstandard.ZstdDecompressor().decompress
    code = np.frombuffer(unpack(codes), np.uint8).astype(np.int32)
    shared, own = code >> 3, code & 7
    tail = R._take(unpack(tails), 0)[0].astype(np.int32) + 1
    at = np.cumsum(own - shared) - (own - shared)
    rows, columns = np.arange(len(code), dtype=np.int32), []
    for d in range(depth):
        source = np.maximum.accumulate(np.where(shared <= d, rows, -1))
        has = own > d
        columns.append(np.where(has, tail[np.where(has, at[source] + d - shared[source], 0)], 0))
    names = np.frombuffer(words, np.uint64) if known is None else known[np.cumsum(R._take(unpack(words), 0)[0])]
    return names, columns, R._take(unpack(counts), 0)[0]


def _tries(base: int, depth: int, frequent, boundaries: dict[str, list[tuple[int, ...]]]):
    """Texts to packed tries, one row for each range that a shard reaches."""

    def shard(lang: str, keys: np.ndarray) -> Iterator[tuple]:
        own = _known(frequent, lang)
        if own is not None:
            at = np.minimum(np.searchsorted(own, keys), max(len(own) - 1, 0))
            keys = np.where(own[at] == keys, keys, np.uint64(0)) if len(own) else np.zeros(0, np.uint64)
        words, number = np.unique(keys, return_inverse=True)
        if not len(words) or words[0]:  # no piece ends here: the numbers start at 1 all the same
            number = number + 1
        else:
            words = words[1:]
        columns, rows = sequences(number.ravel().astype(np.int32), depth)
        if not len(rows):
            return
        columns, counts = _collapse([c[rows] for c in columns], None, len(words))
        cuts = [0, *(_place(columns, words, x) for x in boundaries.get(lang, [])), len(counts)]
        for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                yield lang, bucket, *encode([c[a:b] for c in columns], counts[a:b], words, own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "bucket", "words", "codes", "tails", "counts"]
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                for row in shard(lang, np.concatenate(parts)):
                    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for lang, _, keys, _, _, fresh in _texts(b, base):
                held[lang].append(_with_breaks(keys, fresh))
                size += len(keys)
                if size >= SHARD_WORDS:
                    yield from close()
                    held.clear()
                    size = 0
        yield from close()

    return work


def merge(rows: list[tuple[bytes, bytes, bytes, bytes]], depth: int, least: int, border: set[tuple[int, ...]], known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The merged trie of one range, by depth from 2 on: (depth, paths, counts, ancestors' counts, on the border).

    Nodes below ``least`` go, but for those on the border, whose other part lies
    in another range.  Counts of ancestors on the border are -1.
    """
    parts = [decode(*r, depth, known) for r in rows]
    words = np.unique(np.concatenate([p[0] for p in parts]))
    maps = [np.concatenate([[0], np.searchsorted(words, p[0]) + 1]).astype(np.int32) for p in parts]
    columns = [np.concatenate([m[p[1][d]] for m, p in zip(maps, parts, strict=True)]) for d in range(depth)]
    columns, counts = _collapse(columns, np.concatenate([p[2] for p in parts]), len(words))
    del parts
    names = np.concatenate([[np.uint64(0)], words])
    fresh = np.zeros(len(counts), bool)
    fresh[:1] = True
    above: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(depth):
        fresh[1:] |= columns[d][1:] != columns[d][:-1]
        at = np.flatnonzero(fresh)
        total = np.add.reduceat(counts, at) if len(at) else counts[:0]
        group = np.cumsum(fresh) - 1
        if d:
            node = np.flatnonzero((columns[d][at] != 0) & ((total >= least) | (len(border) > 0)))
            paths = np.stack([names[c[at[node]]] for c in columns[: d + 1]], 1)
            open_ = np.zeros(len(node), bool)
            for edge in border:
                if len(edge) == d + 1:
                    open_ |= (paths == np.array(edge, np.uint64)).all(1)
            keep = (total[node] >= least) | open_
            node, paths, open_ = node[keep], paths[keep], open_[keep]
            lefts = np.stack([np.where(o[g[at[node]]], -1, t[g[at[node]]]) for t, o, g in above] or [np.zeros(len(node), np.int64)], 1)
            yield d + 1, paths, total[node], lefts if above else lefts[:, :0], open_
            edges = np.zeros(len(at), bool)
            edges[node[open_]] = True
            above.append((total, edges, group))


def _borders(boundaries: list[tuple[int, ...]], bucket: int) -> set[tuple[int, ...]]:
    """Paths that a boundary of the range may cut."""
    near = boundaries[max(bucket - 1, 0) : bucket + 1]
    return {edge[:d] for edge in near for d in range(2, len(edge) + 1) if all(edge[:d])}


def _known(frequent, lang: str) -> np.ndarray | None:
    return None if frequent is None else frequent.value.get(lang, np.zeros(0, np.uint64))


def _merged(depth: int, least: int, frequent, boundaries: dict[str, list[tuple[int, ...]]]):
    def work(table: pa.Table) -> pa.Table:
        lang, bucket = table.column("lang")[0].as_py(), table.column("bucket")[0].as_py()
        rows = list(zip(*(table.column(k).to_pylist() for k in ("words", "codes", "tails", "counts")), strict=True))
        out = []
        for d, paths, total, lefts, open_ in merge(rows, depth, least, _borders(boundaries.get(lang, []), bucket), _known(frequent, lang)):
            n = len(total)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))
            out.append(pa.table({"lang": pa.array([lang] * n, pa.string()), "path": lists(paths), "a": pa.array(total.astype(np.int64)), "lefts": lists(lefts.astype(np.int64)), "open": pa.array(open_)}))
        R.release()
        return pa.concat_tables(out)

    return work


# --- the operator ------------------------------------------------------------------------------------------------


def _counted(docs: DataFrame, depth: int, least: int) -> tuple[DataFrame, int]:
    """(staged counts: totals, frequent words and sampled sequences; the base whose keys tell all frequent words apart)."""
    for base in range(len(A._BASES)):
        raw = R.map_arrow(docs, _word_counts(base, depth), COUNT_SCHEMA)
        counts = raw.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"), F.min("path").alias("path"))
        counts = R.stage(counts.where((F.col("kind") != WORD) | (F.col("n") >= least)), "phrase-counts")
        if counts.where(F.col("word") != F.col("other")).isEmpty():
            return counts, base
        R.drop(counts)
    raise ValueError("no base tells all words apart")


def _boundaries(counts: DataFrame, ranges: int) -> dict[str, list[tuple[int, ...]]]:
    """Quantiles of the sampled sequences: about ``ranges`` ranges over all languages."""
    size = min(SAMPLE_EACH * ranges, SAMPLE_ALL)
    # A bounded sample: the sequences of the smallest keys, each once however often it occurs.
    rows = counts.where(F.col("kind") == SAMPLE).select("lang", "key", "path").orderBy("key", "lang").limit(size).collect()
    own: dict[str, list[tuple[int, ...]]] = defaultdict(list)
    for r in rows:
        own[r["lang"]].append(tuple(np.frombuffer(r["path"], np.uint64).tolist()))
    step = max(1, len(rows) // max(1, ranges))
    return {lang: sorted(set(paths))[step::step] for lang, paths in own.items()}


def _frequent(counts: DataFrame):
    """Keys of the frequent words by language as a broadcast value, or None beyond the bound."""
    words = counts.where(F.col("kind") == WORD).select("lang", "key")
    if words.count() > FILTER_WORDS:
        return None
    own: dict[str, list[int]] = defaultdict(list)
    for lang, key in words.collect():
        own[lang].append(key)
    return counts.sparkSession.sparkContext.broadcast({lang: np.sort(np.array(keys, np.int64).view(np.uint64)) for lang, keys in own.items()})


def _nodes(docs: DataFrame, counts: DataFrame, base: int, depth: int, least: int) -> DataFrame:
    """Staged: lang, path, a, lefts (counts of the first 2, 3, ... words) of all phrases with ``least`` occurrences."""
    boundaries = _boundaries(counts, R.bucket_count(docs))
    frequent = _frequent(counts)
    tries = R.map_arrow(docs, _tries(base, depth, frequent, boundaries), TRIE_SCHEMA)
    merged = tries.groupBy("lang", "bucket").applyInArrow(_merged(depth, least, frequent, boundaries), "lang string, path array<long>, a long, lefts array<long>, open boolean")
    # Only nodes on a range's border have several rows here; their ancestors are on it too.
    nodes = merged.groupBy("lang", "path").agg(F.sum("a").alias("a"), F.max("lefts").alias("lefts"), F.max("open").alias("open"))
    nodes = R.stage(nodes.where(F.col("a") >= least), "phrase-nodes")
    edges = nodes.where("open").select("lang", F.col("path").alias("edge"), F.col("a").alias("edge_a"))
    whole = nodes
    for d in range(2, depth):  # what a walk couldn't know: counts of border nodes
        at = d - 2
        gap = F.when((F.size("path") > d) & (F.get("lefts", F.lit(at)) == -1), F.slice("path", 1, d))
        ahead = edges.select(F.col("lang").alias("edge_lang"), "edge", "edge_a")
        joined = whole.withColumn("gap", gap).join(ahead, (F.col("lang") == F.col("edge_lang")) & (F.col("gap") == F.col("edge")), "left")
        filled = F.expr(f"transform(lefts, (x, i) -> if(i = {at}, coalesce(edge_a, x), x))")
        whole = joined.withColumn("lefts", filled).select("lang", "path", "a", "lefts")
    return R.stage(whole.select("lang", "path", "a", "lefts"), "phrases", (nodes,))


def _linked(nodes: DataFrame, words: DataFrame, depth: int) -> DataFrame:
    """lang, path, a, lefts and rights of all cuts; right parts come along the suffix links, depth by depth."""
    one = words.select(F.col("lang").alias("w_lang"), F.array("key").alias("w_path"), F.col("n").alias("w_n"))
    first = nodes.join(one, (nodes["lang"] == one["w_lang"]) & (F.slice("path", 1, 1) == F.col("w_path")))
    nodes = first.select("lang", "path", "a", F.concat(F.array("w_n"), "lefts").alias("lefts"))
    below = one.select(F.col("w_lang").alias("t_lang"), F.col("w_path").alias("tail"), F.array("w_n").alias("t_rights"))
    out = None
    for d in range(2, depth + 1):
        own = nodes.where(F.size("path") == d)
        level = own.join(below, (F.col("lang") == F.col("t_lang")) & (F.slice("path", 2, d) == F.col("tail"))).select("lang", "path", "a", "lefts", F.col("t_rights").alias("rights"))
        below = level.select(F.col("lang").alias("t_lang"), F.col("path").alias("tail"), F.concat(F.array("a"), "rights").alias("t_rights"))
        out = level if out is None else out.unionByName(level)
    return out


def phrases(docs: DataFrame, longest: int = 5, least: int = 100, absorb: int = 100, limit: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``limit`` collocations of each language.

    A phrase goes if one that holds it has ``absorb`` per cent of its occurrences.
    """
    if not 2 <= longest <= 7 or least < 1:
        raise ValueError("phrases have 2 to 7 words, and occur once at least")
    R.prepare(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").alias("text"))
    counts, base = _counted(docs, longest, least)
    words, totals = counts.where(F.col("kind") == WORD), counts.where(F.col("kind") == TOTAL).select("lang", F.col("n").alias("all"))
    nodes = _nodes(docs, counts, base, longest, least)
    linked = R.stage(_linked(nodes, words, longest), "phrase-links", (nodes,))
    longer = linked.where(F.size("path") > 2).select("lang", "path", F.col("a").alias("b"))
    parts = longer.select("lang", "b", F.explode(F.array(F.expr("slice(path, 1, size(path) - 1)"), F.expr("slice(path, 2, size(path) - 1)"))).alias("path"))
    over = parts.groupBy("lang", "path").agg(F.max("b").alias("b"))
    left = linked.join(over, ["lang", "path"], "left").where(F.coalesce(F.col("b") * 100 < F.col("a") * absorb, F.lit(True))).join(totals, "lang")
    big = lambda x: F.col(x).cast("decimal(38,0)")
    left = left.withColumn("top", F.lit(1000).cast("decimal(38,0)") * big("a") * big("all"))
    cuts = F.expr("transform(lefts, (l, i) -> struct(cast(top div (cast(l as decimal(38,0)) * cast(rights[i] as decimal(38,0))) as long) as score, i as k, l as l, rights[i] as r))")
    best = left.withColumn("cut", F.array_min(cuts)).select("lang", "path", "a", "cut.l", "cut.r", F.col("all").alias("n"), "cut.score")
    by_count = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = best.withColumn("place", F.rank().over(by_count)).where(F.col("place") <= limit).drop("place")
    # Only what may still be listed gets its words.
    each = near.select("lang", "path", "a", "l", "r", "n", "score", F.posexplode("path").alias("at", "key"))
    named = each.join(words.select("lang", "key", "word"), ["lang", "key"])
    texts = named.groupBy("lang", "path", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return texts.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
