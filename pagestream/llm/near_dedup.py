"""Near-dedup by SimHash, completed to a similarity: no pair of documents at or above it is lost.

First the SimHash operator: fingerprints of all texts, linked through Golay keys
at 2 or fewer differing bits.  Its links are candidates, those at or above the
similarity hold.  Pairs whose fingerprints are further apart (at 0.8 some ten
bits) are found by an exact way, which doesn't compare again what SimHash has
joined.

Of a document's n distinct shingles any document with similarity s shares
ceil(s * n) or more.  Two similar documents whose shingles stand in one order
(here: by hash) have k shingles in common among the first
n - ceil(s * n) + k of each.  ``lead`` takes k = (1 - s) * n of them, and a
document that doesn't find ``needed`` of its leading shingles in other
documents has no similar one: passages that many documents share don't make
candidates.  What is left are mostly true copies.

Among these, equal shingle sets are one class.  Shingles are ordered by the
number of classes that have them, and two similar classes share one of their
first n - ceil(s * n) + 1.  Classes that do form candidate components.  Each
component goes to one task, which compares complete shingle sets until every
similar pair is linked.  A component beyond one task's bounds is cut into
blocks; each block is settled together with the component's most typical
classes, and then all blocks meet those that hold classes which are not linked
to the largest rest yet, so that no link is lost that would join two parts.

Edge cases: null and blank texts have no shingles and are left alone, but equal
ones count as copies; texts shorter than a shingle make one; null ids count as
one id before all others; ids are taken as unique, and rows that repeat one id
share its verdict; extra columns may have any names; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R
from .components import components
from .simhash import _LOWER, links, with_fingerprints

#: A block of a component: documents, and shingles of all of them, at most.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 19
#: Typical documents of a large component, each of which meets all blocks.
HUBS = 4
#: Words of a fingerprint's shingle.
PRINT_SIZE = 3
#: Entries of a packed chunk.
FLUSH = 1 << 20
ENTRY_SCHEMA = "bucket int, k1 binary, known binary, docs binary, side binary, side_count binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all distinct shingles, sorted."""
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in A.slices(offsets):
        text, where = _LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = A.words(text, where)
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        at = np.repeat(first[:-1], count) + A.spread(count)
        end = np.minimum(at + size, np.repeat(first[1:], count))
        key = A.ranged(A.prefix(A.word_hashes(text, starts, ends), 1), at, end, 1)
        doc = np.repeat(np.arange(lo, hi), count)
        order = np.lexsort((key, doc))
        fresh = A.group_starts(doc[order], key[order])
        docs.append(doc[order][fresh])
        keys.append(key[order][fresh])
    return np.concatenate(docs), np.concatenate(keys)


def least_overlap(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that a document of ``n`` shares with any similar one, at least; rounded down where rounding is in doubt."""
    return np.maximum(np.ceil(similarity * n - 1e-6).astype(np.int64), 1)


def _extra(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(np.maximum(((1 - similarity) * n).astype(np.int64), 1), least_overlap(n, similarity))


def lead(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of its first shingles a document of ``n`` looks up."""
    return n - least_overlap(n, similarity) + _extra(n, similarity)


def needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of these any similar document has among its own, at least: even one with the fewest shingles that are enough."""
    return _extra(least_overlap(n, similarity), similarity)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(40)).astype(np.int64) % buckets


def _entries(key: np.ndarray, doc: np.ndarray, need: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """One chunk, its equal keys collapsed: the first entry goes to the key's bucket, the others count as found already.

    Beside these, by document: entries found already, less those that are needed.
    """
    order = np.argsort(key, kind="stable")
    fresh = A.group_starts(key[order])
    at = np.flatnonzero(fresh)
    known = np.diff(np.append(at, len(order))) > 1
    first = order[at]
    turn = np.argsort(first)  # a document's entries together
    first, known = first[turn], known[turn]
    side = np.concatenate([doc[order[~fresh]], need["doc"]])
    value = np.concatenate([np.ones((~fresh).sum(), np.int64), -need["n"]])
    side, of = np.unique(side, return_inverse=True)
    total = np.bincount(of, weights=value, minlength=len(side)).astype(np.int64)
    sides = dict(R.by_bucket(R.doc_bucket(side, buckets)))
    mains = dict(R.by_bucket(_bucket(key[first], buckets)))
    rows, none = [], np.zeros(0, np.int64)
    for b in sorted(sides.keys() | mains.keys()):
        i, s = mains.get(b, none), sides.get(b, none)
        m = first[i]
        rows.append((b, key[m].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.packbits(known[i]).tobytes(), R.pack_docs(doc[m]), side[s].tobytes(), total[s].astype(np.int32).tobytes()))
    return R.batch(rows, ["bucket", "k1", "known", "docs", "side", "side_count"])


def _probe(size: int, similarity: float, buckets: int):
    """Leading shingles of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        entries = 0

        def flush() -> pa.RecordBatch:
            key, doc, ids, need = (np.concatenate(x) for x in zip(*held, strict=True))
            return _entries(key, doc, {"doc": ids, "n": need}, buckets)

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, key = shingle_sets(*A.strings(b.column(1)), size)
            n = np.bincount(doc, minlength=len(ids))
            pick = A.spread(n) < lead(n, similarity)[doc]
            some = n > 0
            held.append((key[pick], ids[doc[pick]], ids[some], needed(n, similarity)[some]))
            entries += int(pick.sum())
            if entries >= FLUSH:
                yield flush()
                held, entries = [], 0
        if held:
            yield flush()

    return work


def _forty_bits(table: pa.Table) -> np.ndarray:
    packed = R.column(table, "k1", np.uint8).reshape(-1, 5)
    full = np.zeros((len(packed), 8), np.uint8)
    full[:, :5] = packed
    return full.view(np.uint64).ravel()


def _found(buckets: int):
    """In a bucket of keys: how many entries of each document are found in others."""

    def work(table: pa.Table) -> pa.Table:
        key, doc = _forty_bits(table), R.docs_of(table, "docs")
        bits = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(k) // 5] for x, k in zip(table.column("known").to_pylist(), table.column("k1").to_pylist(), strict=True)]
        known = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)
        order = np.argsort(key, kind="stable")
        fresh = A.group_starts(key[order])
        n = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        hit = np.repeat(n > 1, n) | known[order]
        doc = np.concatenate([doc[order[hit]], R.column(table, "side", np.int64)])
        value = np.concatenate([np.ones(hit.sum(), np.int64), R.column(table, "side_count", np.int32).astype(np.int64)])
        doc, of = np.unique(doc, return_inverse=True)
        total = np.bincount(of, weights=value, minlength=len(doc)).astype(np.int64)
        rows = [(b, doc[i].tobytes(), total[i].astype(np.int32).tobytes()) for b, i in R.by_bucket(R.doc_bucket(doc, buckets))]
        return pa.Table.from_batches([R.batch(rows, ["bucket", "doc", "n"])])

    return work


def _enough(table: pa.Table) -> pa.Table:
    doc, of = np.unique(R.column(table, "doc", np.int64), return_inverse=True)
    total = np.bincount(of, weights=R.column(table, "n", np.int32), minlength=len(doc))
    return pa.table({"candidate": pa.array(doc[total >= 0], pa.int64())})


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, key = shingle_sets(*A.strings(b.column(1)), size)
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            raw = [key[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["doc_id", "shingles"])

    return work


def _dealt(buckets: int):
    """All shingles of the classes, by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, where = A.strings(b.column(1))
            key, n = np.frombuffer(data.tobytes(), np.uint64), np.diff(where) // 8
            yield _entries_plain(key, np.repeat(ids, n), {"doc": ids, "n": n}, buckets)

    return work


def _entries_plain(key: np.ndarray, doc: np.ndarray, sizes: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    mains = dict(R.by_bucket(_bucket(key, buckets)))
    sides = dict(R.by_bucket(R.doc_bucket(sizes["doc"], buckets)))
    rows, none = [], np.zeros(0, np.int64)
    for b in sorted(sides.keys() | mains.keys()):
        i, s = mains.get(b, none), sides.get(b, none)
        rows.append((b, key[i].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), b"", R.pack_docs(doc[i]), sizes["doc"][s].tobytes(), sizes["n"][s].astype(np.int32).tobytes()))
    return R.batch(rows, ["bucket", "k1", "known", "docs", "side", "side_count"])


def _counted(buckets: int):
    """In a bucket of keys: each shared key with its count, back to the documents."""

    def work(table: pa.Table) -> pa.Table:
        key, doc = _forty_bits(table), R.docs_of(table, "docs")
        bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
        order = np.argsort(key, kind="stable")
        fresh = A.group_starts(key[order])
        n = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        n = np.repeat(n, n)
        key, doc, n = key[order][n > 1] | np.uint64(bucket) << np.uint64(40), doc[order][n > 1], n[n > 1]
        side, size = R.column(table, "side", np.int64), R.column(table, "side_count", np.int32)
        mains, sides = dict(R.by_bucket(R.doc_bucket(doc, buckets))), dict(R.by_bucket(R.doc_bucket(side, buckets)))
        rows, none = [], np.zeros(0, np.int64)
        for b in sorted(sides.keys() | mains.keys()):
            i, s = mains.get(b, none), sides.get(b, none)
            rows.append((b, key[i].tobytes(), doc[i].tobytes(), n[i].astype(np.uint32).tobytes(), side[s].tobytes(), size[s].tobytes()))
        return pa.Table.from_batches([R.batch(rows, ["bucket", "key", "doc", "n", "side", "side_count"])])

    return work


def _first_keys(similarity: float):
    """Of each document the keys it looks up: the rarest ones come first, and those without a partner before all."""

    def work(table: pa.Table) -> pa.Table:
        key, doc, n = R.column(table, "key", np.uint64), R.column(table, "doc", np.int64), R.column(table, "n", np.uint32).astype(np.int64)
        ids, size = R.column(table, "side", np.int64), R.column(table, "side_count", np.int32).astype(np.int64)
        order = np.lexsort((key, n, doc))
        key, doc, n = key[order], doc[order], n[order]
        turn = np.argsort(ids, kind="stable")
        ids, size = ids[turn], size[turn]
        at = np.searchsorted(doc, ids)
        shared = np.searchsorted(doc, ids, "right") - at
        take = np.clip(size - least_overlap(size, similarity) + 1 - (size - shared), 0, shared)
        sums = np.concatenate([[0], np.cumsum(n)])
        weight = (sums[at + shared] - sums[at]) / np.maximum(size, 1)
        some = np.flatnonzero(take)
        keys = [key[a : a + t].tobytes() for a, t in zip(at[some].tolist(), take[some].tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(ids[some], pa.int64()), "weight": pa.array(weight[some], pa.float64()), "size": pa.array(size[some], pa.int64()), "keys": pa.array(keys, pa.binary())})

    return work


def _by_key(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, where = A.strings(b.column(1))
            key, doc = np.frombuffer(data.tobytes(), np.uint64), np.repeat(ids, np.diff(where) // 8)
            order = np.lexsort((doc, key))
            fresh = A.group_starts(key[order])
            low = doc[order][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(key) else doc
            # In a chunk, all documents of a key hang on the least; only that one goes on.
            pairs = np.unique(np.stack([low[~fresh], doc[order][~fresh]], 1), axis=0)
            k, d = key[order][fresh], doc[order][fresh]
            rows = [(int(x), k[i].tobytes(), d[i].tobytes(), b"", b"") for x, i in R.by_bucket((A.mix(k) >> np.uint64(33)).astype(np.int64) % buckets)]
            rows += [(int(x), b"", b"", pairs[i, 0].tobytes(), pairs[i, 1].tobytes()) for x, i in R.by_bucket(R.doc_bucket(np.ascontiguousarray(pairs[:, 0]), buckets))]
            yield R.batch(rows, ["bucket", "key", "doc", "a", "b"])

    return work


def _hung(table: pa.Table) -> pa.Table:
    key, doc = R.column(table, "key", np.uint64), R.column(table, "doc", np.int64)
    order = np.lexsort((doc, key))
    fresh = A.group_starts(key[order])
    low = doc[order][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(key) else doc
    a, b = np.concatenate([low, R.column(table, "a", np.int64)]), np.concatenate([doc[order], R.column(table, "b", np.int64)])
    pairs = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def forest(first: np.ndarray, values: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a ``left`` and a ``right`` set that are similar and join two labels, until no similar pair is left apart.

    Set i is values[first[i]:first[i + 1]].
    """
    values, at = np.unique(values, return_inverse=True)
    n = np.diff(first)
    label = label.copy()
    mark = np.zeros(len(values) + 1, np.int32)
    links: list[tuple[int, int]] = []
    rank = np.arange(len(n))
    for x in np.flatnonzero(left).tolist():
        others = right & (~left | (rank > x)) & (label != label[x]) & (np.minimum(n, n[x]) >= similarity * np.maximum(n, n[x]) - 1e-9) & (n > 0)
        y = np.flatnonzero(others)
        if not len(y):
            continue
        own = at[first[x] : first[x + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[at[np.repeat(first[y], n[y]) + A.spread(n[y])]], np.cumsum(n[y]) - n[y])
        mark[own] = 0
        for z in y[common >= similarity * (n[x] + n[y] - common) - 1e-9].tolist():
            if label[z] != label[x]:
                links.append((x, z))
                label[label == label[z]] = label[x]
    return links


def print_pairs(texts: DataFrame, size: int = PRINT_SIZE) -> DataFrame:
    """Pairs (a, b) of ids that SimHash links: those of one fingerprint with its least id, and the least ids of linked fingerprints."""
    marked = R.stage(with_fingerprints(texts, size), "near-prints")
    classes = R.stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "near-print-classes")
    within = marked.join(classes, "fp").where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    end = lambda fp, name: classes.select(F.col("fp").alias(fp), F.col("first").alias(name))
    across = links(classes).select(F.col("a").alias("x"), F.col("b").alias("y")).join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b")
    return R.stage(within.unionByName(across), "near-print-pairs", (marked, classes))


def _similar(similarity: float):
    """Those of the pairs (a, b, one, two) whose shingle sets are similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column("one"), b.column("two"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = len(x) > 0 and common >= similarity * (len(x) + len(y) - common) - 1e-9
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return work


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose complete shingle sets are similar."""
    end = lambda name, blob: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(blob))
    both = pairs.join(end("a", "one"), "a").join(end("b", "two"), "b").select("a", "b", "one", "two")
    return R.map_arrow(both, _similar(similarity), "a long, b long")


def _settle(similarity: float):
    """Links of all similar pairs within each ``part`` of a bucket: between a marked document and any, as far as labels differ."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, part = table.column("doc_id").to_numpy(), table.column("part").to_numpy()
        root, left = table.column("root").to_numpy(), table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        data, where = A.strings(table.column("shingles"))
        values, first = np.frombuffer(data.tobytes(), np.uint64), where // 8
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(A.group_starts(part[order]))
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        for lo, hi in R.runs(edge, len(order)):
            i = order[lo:hi]
            i = i[np.argsort(-np.diff(first)[i], kind="stable")]
            n = np.diff(first)[i]
            flat = values[np.repeat(first[i], n) + A.spread(n)]
            right = ~left[i]  # two blocks; or one, with itself
            pairs = forest(np.concatenate([[0], np.cumsum(n)]), flat, root[i], left[i], right if right.any() else left[i], similarity)
            if pairs:
                found.append(ids[i][np.array(pairs)])
        out = np.concatenate(found)
        return pa.table({"a": pa.array(out[:, 0], pa.int64()), "b": pa.array(out[:, 1], pa.int64())})

    return work


def _links_of_large(large: DataFrame, sets: DataFrame, seen: DataFrame, similarity: float) -> DataFrame:
    """Links of components (comp, doc_id, size, weight, blocks, root) that don't fit one task; ``seen``: links that are known, by which roots go."""
    hubs = large.groupBy("comp", "blocks").agg(F.max_by(F.col("doc_id"), "weight").alias("h0"), *(F.max_by("doc_id", F.struct(F.xxhash64("doc_id", F.lit(k)))).alias(f"h{k}") for k in range(1, HUBS)))
    hubs = hubs.select("comp", "blocks", F.explode(F.array_distinct(F.array(*(f"h{k}" for k in range(HUBS))))).alias("doc_id"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(0)), F.col("blocks")).cast("int")
    everywhere = hubs.select("comp", "doc_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = large.select("comp", "doc_id", block.alias("block")).unionByName(everywhere.select("comp", "doc_id", "block")).distinct()
    part = F.xxhash64("comp", "block")
    rows = dealt.join(large.select("doc_id", "root").distinct(), "doc_id").select("doc_id", part.alias("part"), "root", F.lit(True).alias("left")).join(sets, "doc_id")
    within = R.stage(_settled(rows, similarity, 1 << 20).unionByName(seen), "near-within")
    roots = components(within).withColumnRenamed("node", "doc_id")
    rooted = R.stage(large.drop("root").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "near-rooted")
    # The root with most documents is the rest; whoever isn't linked to it meets everyone.
    count = rooted.groupBy("comp", "root").agg(F.count("*").alias("n"))
    main = count.groupBy("comp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    apart = rooted.join(main, "comp").withColumn("open", F.col("root") != F.col("main"))
    opens = apart.where("open").groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("open_blocks"))
    split = apart.join(opens, "comp").withColumn("block", F.when(F.col("open"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("open_blocks"))).otherwise(F.col("open_blocks") + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks"))).cast("int"))
    # Pair (i, j), i <= j, with an open block i: an open document goes with all blocks, another one with the open ones.
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("open"), F.col("open_blocks") + F.col("blocks")).otherwise(F.col("open_blocks")) - 1))
    pairs = split.withColumn("other", other).select("doc_id", "root", F.xxhash64("comp", F.least("block", "other"), F.greatest("block", "other")).alias("part"), (F.col("block") <= F.col("other")).alias("left")).join(sets, "doc_id")
    return R.stage(within.unionByName(_settled(pairs, similarity, 1 << 20)), "near-large", (rooted, within))


def _settled(rows: DataFrame, similarity: float, buckets: int) -> DataFrame:
    """rows(doc_id, part, root, left, shingles) by part."""
    bucket = F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int")
    return R.group_arrow(rows.select(bucket.alias("bucket"), "part", "doc_id", "root", "left", "shingles"), _settle(similarity), "a long, b long")


def similar_links(texts: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) between ids of ``texts`` (doc_id, text), verified at the similarity: they connect all similar pairs."""
    pairs = print_pairs(texts)
    buckets = R.bucket_count(texts)
    probe = R.map_arrow(texts.select("doc_id", "text"), _probe(size, similarity, buckets), ENTRY_SCHEMA)
    found = R.group_arrow(probe, _found(buckets), "bucket int, doc binary, n binary")
    candidates = R.stage(R.group_arrow(found, _enough, "candidate long"), "near-candidates")
    few = R.small_side(candidates)
    near = texts.join(few, F.col("doc_id") == F.col("candidate"), "left_semi").select("doc_id", "text")
    all_sets = R.stage(R.map_arrow(near, _sets(size), "doc_id long, shingles binary").withColumn("h", F.md5("shingles")), "near-sets", (candidates,))
    # Equal sets are one class, which goes by its least id.
    classes = all_sets.groupBy("h").agg(F.min("doc_id").alias("a"))
    same = R.stage(all_sets.select("h", F.col("doc_id").alias("b")).join(classes, "h").where("a <> b").select("a", "b"), "near-same")
    sets = R.stage(all_sets.join(R.small_side(same.select(F.col("b").alias("later")).distinct()), F.col("doc_id") == F.col("later"), "left_anti").select("doc_id", "shingles"), "near-classes", (all_sets,))
    seen = R.stage(verified(pairs, sets, similarity), "near-seen", (pairs,))
    printed = components(seen)
    joined = printed.select(F.col("node").alias("joined"), "root")
    buckets = R.bucket_count(sets)
    counted = R.group_arrow(R.map_arrow(sets, _dealt(buckets), ENTRY_SCHEMA), _counted(buckets), "bucket int, key binary, doc binary, n binary, side binary, side_count binary")
    firsts = R.stage(R.group_arrow(counted, _first_keys(similarity), "doc_id long, weight double, size long, keys binary"), "near-first")
    hung = R.group_arrow(R.map_arrow(firsts.select("doc_id", "keys"), _by_key(buckets), "bucket int, key binary, doc binary, a binary, b binary"), _hung, "a long, b long")
    comps = components(hung)
    members = firsts.select("doc_id", "weight", "size").join(comps, F.col("doc_id") == F.col("node")).select("doc_id", "weight", "size", F.col("root").alias("comp"))
    members = members.join(joined, F.col("doc_id") == F.col("joined"), "left").drop("joined").withColumn("root", F.coalesce("root", "doc_id"))
    members = R.stage(members, "near-members", (firsts, comps, printed))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    shape = members.groupBy("comp").agg(blocks.alias("blocks"))
    shaped = R.stage(members.join(shape, "comp"), "near-shaped", (members,))
    fit = shaped.where("blocks = 1").select("doc_id", F.col("comp").alias("part"), "root", F.lit(True).alias("left")).join(sets, "doc_id")
    every = same.unionByName(seen).unionByName(_settled(fit, similarity, buckets))
    large = shaped.where("blocks > 1")
    if not large.isEmpty():
        every = every.unionByName(_links_of_large(large, sets, seen, similarity))
    return R.stage(every, "near-links", (shaped, sets, same, seen))


def near_dedup(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents (all columns) without near copies: of each group of linked documents the smallest id stays."""
    spark = docs.sparkSession
    R.prepare(spark)
    body = F.coalesce("text", F.lit(""))
    same = R.keyed(docs, body.alias("text")).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))
    copies = same.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = R.stage(same.join(copies, "h").where("doc_id > first").select(F.col("doc_id").alias("gone_id")).distinct(), "copies")
    texts = R.without(R.keyed(docs, "text"), later)
    links = similar_links(texts, size, similarity)
    roots = components(links)
    gone = R.stage(later.unionByName(roots.where("node <> root").select(F.col("node").alias("gone_id"))).distinct(), "near-gone", (links, roots))
    R.drop(later)
    return R.without(docs, gone)
