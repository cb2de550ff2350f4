"""Hard-negative mining over inverted lists of k-means clusters.

The index: k-means is fitted on a bounded sample of vectors (``sample_rows``
distinct ones, those of the smallest hashes; only the choice of centroids rests
on it; the tasks leave out all but about half as many more, so that the
driver's share doesn't grow with their number),
every row goes to its nearest centroid's list, and each list keeps its radius,
the largest distance of a member from the centroid.  A large list is kept in
several blocks of bounded size, so that one very common vector makes more
blocks, not a larger one.

By Cauchy-Schwarz, the scores of anchor ``a`` with the members of a list of
centroid ``c`` and radius ``r`` lie in ``[a.c - |a| r, a.c + |a| r]``.  A search
(top k scores in a window, among rows of the same or of another label) visits
lists in the order of their upper bounds, those outside its window never, and
stops when the next bound falls strictly below the kth score found: in rounds,
each of which visits more lists than the one before and only those that may
still matter.  The result is exact, ties included.

Anchors travel in blocks and meet list blocks in joins, so that a task holds
one block of either at a time; the best k of each pair of blocks are rows that
are ranked per search.

Components become integers by ``floor(scale * x)`` and scores are exact integer
inner products; if two vectors' product could leave 64 bits, ``ValueError``.

Edge cases: rows with a null label, id or vector, or a null or non-finite
component take no part; vectors of unequal length are compared as if the shorter
one ended in zeros; equal rows are one anchor, but each of them counts as a
candidate; a row of the anchor's own id is never its positive; ties go to the
smaller id; an anchor without a positive, or whose window is empty, has no rows;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R

#: Vectors on which k-means is fitted.
SAMPLE_ROWS = 16_384
#: Most centroids, and bytes of all centroids: they are sent to every task.
CENTROIDS, CENTROID_BYTES = 1024, 16 << 20
#: Rows of a list's block; anchors of a block.
LIST_ROWS, ANCHOR_ROWS = 8192, 512
#: Lists that a search visits at most in its first, second, ... round; the last round visits all that may matter.
ROUNDS = (4, 32, None)
#: Scores computed at once.
SCORES = 1 << 22
LEAST, MOST = -(2**63), 2**63 - 1

SEARCH_SCHEMA = "anchor long, slot int, candidate long, score long"


def kmeans(rows: np.ndarray, k: int, steps: int = 8, seed: int = 1) -> np.ndarray:
    """At most k centroids of distinct rows, by Lloyd's steps."""
    rows = np.unique(rows, axis=0).astype(np.float64)
    if len(rows) <= k:
        return rows
    centers = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(steps):
        near = nearest(rows, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return np.unique(centers, axis=0)


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    out = np.zeros(len(rows), np.int64)
    step = max(1, SCORES // max(1, len(centers)))
    for lo in range(0, len(rows), step):
        out[lo : lo + step] = (rows[lo : lo + step] @ centers.T - half).argmax(1)
    return out


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Packed 64-bit vectors, one a row, filled with zeros up to ``width``."""
    out = np.zeros((len(blobs), width), np.int64)
    for k, b in enumerate(blobs):
        v = np.frombuffer(b, "<i8")
        out[k, : len(v)] = v
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products (left x right)."""
    if not left.shape[1]:
        return np.zeros((len(left), len(right)), np.int64)
    norm = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)))
    bound = norm(left) * norm(right) * 1.001
    if bound < 2**53:  # all partial sums are exact in doubles
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return left @ right.T
    raise ValueError("components are so large that scores leave 64 bits")


def sampled(rows: DataFrame, kinds: int, most: int) -> DataFrame:
    """At most ``most`` distinct vectors, those of the smallest hashes; ``kinds``: about how many distinct ones there are.

    A sorted limit alone has every task send ``most`` rows to the driver: the hash lets some 1.5 times as many pass in all.
    """
    hashed = rows.select("vector", F.xxhash64("vector").alias("h"))
    share = 1.5 * most / max(kinds, 1)
    few = hashed.where(F.col("h") <= LEAST + int(share * 2**64)) if share < 1 else hashed
    return few.distinct().orderBy("h", "vector").limit(most).select("vector")


# --- the index ----------------------------------------------------------------------------------------------------


def _integers(scale: int):
    """Vectors to packed integers: id, label, vector binary, width int; rows that take no part go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            keep = (bad[at[1:]] == bad[at[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False)
            value = np.floor(np.where(np.isfinite(flat), flat, 0) * scale)
            if (np.abs(value) >= 2.0**62).any():
                raise ValueError("components are so large that scores leave 64 bits")
            value = value.astype("<i8")
            rows = np.flatnonzero(keep)
            take = pa.array(rows)
            vectors = pa.array([value[at[k] : at[k + 1]].tobytes() for k in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("label").take(take), vectors, pa.array(np.diff(at)[rows].astype(np.int32))], names=["id", "label", "vector", "width"])

    return work


@dataclass
class Shape:
    """What bounds need, of bounded size: centroids, radii (-1: an empty list), blocks of each list, components of a vector."""

    centers: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    width: int

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of each anchor in each list; a margin covers rounding."""
        a = anchors.astype(np.float64)
        norm = np.sqrt((a**2).sum(1))[:, None]
        middle, reach = a @ self.centers.T, norm * np.maximum(self.radius, 0)[None, :]
        slack = 1e-9 * (norm * np.sqrt((self.centers**2).sum(1))[None, :] + reach) + 1e-3
        lower, upper = middle - reach - slack, middle + reach + slack
        upper[:, self.radius < 0] = -np.inf
        return lower, upper


class Index:
    """Staged blocks of lists (cluster, block, ids, labels, vectors), and their shape."""

    def __init__(self, rows: DataFrame, sample_rows: int):
        spark = rows.sparkSession
        n, width, kinds = rows.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(0)), F.approx_count_distinct("vector")).head()
        sample = sampled(rows, kinds, sample_rows).toPandas()["vector"].tolist() if n else []
        k = int(max(1, min(CENTROIDS, CENTROID_BYTES // max(8 * width, 1), round(n**0.5))))
        centers = kmeans(matrix(sample, width), k) if n else np.zeros((1, width))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = matrix(b.column("vector").to_pylist(), width)
                near = nearest(v.astype(np.float64), centers)
                far = np.sqrt(((v - centers[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far), *(b.column(c) for c in ("id", "label", "vector"))], names=["cluster", "far", "id", "label", "vector"])

        placed = R.stage(R.map_arrow(rows.select("id", "label", "vector"), assign, "cluster int, far double, id long, label long, vector binary"), "negatives-rows")
        # One row a centroid, of which there are a bounded number.
        found = placed.groupBy("cluster").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()
        radius, blocks = np.full(len(centers), -1.0), np.zeros(len(centers), np.int64)
        for r in found:
            radius[r["cluster"]], blocks[r["cluster"]] = r["far"] * (1 + 1e-9) + 1e-6, -(-r["n"] // LIST_ROWS)
        self.shape = Shape(centers, radius, blocks, width)
        parts = spark.createDataFrame(list(enumerate(blocks.tolist())), "part_of int, parts long")
        dealt = placed.join(F.broadcast(parts), F.col("cluster") == F.col("part_of"))
        salted = dealt.select("cluster", F.pmod(F.xxhash64("id", F.spark_partition_id(), F.monotonically_increasing_id()), "parts").alias("block"), "id", "label", "vector")
        # A block's rows meet one task's memory: LIST_ROWS of them, give or take the hash's scatter.
        self.lists = R.stage(salted.groupBy("cluster", "block").applyInArrow(_block, "cluster int, block long, ids binary, labels binary, vectors binary"), "negatives-lists", (placed,))
        self.spark = spark


def _block(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    ids, labels = table.column("id").to_numpy()[order], table.column("label").to_numpy()[order]
    blobs = table.column("vector").to_pylist()
    width = max((len(b) for b in blobs), default=0) // 8
    v = matrix([blobs[k] for k in order], width)
    top = int(np.abs(v).max(initial=0))
    kind = np.dtype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")
    head = np.array([width, kind.itemsize], np.int64).tobytes()
    return pa.table({"cluster": table.column("cluster")[:1], "block": table.column("block")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "labels": pa.array([labels.tobytes()], pa.binary()), "vectors": pa.array([head + v.astype(kind).tobytes()], pa.binary())})


def _vectors(blob: bytes, width: int) -> np.ndarray:
    own, size = np.frombuffer(blob, np.int64, 2).tolist()
    v = np.frombuffer(blob, f"<i{size}", -1, 16)
    out = np.zeros((len(v) // own if own else 0, width), np.int64)
    if own:
        out[:, :own] = v.reshape(-1, own)
    return out


# --- the search ---------------------------------------------------------------------------------------------------


def best_of_block(anchors: np.ndarray, own_label: np.ndarray, own_id: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search, row of the block, score): the best k of the block for each search; ``at`` gives a search's anchor.  Ids ascend."""
    found = []
    step = max(1, SCORES // max(1, len(ids)))
    for lo in range(0, len(at), step):
        mine = at[lo : lo + step]
        used, of = np.unique(mine, return_inverse=True)
        score = products(anchors[used], rows)
        fit = (labels[None, :] == own_label[used][:, None]) & (ids[None, :] != own_id[used][:, None]) if same else labels[None, :] != own_label[used][:, None]
        score, fit = score[of], fit[of] & (score[of] >= low[lo : lo + step, None]) & (score[of] <= high[lo : lo + step, None])
        search, row = np.nonzero(fit)
        value = score[search, row]
        order = np.lexsort((row, -value, search))
        search, row, value = search[order], row[order], value[order]
        first = np.searchsorted(search, np.arange(len(mine)))
        keep = np.arange(len(search)) - first[search] < k
        found.append((search[keep] + lo, row[keep], value[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _visit(shape: Shape, most: int | None, before: int):
    """Blocks of searches to the lists that they visit in this round: those of their best bounds, ranks ``before`` to ``most``, as long as they may matter."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lo in range(0, len(frame), ANCHOR_ROWS):
                part = frame.iloc[lo : lo + ANCHOR_ROWS]
                a = matrix(part["vector"].tolist(), shape.width)
                lower, upper = shape.bounds(a)
                low, high, kth = (part[c].to_numpy(np.float64)[:, None] for c in ("low", "high", "kth"))
                # Bounds beyond the window's top count as its top: such lists tie, the one whose middle is nearest to the window goes first.
                bound = np.minimum(upper, high)
                away = np.abs(np.clip((lower + upper) / 2, low, high) - (lower + upper) / 2)
                order = np.lexsort((away, -bound))
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
                go = (rank >= before) & (upper >= low) & (lower <= high) & (bound >= kth) & (shape.blocks > 0)[None, :]
                if most is not None:
                    go &= rank < most
                for c in np.flatnonzero(go.any(0)).tolist():
                    rows = np.flatnonzero(go[:, c])
                    blob = lambda name, kind: part[name].to_numpy()[rows].astype(kind).tobytes()  # noqa: E731, B023
                    packed = {"anchor": blob("anchor", "<i8"), "slot": blob("slot", "<i4"), "id": blob("id", "<i8"), "label": blob("label", "<i8"), "low": np.maximum(part["low"].to_numpy()[rows], part["kth"].to_numpy()[rows]).astype("<i8").tobytes(), "high": blob("high", "<i8"), "vectors": a[rows].astype("<i8").tobytes()}
                    for block in range(int(shape.blocks[c])):
                        yield pd.DataFrame([{"cluster": c, "block": block, **packed}])

    return work


VISIT_SCHEMA = "cluster int, block long, anchor binary, slot binary, id binary, label binary, low binary, high binary, vectors binary"


def _score(width: int, same: bool, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                get = lambda name, kind="<i8": np.frombuffer(row[name], kind)  # noqa: E731, B023
                anchor, slot = get("anchor"), get("slot", "<i4")
                v = get("vectors").reshape(len(anchor), -1) if width else np.zeros((len(anchor), 0), np.int64)
                # Searches of one anchor stand side by side: its products are computed once.
                first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(anchor))))
                ids = np.frombuffer(row["ids"], "<i8")
                search, place, score = best_of_block(v[first], get("label")[first], get("id")[first], at, get("low"), get("high"), ids, np.frombuffer(row["labels"], "<i8"), _vectors(row["list"], width), same, k)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[search]), pa.array(slot[search]), pa.array(ids[place]), pa.array(score)], names=["anchor", "slot", "candidate", "score"])

    return work


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each search, in order; ``rank`` from 1 on."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, searches: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, slot, candidate, score, rank) of all searches (anchor, slot, id, label, vector, low, high): staged."""
    found, before, old = None, 0, ()
    for most in ROUNDS:
        if found is None:
            ready = searches.withColumn("kth", F.lit(LEAST))
        else:
            # The kth score so far: lists whose bound is strictly below it are never visited.
            kth = found.where(F.col("rank") == k).select(F.col("anchor").alias("a"), F.col("slot").alias("s"), F.col("score").alias("kth"))
            ready = searches.join(kth, (F.col("anchor") == F.col("a")) & (F.col("slot") == F.col("s")), "left").drop("a", "s").withColumn("kth", F.coalesce("kth", F.lit(LEAST)))
        # Searches of near anchors share a block, so that it visits few lists.
        blocks = ready.select("anchor", "slot", "id", "label", "vector", "low", "high", "kth", "cluster").repartitionByRange(_tasks(index), "cluster", "anchor").sortWithinPartitions("cluster", "anchor", "slot")
        visits = blocks.drop("cluster").mapInPandas(_visit(index.shape, most, before), VISIT_SCHEMA)
        lists = index.lists.select(F.col("cluster").alias("c"), F.col("block").alias("b"), "ids", "labels", F.col("vectors").alias("list"))
        # A few anchors make many visits, which Spark can't foresee: without the hint it may gather them on the driver to broadcast them.
        met = visits.join(lists.hint("merge"), (F.col("cluster") == F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
        new = R.map_arrow(met, _score(index.shape.width, same, k), SEARCH_SCHEMA)
        new = new if found is None else new.unionByName(found.drop("rank"))
        found = R.stage(_top(new, k), "negatives-found", old)
        old, before = (found,), most
        if most is not None and most >= len(index.shape.centers):
            break
    return found


def _tasks(index: Index) -> int:
    return int(index.spark.conf.get("spark.sql.shuffle.partitions"))


def hard_negatives(rows: DataFrame, anchors: Column, id_: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 10, least_share: int = 30, most_share: int = 90, scale: int = 256, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchors`` marks rows whose id is an anchor.

    An anchor's positives are its first rows of the same label; the negatives of
    a positive are the first rows of other labels whose score lies between the
    two shares (per cent) of the positive's score.
    """
    R.prepare(rows.sparkSession)
    chosen = rows.select(F.col(id_).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    usable = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    whole = R.stage(R.map_arrow(usable.select("id", "label", "vector"), _integers(scale), "id long, label long, vector binary, width int"), "negatives-whole")
    index = Index(whole, sample_rows)
    marks = usable.where("is_anchor").select("id").distinct()
    mine = whole.join(marks, "id", "left_semi").select("id", "label", "vector").distinct()
    mine = mine.withColumn("anchor", F.monotonically_increasing_id())  # fixed as soon as it is staged
    centers, width = index.shape.centers, index.shape.width

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest(matrix(b.column("vector").to_pylist(), width).astype(np.float64), centers)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "cluster"])

    mine = R.stage(R.map_arrow(mine, place, "id long, label long, vector binary, anchor long, cluster int"), "negatives-anchors", (whole,))
    first = mine.withColumns({"slot": F.lit(0), "low": F.lit(LEAST), "high": F.lit(MOST)})
    near = search(index, first, True, positives).select("anchor", F.col("rank").alias("slot"), F.col("candidate").alias("positive_id"), F.col("score").alias("positive_score"))
    low = F.expr(f"({least_share} * positive_score + pmod(-({least_share} * positive_score), 100)) div 100")  # rounded up
    high = F.expr(f"({most_share} * positive_score - pmod({most_share} * positive_score, 100)) div 100")  # rounded down
    windows = near.withColumns({"low": low, "high": high})
    windows = R.stage(windows, "negatives-windows")
    second = mine.join(windows.where("low <= high").select("anchor", "slot", "low", "high"), "anchor")
    found = search(index, second, False, negatives)
    named = found.join(windows.select("anchor", "slot", "positive_id", "positive_score"), ["anchor", "slot"]).join(mine.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("candidate").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
