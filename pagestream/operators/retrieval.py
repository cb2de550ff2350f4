"""Ranking metrics of vector queries against a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, LongType, ShortType, StructField, StructType

from pagestream.shipping import shared_folder, ship

#: Queries of a block, about; blocks are made by a hash of the id.
BLOCK = 1024
#: Numbers of a piece of vectors, and scores held at once in a task.
CELLS = 1 << 20
LAST = np.iinfo(np.int64).max


def _label(df: DataFrame) -> Column:
    """A gold as a number or text that compares exactly, null included: nobody's number is beyond what an int holds."""
    if isinstance(df.schema["gold"].dataType, (ByteType, ShortType, IntegerType)):
        return F.coalesce(F.col("gold").cast("long"), F.lit(LAST))
    return F.col("gold").cast("string")


def _pieces(vectors: DataFrame) -> DataFrame:
    """Vectors packed by partition, in rows of at most ``CELLS`` numbers, with the greatest norm of each row; no shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                wide = max(1, len(b.column(2)[lo]))
                part = b.slice(lo, max(1, min(CELLS // wide, CELLS // BLOCK)))
                lo += part.num_rows
                flat = part.column(2).flatten().cast(pa.float64())
                norm = np.sqrt((flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) ** 2).sum(1)).max()
                one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column(0), part.column(1), flat)]
                yield pa.RecordBatch.from_arrays([*one, pa.array([float(norm)])], names=["ids", "golds", "flat", "reach"])

    rows = vectors.select(F.col("id").cast("long"), _label(vectors).alias("gold"), "embedding")
    gold = rows.schema["gold"].dataType
    out = StructType([StructField("ids", ArrayType(LongType())), StructField("golds", ArrayType(gold)), StructField("flat", ArrayType(DoubleType())), StructField("reach", DoubleType())])
    return rows.mapInArrow(pack, out)


def _blocks(queries: DataFrame, blocks: int, *more: str) -> DataFrame:
    """Queries packed into rows (block, queries), one partition a block, about."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    each = F.struct(F.col("id").cast("long").alias("id"), _label(queries).alias("gold"), F.col("embedding").cast("array<double>").alias("embedding"), *more)
    return queries.where("gold is not null").select(block.alias("block"), each.alias("q")).repartition(blocks, "block").groupBy("block").agg(F.collect_list("q").alias("queries"))


def _meet(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each piece with each block, partition by partition in the tasks: vectors stream past one partition's blocks at a time."""
    return pieces.crossJoin(blocks.hint("shuffle_replicate_nl")).select("block", "queries", "ids", "golds", "flat", "reach")


class _Queries:
    """A block's queries as arrays."""

    def __init__(self, rows: pa.StructArray):
        self.ids = rows.field("id").to_numpy(zero_copy_only=False)
        self.gold = rows.field("gold").to_numpy(zero_copy_only=False)
        self.matrix = rows.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        self.rows = rows

    def scores(self, ids: np.ndarray, flat: np.ndarray) -> np.ndarray:
        return np.round(self.matrix @ flat.reshape(len(ids), -1).T, 9)


class _Best(_Queries):
    """The best ``depth`` vectors of each query so far, the best of its own label, and how many of that label there are."""

    def __init__(self, rows: pa.StructArray, depth: int):
        super().__init__(rows)
        n = len(self.ids)
        self.norms = np.sqrt((self.matrix**2).sum(1))
        self.score, self.other, self.hit = np.full((n, depth), -np.inf), np.full((n, depth), LAST), np.zeros((n, depth), bool)
        self.own_score, self.own_id, self.relevant = np.full(n, -np.inf), np.full(n, LAST), np.zeros(n, np.int64)

    def add(self, ids: np.ndarray, golds: np.ndarray, flat: np.ndarray, reach: float) -> None:
        same = ids[None, :] == self.ids[:, None]
        hit = golds[None, :] == self.gold[:, None]
        self.relevant += (hit & ~same).sum(1)
        # By Cauchy-Schwarz no vector here scores above this; what is below all that is kept can't change it.
        bound = self.norms * reach * (1 + 1e-9) + 1e-6
        if (bound < np.minimum(self.score[:, -1], self.own_score)).all():
            return
        score = np.where(same, -np.inf, self.scores(ids, flat))
        of_gold = np.where(hit, score, -np.inf)
        top = of_gold.max(1)
        top_id = np.where(np.isfinite(of_gold) & (of_gold == top[:, None]), ids, LAST).min(1)
        better = (top > self.own_score) | ((top == self.own_score) & (top_id < self.own_id))
        self.own_score, self.own_id = np.where(better, top, self.own_score), np.where(better, top_id, self.own_id)
        score, other = np.hstack([self.score, score]), np.hstack([self.other, np.broadcast_to(ids, (len(self.ids), len(ids)))])
        order = np.lexsort((other, -score), axis=1)[:, : self.score.shape[1]]
        self.score, self.other, self.hit = (np.take_along_axis(x, order, 1) for x in (score, other, np.hstack([self.hit, hit])))

    def out(self) -> pa.RecordBatch:
        q, k = np.nonzero(np.isfinite(self.score))
        far = np.flatnonzero(np.isfinite(self.own_score) & ~(self.hit & np.isfinite(self.score)).any(1))
        columns = [
            np.append(self.ids[q], self.ids[far]),
            np.append(self.other[q, k], self.own_id[far]),
            np.append(self.score[q, k], self.own_score[far]),
            np.append(self.hit[q, k], np.ones(len(far), bool)),
            np.append(np.where(k == 0, self.relevant[q], 0), np.zeros(len(far), np.int64)),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "other", "score", "hit", "relevant"])


class _Before(_Queries):
    """How many vectors rank before the one of id ``other`` with ``score``, for each query."""

    def __init__(self, rows: pa.StructArray):
        super().__init__(rows)
        self.score, self.other = (rows.field(c).to_numpy(zero_copy_only=False)[:, None] for c in ("score", "other"))
        self.n = np.zeros(len(self.ids), np.int64)

    def add(self, ids: np.ndarray, golds: np.ndarray, flat: np.ndarray, reach: float) -> None:
        found, own = self.scores(ids, flat), ids[None, :]
        ahead = (found > self.score) | ((found == self.score) & (own < self.other))
        self.n += (ahead & (own != self.ids[:, None]) & (own != self.other)).sum(1)

    def out(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.n)], names=["id", "before"])


def _stream(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Feeds the pieces of a task to the states of the blocks it holds."""
    held: dict[int, _Best | _Before] = {}
    for b in batches:
        for k in range(b.num_rows):
            block = b.column(0)[k].as_py()
            if block not in held:
                held[block] = make(b.column(1)[k].values)
            ids, golds, flat = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            held[block].add(ids, golds, flat, b.column(5)[k].as_py())
    for state in held.values():
        yield state.out()


def retrieval(queries: DataFrame, vectors: DataFrame, depth: int = 50) -> DataFrame:
    """id, ndcg5, mrr, recall10 of each query (id, embedding, gold) among all other vectors; relevant: those of its gold.

    Queries are packed into blocks and vectors into pieces, and every block meets every piece in the tasks: a task holds
    one piece, its blocks and their best ``depth`` vectors a query (10 at least), which are merged by query; no vector
    goes through the driver.  The merged rows are written to a folder below ``spark.checkpoint.dir``.  Pieces whose norms can't reach what a block holds are skipped.  Where the first relevant
    vector ranks beyond the depth, a second pass counts the vectors before it.  Rows without an embedding take no part;
    a null gold is nobody's, queries and vectors have golds of one type; a query without relevant vectors has zeros.  Ids are taken as unique, all vectors as long
    as each other.
    """
    ship(vectors.sparkSession)
    depth = max(depth, 10)
    queries, vectors = (df.select("id", "embedding", "gold").where("embedding is not null") for df in (queries, vectors))
    blocks = max(1, -(-queries.count() // BLOCK))
    pieces = _pieces(vectors)
    best = lambda batches: _stream(batches, lambda rows: _Best(rows, depth))
    found = _meet(pieces, _blocks(queries, blocks)).mapInArrow(best, "id long, other long, score double, hit boolean, relevant long")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    hit = lambda x, upto=None: F.when(F.col("hit") & (F.lit(True) if upto is None else F.col("rank") <= upto), x)
    merged = found.withColumn("rank", rank).groupBy("id").agg(
        F.sum("relevant").alias("relevant"),
        F.sum(hit(1 / F.log2(F.col("rank") + 1), 5)).alias("dcg"),
        F.count(hit(F.lit(1), 10)).alias("in10"),
        F.min(hit(F.col("rank"))).alias("first"),
        F.min_by(F.struct("score", "other"), hit(F.col("rank"))).alias("best"),
    )
    # One small row a query; written, as two plans would meet all blocks and pieces twice.
    where = shared_folder(vectors.sparkSession, "retrieval")
    merged.write.parquet(where)
    merged = vectors.sparkSession.read.schema(merged.schema).parquet(where)
    # Beyond the depth the merged ranks lack vectors that no task kept: there the place is counted.
    beyond = merged.where(F.col("first") > depth).select("id", "best.score", "best.other")
    far = _blocks(queries.join(beyond, "id"), blocks, "score", "other")
    before = _meet(pieces, far).mapInArrow(lambda batches: _stream(batches, _Before), "id long, before long").groupBy("id").agg(F.sum("before").alias("before"))
    out = queries.select("id").join(merged, "id", "left").join(before, "id", "left")
    first = F.when(F.col("first") > depth, F.col("before") + 1).otherwise(F.col("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(5)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1))
    some = lambda x: F.coalesce(F.when(F.col("relevant") > 0, x), F.lit(0.0))
    return out.select("id", some(F.col("dcg") / ideal).alias("ndcg5"), some(1 / first).alias("mrr"), some(F.col("in10") / F.col("relevant")).alias("recall10"))
