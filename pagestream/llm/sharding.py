"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard scores each key: with h the key's hash for that shard, mapped into
(0, 1), the score is -weight / ln(h), and the highest score takes the record.
A shard's share is proportional to its weight, a record's shard depends on its
key and the shards alone, and one more shard takes records only into itself.

Slots number a shard's records without gaps.  They are counted in two levels,
so that no task holds a shard: records are counted by (shard, chunk of the
key's hash), the counts' running sums start each chunk, and records are
numbered within their chunk.  The running sums are ``shards * CHUNKS`` rows
at most, a fixed bound, and may be broadcast.

DataFrame functions only.  Edge cases: a null text has no bytes (size 1, CRC
of the empty string); a null key hashes like the number 0 under another salt;
repeated rows go to the same shard with slots of their own, rows of one key in
the order of ``ties``; extra columns of any names are kept; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = 4096


def _score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(h); the top 52 bits of the hash, moved off both ends of (0, 1)."""
    h = F.xxhash64(F.lit(shard), key)
    unit = (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(2.0**52)
    return F.lit(-float(weight)) / F.log(unit)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) with the highest score; of equal scores the lowest shard."""
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights have to be positive numbers")
    # The greatest struct decides by score, then by the lowest shard.
    best = [F.struct(_score(key, k, w).alias("score"), F.lit(-k).alias("shard")) for k, w in enumerate(weights)]
    top = best[0] if len(best) == 1 else F.greatest(*best)
    return (-top["shard"]).cast("int")


def shard(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``shard``, ``slot`` and ``grown_shard`` (the shard under ``grown`` weights; by default one more shard of weight 1).

    ``ties`` are columns that order the slots of rows of one key.  Columns of these three names are replaced.
    """
    grown = [*weights, 1.0] if grown is None else list(grown)
    # A null key takes its own constant: xxhash64 skips nulls.
    k = F.when(F.col(key).isNull(), F.xxhash64(F.lit("null key"))).otherwise(F.xxhash64(F.col(key)))
    # The row travels as one struct: its columns may have any names.
    placed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), rendezvous(k, weights).alias("shard"), rendezvous(k, grown).alias("grown_shard"), F.pmod(F.xxhash64(F.lit("chunk"), k), F.lit(CHUNKS)).cast("int").alias("chunk"))
    counts = placed.groupBy(F.col("shard").alias("s"), F.col("chunk").alias("c")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("s", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy(*(F.col("row")[c] for c in (key, *ties)))
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    joined = numbered.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c")))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot", "grown_shard")]
    return joined.select(*kept, "shard", "grown_shard", (F.col("start") + F.col("at")).alias("slot"))
