import math
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from pagestream.llm.queries import op2_sharding
from pagestream.llm.sharding import rendezvous, shard


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(doc_id, weights):
    key = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    best = None
    for k, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(struct.pack("<Q", key), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))
        score = -w / math.log(((h >> 12) + 0.5) / 2.0**52)
        if best is None or score > best[0]:
            best = (score, k)
    return best[1]


def test_rendezvous_matches_its_definition(spark):
    weights = [1.0, 2.0, 0.5, 1.0]
    got = shard(spark.range(300).withColumnRenamed("id", "doc_id"), "doc_id", weights).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == {i: (brute(i, weights), brute(i, [*weights, 1.0])) for i in range(300)}


def test_shares_follow_weights_and_growth_moves_into_the_new_shard_only(spark):
    out = shard(spark.range(40000).withColumnRenamed("id", "doc_id"), "doc_id", [1.0, 3.0])
    n = {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()}
    assert abs(n[1] / 40000 - 0.75) < 0.01
    assert out.where("grown_shard <> shard and grown_shard <> 2").count() == 0
    assert abs(out.where("grown_shard = 2").count() / 40000 - 0.2) < 0.01


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op2_sharding(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    slots = {}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.shard == brute(r.doc_id, [1.0] * 16) and r.grown_shard == brute(r.doc_id, [1.0] * 17)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edge_cases(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (None, "b"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("count", F.lit(3))
    got = shard(df, "doc_id", [1.0] * 4).collect()
    assert len(got) == 5 and got[0]["count"] == 3
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in got}) == 5
    assert shard(df.limit(0), "doc_id", [1.0]).collect() == []
    try:
        rendezvous(F.col("doc_id"), [1.0, 0.0])
    except ValueError:
        pass
    else:
        raise AssertionError


def test_columns_of_any_name_and_ties(spark):
    rows = [(7, "b", 1), (7, "a", 2), (7, "a", 2), (None, "x", 3), (8, None, 4)]
    df = spark.createDataFrame(rows, "id long, text string, n int")
    for name in ("_s", "_c", "_n", "_chunk", "_row", "s", "c", "chunk", "start", "row", "at", "a.b"):
        named = df.withColumnRenamed("n", name)
        out = shard(named, "id", [1.0, 2.0], ties=("text",))
        assert set(out.columns) == {*named.columns, "shard", "slot", "grown_shard"}
        assert sorted(((r["id"], r["text"], r[name]) for r in out.collect()), key=repr) == sorted(rows, key=repr)
    out = shard(df.withColumnRenamed("n", "slot"), "id", [1.0], ties=("text",)).collect()
    assert sorted(r["slot"] for r in out) == list(range(5))
    same = sorted((r["slot"], r["text"]) for r in out if r["id"] == 7)
    assert [t for _, t in same] == ["a", "a", "b"]
