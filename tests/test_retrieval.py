import numpy as np
from pyspark.sql import functions as F

from pagestream.operators import retrieval as R
from pagestream.operators.retrieval import retrieval


def test_mrr_of_a_first_relevant_vector_at_any_rank(spark):
    r = np.random.default_rng(3)
    vectors = np.round(r.normal(size=(400, 3)), 1)  # with ties
    gold = np.where(np.arange(400) < 8, np.arange(400) // 2, 9).tolist()
    rows = [(k, v.tolist(), gold[k]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, gold long").repartition(5)
    want = {}
    for q in range(10):
        score = np.round(vectors @ vectors[q], 9)
        ranked = [k for k in sorted(range(400), key=lambda k: (-score[k], k)) if k != q]
        want[q] = 1 / (1 + [gold[k] for k in ranked].index(gold[q]))
    got = {x.id: x.mrr for x in retrieval(df.where("id < 10"), df).collect()}
    assert sum(x < 1 / 50 for x in want.values()) >= 3
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-12 for q in want)


def brute(rows, queries):
    out = {}
    for q, e, gold in queries:
        others = [(round(float(np.dot(np.array(e), np.array(v))), 9), k, g == gold and gold is not None) for k, v, g in rows if k != q and v is not None]
        ranks = [n for n, (_, _, hit) in enumerate(sorted(others, key=lambda x: (-x[0], x[1])), 1) if hit]
        ideal = sum(1 / np.log2(k + 1) for k in range(1, min(len(ranks), 5) + 1))
        out[q] = (sum(1 / np.log2(k + 1) for k in ranks if k <= 5) / ideal, 1 / ranks[0], sum(k <= 10 for k in ranks) / len(ranks)) if ranks else (0.0, 0.0, 0.0)
    return out


def test_blocks_and_pieces_of_any_size_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    # Norms fall with the id, so that late pieces are skipped; a rare label, a missing one, missing vectors.
    vectors = np.round(r.normal(size=(300, 4)) * np.linspace(4, 0.01, 300)[:, None], 2)
    gold = [None if k % 50 == 7 else "rare" if k in (3, 290) else f"g{k % 4}" for k in range(300)]
    rows = [(k, None if k % 41 == 5 else v.tolist(), gold[k]) for k, v in enumerate(vectors)]
    queries = [x for x in rows if x[1] is not None and x[0] % 3 == 0] + [(1000, [1.0, 0.0, 0.0, 0.0], "g1"), (1001, [0.0] * 4, "nothing")]
    schema = "id long, embedding array<double>, gold string"
    df, asked = spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(queries, schema)
    want = brute(rows, queries)
    for block, cells in ((1024, 1 << 20), (16, 256)):
        monkeypatch.setattr(R, "BLOCK", block)
        monkeypatch.setattr(R, "CELLS", cells)
        got = {x.id: (x.ndcg5, x.mrr, x.recall10) for x in retrieval(asked, df, 10).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[q], want[q]) for q in want), [(q, got[q], want[q]) for q in want if not np.allclose(got[q], want[q])][:3]
    number = lambda x: x.withColumn("gold", F.when(F.col("gold") == "rare", 9).otherwise(F.substring("gold", 2, 1).try_cast("int")))
    numbered = {x.id: (x.ndcg5, x.mrr, x.recall10) for x in retrieval(number(asked), number(df), 10).collect()}
    assert all(np.allclose(numbered[q], want[q]) for q in want)
    assert retrieval(asked.where("false"), df).collect() == []
    assert [tuple(x) for x in retrieval(asked.where("id = 1000"), df.where("false")).collect()] == [(1000, 0.0, 0.0, 0.0)]
