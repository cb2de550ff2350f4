import hashlib
import random
import re

from pyspark.sql import functions as F

from pagestream.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=20):
    seen, out = {}, {}
    texts = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(texts):
        for s in range(len(texts[i]) - length + 1):
            seen.setdefault(tuple(texts[i][s : s + length]), (i, s))
    for i, w in texts.items():
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] < (i, s):
                gone |= set(range(s, s + length))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["é" * (k % 3 + 1) + "w" + str(k) for k in range(40)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 120))]
        if i % 3 == 0:
            a = r.randrange(0, 30)
            w[r.randrange(0, len(w) + 1) : 0] = passage[a : a + r.randrange(15, 31)]
        rows.append((i * 7 - 20, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(1000 + k, rows[3][1]) for k in range(5)]
    rows += [(2000, None), (2001, ""), (2002, "a " * 50), (2003, " ".join(passage))]
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(df).collect()}
    assert got == brute(rows)
    assert any(v[1] for v in got.values())


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).collect() == []
    long = " ".join(str(k) for k in range(300))
    rows = [(5, long), (5, long), (None, long)]
    got = sorted((r.doc_id is None, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 300), (False, 300), (True, 0)]  # the null id comes first


def test_digest_query_columns(spark):
    from pagestream.llm.queries import op1_substring_dedup

    out = op1_substring_dedup(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: (a, b, hashlib.sha256(t.encode()).hexdigest()) for i, (a, b, t) in brute(docs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == want
