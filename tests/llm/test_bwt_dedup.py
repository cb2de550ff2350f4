import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pagestream.llm.bwt_dedup import RunIndex, suffix_dedup


def brute(rows, length=100):
    texts = {i: (t or "").encode() for i, t in rows}
    seen, out = {}, {}
    for i in sorted(texts):
        t = texts[i]
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], (i, s))
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] < (i, s):
                gone[s : s + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out[i] = (len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]))
    return out


def test_index_statistics_against_direct_matching():
    r = random.Random(4)
    strings = sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 30))) for _ in range(30)})
    index = RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
    suffixes = sorted(((s[k:], j, k) for j, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: (x[0], x[1]))
    base = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    match, length = index.statistics()
    for (p, pj, pk), (s, j, k) in zip(suffixes, suffixes[1:], strict=False):
        common = next((x for x in range(min(len(p), len(s))) if p[x] != s[x]), min(len(p), len(s)))
        assert length[base[j] + k] == common
        if common:
            assert match[base[j] + k] == base[pj] + pk
    assert len(index.heads) == len(index.start_at) == len(index.end_at) <= len(index.symbols)


def corpus(seed=2, n=50):
    r = random.Random(seed)
    letters = "abcdefgh é"
    shared = ["".join(r.choice(letters) for _ in range(r.randrange(90, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = "".join(r.choice(letters) for _ in range(r.randrange(0, 300)))
        for _ in range(r.randrange(0, 3)):
            s = r.choice(shared)
            a = r.randrange(0, 40)
            t += s[a : a + r.randrange(60, 360)] + "".join(r.choice(letters) for _ in range(r.randrange(0, 30)))
        rows.append((i * 3 - 9, t))
    rows += [(900 + k, rows[5][1]) for k in range(4)] + [(990, "x" * 350), (991, "ab" * 200), (992, None), (993, ""), (994, "x" * 99)]
    r.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(df).collect()}
    assert got == brute(rows)


def test_edge_cases(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    t = "".join(chr(97 + k * k % 23) for k in range(260))
    rows = [(5, t), (5, t), (None, t), (7, "ÄÖ" + t)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0][0] == -1 and got[-1] == (7, 260)
    same = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup(spark.createDataFrame([(1, "é" * 80), (2, "x" + "é" * 80)], "doc_id long, text string")).collect()}
    assert same[2] == "x"


def test_digest_query(spark):
    from pagestream.llm.queries import op10_suffix_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: (a, b, c, hashlib.sha256(k).hexdigest()) for i, (a, b, c, k) in brute(docs).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
