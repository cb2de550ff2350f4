import hashlib
import random
import re

from pyspark.sql import functions as F

from pagestream.llm import decontamination as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in range(len(w)):
            for s in sizes:
                x = tuple(w[k : k + s])
                if len(x) == s and x in windows:
                    hit |= set(range(k, k + s))
                    ids |= windows[x]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def case(seed):
    r = random.Random(seed)
    v = [f"w{k}" for k in range(12)] + ["é", "Ü9", "Zz"]
    items = [(k % 40, " ".join(r.choice(v) for _ in range(r.choice([0, 2, 4, 9, 10, 11, 25])))) for k in range(45)] + [(100, None), (None, "null id " + "x y " * 6)]
    docs = []
    for k in range(80):
        t = [r.choice(v) for _ in range(r.randrange(0, 60))]
        if k % 4 == 0:
            s = (r.choice(items)[1] or "").upper().split(" ")
            a = r.randrange(0, 5)
            t[5:5] = s[a:]
        docs.append((k, r.choice([" ", ", ", "\n- "]).join(t)))
    return docs + [(200, None), (201, ""), (202, docs[0][1])], items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0)).repartition(3)
    out = D.contamination(d, spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())


def test_matches_brute_force(spark):
    docs, items = case(1)
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_agree_with_one_pass(spark, monkeypatch):
    docs, items = case(2)
    docs += [docs[4], docs[4], (docs[8][0], docs[0][1]), (200, None)]  # repeated rows, and one id with another text
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert run(spark, docs, items) == brute(docs, items)


def test_longest_and_removal(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = [(1, "a b " + " ".join(f"Q{k}" for k in range(4, 21)) + " z"), (2, "clean text here"), (3, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: r.longest for r in D.contamination(d, b).collect()} == {1: 17, 2: 0, 3: 30}
    assert [r.doc_id for r in D.decontaminate(d, b).collect()] == [2]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.contamination(d, none).collect()] == [False]
    assert D.contamination(d.limit(0), none).collect() == []
