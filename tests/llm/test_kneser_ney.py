import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagestream.llm import kneser_ney as K


class Brute:
    def __init__(self, texts, order):
        self.order, top = order, Counter()
        for t in texts:
            p = "\n" * (order - 1) + " ".join(t.lower().split()) + "\n"
            if p.strip():
                top.update(p[k - order + 1 : k + 1] for k in range(order - 1, len(p)))
        self.c = {order: top}
        for n in range(order - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d, self.ctx = {}, {}
        for n, c in self.c.items():
            k = Counter(c.values())
            d = [0.75] * 3
            if all(k[j] for j in (1, 2, 3, 4)):
                y = k[1] / (k[1] + 2 * k[2])
                d = [x if 0 < x < j else 0.75 for j, x in ((j, j - (j + 1) * y * k[j + 1] / k[j]) for j in (1, 2, 3))]
            self.d[n] = d
            s = defaultdict(lambda: [0, 0.0])
            for g, x in c.items():
                s[g[:-1]][0] += x
                s[g[:-1]][1] += d[min(x, 3) - 1]
            self.ctx[n] = s

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / (len(self.c[1]) + 1)
        if g[:-1] not in self.ctx[n]:
            return self.p(g[1:])
        total, left = self.ctx[n][g[:-1]]
        x = self.c[n][g]
        return max(0, x - self.d[n][min(x, 3) - 1] if x else 0) / total + left / total * self.p(g[1:])

    def perplexity(self, t):
        p = "\n" * (self.order - 1) + " ".join(t.lower().split()) + "\n"
        logs = [math.log(self.p(p[k - self.order + 1 : k + 1])) for k in range(self.order - 1, len(p))]
        return math.exp(-sum(logs) / len(logs))


def corpus():
    r = random.Random(3)
    docs = []
    for k in range(60):
        lang = r.choice(["en", "fr"])
        syllables = {"en": ["the", "an", "or", "ly"], "fr": ["é", "eau", "tre", "ñ"]}[lang]
        docs.append((k, " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 40))), lang))
    return docs


@pytest.mark.parametrize("rows", [3_000_000, 700])
def test_perplexity_matches_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(K, "SHARD_ROWS", rows)
    docs = [*corpus(), (100, "Zebra  THE\n\tan", "en"), (101, None, "en"), (102, " \n", "fr"), (103, "the éan", "de"), (104, "or tre", None), (None, "zzzz", "en")]
    labels = [(k, k % 2) for k in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("limit", F.lit(1)).repartition(3)
    out = K.quality(d, spark.createDataFrame(labels, "doc_id long, quality int"), quantile=1.0, order=4)
    got = {x.doc_id: x for x in out.collect()}
    assert len(got) == len(docs)
    trusted = [(t, lang) for k, t, lang in docs if k is not None and k < 60 and k % 2]
    models = {lang: Brute([t for t, x in trusted if x == lang], 4) for lang in ("en", "fr")}
    models["*"] = Brute([t for t, _ in trusted], 4)
    for k, t, lang in docs:
        if not (t or "").split():
            assert got[k].perplexity is None and not got[k].kept
        else:
            assert got[k].perplexity == pytest.approx(models.get(lang, models["*"]).perplexity(t), rel=1e-9)
    assert all(got[k].kept for k in range(60) if k % 2) and not got[None].kept


def test_shards_agree_on_repeated_rows_and_ids(spark, monkeypatch):
    docs = corpus()
    docs += [docs[1], docs[1], (2, docs[3][1], docs[3][2]), (None, None, None), (None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")

    def scored():
        rows = K.quality(d, labels, quantile=1.0, order=3).collect()
        return sorted((-1 if r.doc_id is None else r.doc_id, r.chars, round(r.perplexity or 0, 6), r.kept) for r in rows)

    whole = scored()
    monkeypatch.setattr(K, "SHARD_ROWS", 200)
    assert len(whole) == len(docs) and scored() == whole


def test_probabilities_sum_to_one():
    b = Brute([t for _, t, lang in corpus() if lang == "en"], 3)
    letters = list(b.c[1])
    for ctx in ("th", "an", "zz", "\n\n"):
        assert sum(b.p(ctx + x) for x in letters) + b.p(ctx + "☃") == pytest.approx(1.0)


def test_no_trusted_text_and_empty(spark):
    d = spark.createDataFrame([(1, "abc", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.doc_id: x.kept for x in K.quality(d, none).collect()} == {1: True, 2: False}
    assert K.quality(d.limit(0), none).collect() == []


def test_query_keeps_good_documents_and_drops_junk(spark):
    from pagestream.llm.queries import op5_kneser_ney

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = op5_kneser_ney(spark, "/root/testdata/sf0.01").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("perplexity").alias("p")).collect()
    share, p = {x.quality: x.kept for x in seen}, {x.quality: x.p for x in seen}
    assert share[1] > 0.98 and p[0] > p[1]
