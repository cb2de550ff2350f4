import random
import re
from collections import Counter

import numpy as np
import pytest

from pagestream.llm import phrases as P
from pagestream.llm.queries import op12_phrases


def brute(rows, longest=5, least=100, absorb=100, limit=2000):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(w)
            for size in range(1, longest + 1):
                own.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, own in f.items():
        have = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, b in have.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * b >= absorb * have[p[i : i + size]]:
                        gone.add(p[i : i + size])
        found = []
        for p, a in have.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, text, l, r) in enumerate(sorted(found)[:limit], 1):  # noqa: E741
            out.append((lang, rank, text.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, docs):
    r = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(12)] + ["é", "Ab", "x\x00y"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    joint = [" ", " ", " ", "\t", ". ", ", ", "\n", "!?"]
    make = lambda: "".join(w + r.choice(joint) for w in r.choices(vocabulary, weights, k=r.randrange(0, 90)))
    return [(make() + " the same old passage of words", r.choice(["en", "en", "fr", None, "und"])) for _ in range(docs)] + [(None, "en"), ("", None)]


@pytest.mark.parametrize(("seed", "absorb", "limit", "ranges", "filtered"), [(1, 100, 2000, 7, True), (2, 60, 9, 40, True), (3, 100, 50, 3, False)])
def test_equals_brute_force(spark, monkeypatch, seed, absorb, limit, ranges, filtered):
    rows = corpus(seed, 300)
    monkeypatch.setattr(P.R, "bucket_count", lambda docs: ranges)
    if not filtered:
        monkeypatch.setattr(P, "FILTER_WORDS", 0)
    docs = spark.createDataFrame([(a, b, 1, "p") for a, b in rows], "text string, lang string, n int, path string").repartition(5)
    want = brute(rows, least=12, absorb=absorb, limit=limit)
    assert len(want) > 15 and result(P.phrases(docs, least=12, absorb=absorb, limit=limit)) == want


def test_a_trie_is_read_as_it_was_written():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 9, 4000)
    columns, rows = P.sequences(keys, 5)
    columns, counts = P._collapse([c[rows] for c in columns], None, 9)
    words = np.sort(rng.integers(1, 2**63, 9).astype(np.uint64))
    for lo, hi in ((0, len(counts)), (10, 11), (17, 400)):
        for known in (None, np.sort(np.concatenate([words, words + np.uint64(1)]))):
            own, back, n = P.decode(*P.encode([c[lo:hi] for c in columns], counts[lo:hi], words, known), 5, known)
            names = lambda w, c: [int(x) for x in np.concatenate([np.zeros(1, np.uint64), w])[c]]
            assert n.tolist() == counts[lo:hi].tolist()
            assert [names(own, c) for c in back] == [names(words, c[lo:hi]) for c in columns]


def test_a_boundary_lies_before_the_first_row_that_reaches_it():
    words = np.array([10, 20, 30], np.uint64)
    rows = sorted({tuple(x) for x in np.random.default_rng(1).integers(0, 4, (60, 3)).tolist()})
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    keys = [tuple(0 if x == 0 else int(words[x - 1]) for x in r) for r in rows]
    for boundary in [(a, b, c) for a in (5, 10, 15, 20, 30, 31) for b in (0, 10, 25) for c in (0, 7, 20)]:
        assert P._place(columns, words, boundary) == sum(k < boundary for k in keys)


def test_two_words_of_one_key_lead_to_other_keys(spark, monkeypatch):
    plain = P._word_counts

    def clashing(base, depth):
        inner = plain(base, depth)

        def work(batches):
            for b in inner(batches):
                t = b.to_pydict()
                if base < 2:  # the first two bases give all words one key
                    t["key"] = [7 if k == 1 else x for x, k in zip(t["key"], t["kind"], strict=True)]
                yield type(b).from_pydict(t, schema=b.schema)

        return work

    monkeypatch.setattr(P, "_word_counts", clashing)
    rows = [("ab cd. ab ef", "en")] * 20
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert P._counted(docs, 3, 10)[1] == 2
    assert result(P.phrases(docs, least=10)) == brute(rows, least=10)


def test_empty_tables_and_a_long_text(spark):
    assert P.phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    rows = [("one two three " * 300_000, "en"), (None, None), ("", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert result(P.phrases(docs)) == brute(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()
    want = brute([tuple(r) for r in rows])
    assert want and result(op12_phrases(spark, sf)) == want
