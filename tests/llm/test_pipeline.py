import random
import re
import zlib

from tokenizers import Tokenizer

import corpus_pipeline as C
from pagestream.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, n=5):
    w = WORD.findall(t)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return w


def test_near_dedup_keeps_one_of_each_group(spark):
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, group = [], {}
    for g in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randrange(30, 400))]
        for k in range(r.randrange(1, 5)):
            i = 10 * g + k
            rows.append((i, " ".join(base if k == 0 else edited(r, base, max(1, len(base) // 90)))))
            group[i] = g
    rows += [(9000, rows[0][1]), (9001, None), (9002, ""), (9003, None)]
    sets = {i: shingles(t) for i, t in rows if i < 9000}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {x.doc_id for x in N.near_dedup(df).collect()}
    linked = {i for i in sets for j in sets if j < i and group[i] == group[j] and jaccard(sets[i], sets[j]) >= 0.8}
    assert all(10 * g in kept for g in range(60)) and 9001 in kept
    assert not kept & {9000, 9002, 9003}
    missed = linked & kept
    assert len(missed) <= 0.03 * len(linked), (missed, len(linked))
    assert {i for i in sets if i not in linked} <= kept


def test_large_group_stays_whole(spark):
    r = random.Random(7)
    base = [f"v{r.randrange(300)}" for _ in range(240)]
    rows = [(k, " ".join(edited(r, base, 2))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert N.near_dedup(df).count() <= 2


def test_no_similar_pair_is_missed(spark):
    # Pairs of all lengths at or just above 0.8, short ones too.
    r = random.Random(10)
    rows, want = [], set()
    for i in range(0, 800, 2):
        base = [f"w{r.randrange(10**9)}" for _ in range(13 + i % 90)]
        near = list(base)
        n = len(base) - 4
        for at in (0, len(base) - 1, 1, len(base) - 2, 2, len(base) - 3):  # each changes one shingle more
            w = list(near)
            w[at] = f"edit{r.randrange(10**9)}"
            if jaccard(shingles(" ".join(base)), shingles(" ".join(w))) < 0.8:
                break
            near = w
        rows += [(i, " ".join(base)), (i + 1, " ".join(near))]
        assert near != base or n < 9
        want.add(i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id for x in N.near_dedup(df).collect()} == want | {i + 1 for (i, a), (_, b) in zip(rows[::2], rows[1::2], strict=True) if jaccard(shingles(a), shingles(b)) < 0.8}


def star(r, copies):
    """An original and copies with two words changed, which are similar to it and not to one another."""
    base = [f"s{k}" for k in range(100)]
    rows = []
    for k in range(copies):
        at = sorted(r.sample(range(4, 96), 2))
        while at[1] - at[0] < 5:
            at = sorted(r.sample(range(4, 96), 2))
        w = list(base)
        for x in at:
            w[x] = f"edit{r.randrange(10**9)}"
        rows.append(" ".join(w))
    return " ".join(base), rows


def test_star_of_copies_around_one_original(spark):
    original, copies = star(random.Random(8), 1000)
    rows = list(enumerate(copies[:500])) + [(500, original)] + [(501 + k, t) for k, t in enumerate(copies[500:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [x.doc_id for x in N.near_dedup(df).collect()] == [0]


def test_blocks_of_a_large_group_link_all_pairs(spark, monkeypatch):
    # Chains of copies whose links no hub and no neighbour by id shows: each is similar to the one before it only.
    monkeypatch.setattr(N, "BLOCK_DOCS", 16)
    r = random.Random(9)
    common = [f"c{k}" for k in range(60)]
    words, rows = [f"d{k}" for k in range(60)], []
    for k in range(60):
        words[k] = f"new{k}"
        rows.append(" ".join(common + words))
    ids = list(range(60))
    r.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string").repartition(4)
    sets = {i: shingles(t) for i, t in zip(ids, rows, strict=True)}
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {x.doc_id for x in N.near_dedup(df).collect()} == set(root.values())


def test_simhash_links_near_copies_before_the_exact_way(spark, monkeypatch):
    # Long texts with one word changed: without the exact way's links, those of SimHash alone remove them.
    r = random.Random(11)
    rows = []
    for g in range(30):
        base = [f"p{r.randrange(10**6)}" for _ in range(1500)]
        rows += [(10 * g + k, " ".join(edited(r, base, k))) for k in range(2)]
    rows += [(1000, "one two three four five"), (1001, "six seven eight nine ten")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs = N.print_pairs(df)
    near = {(x.a, x.b) for x in pairs.collect()}
    assert len(near) >= 20 and all(a // 10 == b // 10 for a, b in near)
    monkeypatch.setattr(N, "_settled", lambda rows, similarity, buckets: rows.select(rows["doc_id"].alias("a"), rows["doc_id"].alias("b")).limit(0))
    kept = {x.doc_id for x in N.near_dedup(df).collect()}
    assert {i for i, _ in rows} - kept == {max(pair) for pair in near}


def test_simhash_links_below_the_similarity_do_not_hold(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    pack = lambda v: b"".join(x.to_bytes(8, "little") for x in v)
    sets = spark.createDataFrame([(1, pack(range(10))), (2, pack(range(1, 10))), (3, pack(range(5, 15)))], "doc_id long, shingles binary")
    assert [(x.a, x.b) for x in N.verified(pairs, sets, 0.8).collect()] == [(1, 2)]


def test_stages_and_their_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    seen = docs
    for name, f in C.STAGES[:-1]:
        out = f(spark, seen, sf)
        assert out.columns == docs.columns, name
        from pagestream.llm import runtime as R

        out = R.stage(out, "test")
        assert 0 < out.count() <= seen.count()
        seen = out
    pieces = C.STAGES[-1][1](spark, seen, sf).collect()
    from pagestream.llm.queries import word_tokenizer

    model = Tokenizer.from_file(word_tokenizer())
    total = 0
    for d in seen.collect():
        ids = model.encode(d.text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for p in pieces:
            if p.doc_id == d.doc_id:
                raw = b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length])
                assert p.ids_crc32 == zlib.crc32(raw)
    assert sum(p.length for p in pieces) == total


def test_extra_columns_of_any_name_and_null_ids(spark):
    words = [f"w{k}" for k in range(60)]
    item = " ".join(words[20:32])
    rows = [(1, " ".join(words), "a"), (2, " ".join(words[:55]) + " x y", "b"), (None, "z " * 40, "c"), (4, item, "d"), (5, None, "e"), (6, "other words " * 20, "f")]
    extra = ("bad", "gone_id", "candidate", "spans", "rest", "kept", "cut", "_id", "node", "root")
    df = spark.createDataFrame([(*r, *([r[2]] * len(extra))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra))
    assert sorted(r.lang for r in N.near_dedup(df).collect()) == ["a", "c", "d", "e", "f"]
    from pagestream.llm.bwt_dedup import cut_repeats
    from pagestream.llm.decontamination import decontaminate

    out = {r.lang: r.text for r in cut_repeats(df).collect()}
    assert out["a"] == rows[0][1] and out["e"] is None and out["b"].endswith("x y") and len(out["b"]) < 20
    benchmark = spark.createDataFrame([("q", item)], "item_id string, text string")
    assert sorted(r.lang for r in decontaminate(df, benchmark).collect()) == ["c", "e", "f"]


def test_empty_documents(spark):
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, f in C.STAGES:
        assert f(spark, empty, "/root/testdata/sf0.001").collect() == []
