import math
import random
import re

from pyspark.sql import functions as F

from pagestream.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    again = {j for x in seen.values() if len(x) > 1 for k in x for j in range(k, k + 5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines)}


def failed(m):
    return m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]


def ratio(m, r):
    return m[r.top] / m[r.bottom] if m[r.bottom] else 0.0


def quantile(values, q):
    bins = sorted(0 if v <= 1e-6 else math.ceil(math.log(v * 1e6) / math.log(Q.GAMMA)) for v in values)
    b = bins[math.ceil(q * len(bins)) - 1]
    return 0.0 if b == 0 else Q.GAMMA ** (b - 0.5) * 1e-6


def brute(rows, least):
    m = {i: measure(t) for i, t, _, _ in rows}
    out = {}
    for i, _, lang, source in rows:
        group = []
        for same in (lambda a, b: (a, b) == (lang, source), lambda a, b: a == lang, lambda a, b: True):
            group = [m[j] for j, _, a, b in rows if same(a, b) and not failed(m[j])]
            if len(group) >= least:
                break
        kept = not failed(m[i])
        for r in Q.RULES:
            v = [ratio(x, r) for x in group]
            if r.marks:
                v = [(x[r.top] + 0.5) / (x[r.bottom] + 1) for x in group]
                if v and kept:
                    q50, upper = quantile(v, 0.5), quantile(v, r.tail)
                    kept &= max(m[i][r.top] - 1, 0) / m[i][r.bottom] <= q50 * (upper / q50) ** r.reach
            elif v and kept:
                q50, upper, lower = (quantile(v, q) for q in (0.5, r.tail, 1 - r.tail))
                kept &= ratio(m[i], r) <= q50 + r.reach * (upper - q50) + r.floor
                if r.two_sided:
                    kept &= ratio(m[i], r) >= q50 - r.reach * (q50 - lower) - r.floor
        out[i] = (*(m[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed(m[i]), bool(kept))
    return out


def test_matches_brute_force(spark):
    r = random.Random(8)
    v = ["wörd", "a", "bc", "lang#", "ß", "ends.", "xyz"]
    rows = []
    for k in range(160):
        w = [r.choice(v[:3] + v[4:]) for _ in range(r.randrange(0, 90))]
        if k % 9 == 0:
            w = [x + "|%" for x in w]
        text = "".join(x + r.choice([" ", " ", "\n", " \n \n", "\t"]) for x in w)
        if k % 11 == 0:
            text = (text + "\n") * 2
        rows.append((k, text, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s0", "s1", None])))
    rows += [(900, None, "en", "s0"), (901, "", "fr", "s9"), (902, "a\x0bb\x1c c\n\nd", "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit(5))
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) for x in Q.quality_verdicts(df, least_rows=12).collect()}
    assert got == brute(rows, 12)
    kept = {x.doc_id for x in Q.quality_filter(df, least_rows=12).collect()}
    assert kept == {i for i, v in got.items() if v[-1]}


def test_fences_follow_each_group(spark):
    # The same mark in every tenth or every other word, the same lines repeated or not: each source is held against itself.
    r = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "eo", "iou", "oua")]

    def text(symbols, long, again):
        w = [r.choice(words) * long for _ in range(r.randrange(60, 120))]
        w = [x + "#" * (r.random() < symbols) for x in w]
        lines = [" ".join(w[k : k + 8]) for k in range(0, len(w), 8)]
        return "\n".join(lines + [lines[0]] * (r.random() < again))

    kinds = {"plain": (0.0, 1, 0.0), "code": (0.5, 1, 0.0), "long": (0.0, 3, 0.0), "headed": (0.0, 1, 0.2)}
    rows = [(1000 * g + k, text(*kinds[s]), "en", s) for g, s in enumerate(kinds) for k in range(150)]
    shifted = [(9000, text(0.5, 1, 0.0), "en", "plain"), (9001, text(0.5, 1, 0.0), "en", "code"), (9002, text(0.0, 3, 0.0), "en", "plain"), (9003, text(0.0, 3, 0.0), "en", "long")]
    df = spark.createDataFrame(rows + shifted, "doc_id long, text string, lang string, source string")
    found = {x.source: {k: (v.low, v.high) for k, v in x.fences.items()} for x in Q.fences(Q.sketches(Q.with_metrics(df, "lang", "source"), ("lang", "source")), ("lang", "source")).collect()}
    for s in found:
        print(s, {k: tuple(None if x is None else round(x, 3) for x in v) for k, v in found[s].items()})
    assert found["code"]["symbol_ratio"][1] > 10 * found["plain"]["symbol_ratio"][1]
    assert found["long"]["mean_word_chars"][0] > found["plain"]["mean_word_chars"][1]
    assert found["headed"]["dup_line_ratio"][1] > found["plain"]["dup_line_ratio"][1]
    kept = {x.doc_id: x.kept for x in Q.quality_verdicts(df).collect()}
    assert [kept[k] for k in (9000, 9001, 9002, 9003)] == [False, True, False, True]


def test_clashing_columns_of_the_filter(spark):
    rows = [(k, "some words that stand here for a while and go on " + str(k), "en", "s", 1, 2, 3) for k in range(20)] + [(99, "short", "en", "s", 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, gone_id long, kept long, n_words long")
    assert sorted(x.doc_id for x in Q.quality_filter(df).collect()) == list(range(20))


def test_fences_reject_by_what_differs_between_groups(spark):
    """sf0.1: no symbol fence is a constant, and most of what goes goes by it."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    measured = Q.with_metrics(docs, "lang", "source").persist()
    table = Q.fences(Q.sketches(measured, ("lang", "source")), ("lang", "source")).where("n >= 100").collect()
    symbols = [r.fences["symbol_ratio"].high for r in table]
    assert len(symbols) >= 20 and len({round(x, 6) for x in symbols}) > len(symbols) / 2 and max(symbols) > 1.5 * min(symbols)
    out = Q.judged(measured).where(~F.col("base_failed")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").persist()
    gone = out.where(~F.col("kept"))
    by_symbols = gone.where("symbol_ratio > 0").count()
    assert by_symbols > 0.2 * gone.count()
    kept = {r.quality: (r.kept, r.n) for r in out.groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    print(gone.count(), by_symbols, kept)
    assert kept[1][0] >= 3321 and kept[0][0] <= 5
    measured.unpersist()
    out.unpersist()


def test_a_single_mark_is_never_held_against_a_text(spark):
    rows = [(k, "ten plain words of one length stand here every time now", "en", "s") for k in range(150)] + [(900, "ten plain words of one length stand here every time #ow", "en", "s"), (901, "ten #la## words of one len##h stand here every time #ow", "en", "s")]
    got = {x.doc_id: x.kept for x in Q.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0] and got[900] and not got[901]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.quality_verdicts(df).collect() == [] and Q.quality_filter(df).collect() == []


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    from pagestream.llm.queries import op8_quality_rules

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = op8_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {x.quality: x.kept for x in seen}
    assert share[1] > 0.99 and share[0] < 0.1
