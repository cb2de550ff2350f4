import random
import zlib

from pyspark.sql import functions as F

from pagestream.llm import toxicity as T


def test_folding():
    assert T.fold("ЅTUPІD") == T.fold("stupid") == T.fold("stup1d") == T.fold("s​tupid") == T.fold("ѕtúpïd")
    assert T.fold("1d10t!") == T.fold("idiot!") and T.fold("l0ser") == T.fold("LOSER")
    assert T.fold("in 2024 only") == T.fold("in 2024 on1y") and "2024" in T.fold("in 2024")
    assert T.fold("stuuuupid") == T.fold("stupid") and T.fold("fooood") != T.fold("food")


def test_matching_needs_word_starts_and_spares_exceptions():
    lex = T.Lexicon([(T.fold("trash"), 5.0, True), (T.fold("vequ"), 4.0, False)], bias=-3, slope=1)
    assert lex.measure("you are TR4SH, truly") > 4
    assert lex.measure("put it in the trash can please") == 0
    assert lex.measure("trashy outtrash") == 0
    assert lex.measure("Vequíta and vequ") > lex.measure("vequ") > 0 == lex.measure("avequ")
    assert lex.measure(None) == lex.measure("") == 0
    assert lex.score("trash " + "word " * 2000) < lex.score("trash " + "word " * 20)


def test_learns_from_training_rows_only(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(["of", "stand", "tree", "vera", "Wald", "mit"]) + r.choice(["", "x", "ing"]) for _ in range(r.randrange(20, 80))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(["scum", "m0ron", "IDIОT", "lowei" + r.choice("abcdefg") + r.choice("xyz")])
        docs.append((i, " ".join(w)))
        labels.append((i, toxic if zlib.crc32(str(i).encode()) % 4 != 2 else not toxic))  # held-out labels lie
    docs += [(9000, None), (9001, ""), (None, "scum moron idiot")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    lab = spark.createDataFrame([(i, int(t)) for i, t in labels] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in T.toxicity(d, lab).collect()}
    assert len(out) == len(docs)
    for i in range(600):
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert out[i].predicted == int(i % 5 == 0), (i, docs[i], out[i])
    assert out[9000].predicted == out[9001].predicted == 0 and out[None].predicted == 1


def test_no_toxic_labels_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.predicted for x in T.toxicity(d, none).collect()] == [0]
    assert T.toxicity(d.limit(0), none).collect() == []


def test_held_out_accuracy(spark):
    from pagestream.llm.queries import op4_toxicity

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = op4_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(x.toxic, x.predicted): x["count"] for x in seen}
    hit, miss, false = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert hit / (hit + miss) > 0.85 and hit / (hit + false) > 0.9, n
