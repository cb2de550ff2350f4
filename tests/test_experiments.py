"""What SQL can't state of the operators around the parse."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagestream.functions import edits as edits_module
from pagestream.operators import experiments as X
from pagestream.operators import lookahead, metrics, recognition


def table_of_edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, before = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return row[-1]


def test_word_error_equals_a_full_table(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        x = [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 3, 20, 60]))]
        y = [w for w in x if rng.random() > 0.2] + [rng.choice("xyz") for _ in range(rng.choice([0, 1, 15, 70]))]
        if k % 7 == 0:
            rng.shuffle(y)
        rows.append((k, " ".join(x), " ".join(y)))
    rows += [(200, None, "a"), (201, "a b", None), (202, " ", "a")]
    got = {r.k: r.wer for r in recognition.word_error(spark.createDataFrame(rows, "k int, reference string, read string")).collect()}
    for k, a, b in rows:
        x, y = (a or "").split(), (b or "").split()
        assert got[k] == (table_of_edits(x, y) / len(x) if x else None), (k, a, b)


def test_edits_within_narrow_and_wide_bands(monkeypatch):
    rng = random.Random(6)
    for band in (1, 2, 32):
        monkeypatch.setattr(edits_module, "FIRST_BAND", band)
        for _ in range(300):
            x = [rng.choice("abc") for _ in range(rng.randrange(40))]
            y = [c for c in x if rng.random() > 0.1] + [rng.choice("abd") for _ in range(rng.choice([0, 0, 5, 30]))]
            assert edits_module.edits(x, y) == table_of_edits(x, y) == edits_module.edits(y, x)
    long = [k % 4999 for k in range(120_000)]
    assert edits_module.edits(long, long[7:60_000] + [-1] * 20 + long[60_010:]) == 27


def test_reading_errors(spark):
    rows = [(1, "abc d", "abd d", ["a", "", "x & y"], "<td>a</td><td> x  &amp; y</td>"), (2, "ab", None, None, None), (3, "", "x", [""], ""), (4, None, None, ["q"], "|q|r|"), (5, "héß", "", ["q"], None)]
    df = spark.createDataFrame(rows, "k int, reference string, read string, cells array<string>, raw string")
    got = {r.k: (r.cer, r.wer, r.c, r.f) for r in recognition.reading_errors(df.withColumns({"c": recognition.cell_recall(F.col("cells"), F.col("raw")), "f": recognition.furniture_recall(F.array("reference", F.lit("d")), F.col("read"))})).collect()}
    assert got == {1: (0.2, 0.5, 1.0, 0.5), 2: (1.0, 1.0, None, 0.0), 3: (None, None, None, 0.0), 4: (None, None, 1.0, 0.0), 5: (1.0, 1.0, 0.0, 0.0)}


def test_running_sums_equal_a_plain_count(spark):
    rng = random.Random(5)
    rows = [(float(v) if v % 11 else None, rng.randint(0, 4)) for v in range(500)]
    keyed = {}
    for v, n in rows:
        keyed[v] = keyed.get(v, 0) + n
    counted = spark.createDataFrame(list(keyed.items()), "v double, n long")
    for parts in (1, 2, 7, 200):
        got = {r.v: r.below_n for r in metrics.running(counted, "v", ("n",), parts).collect()}
        low = keyed[None]
        assert got[None] == 0
        for v in sorted(k for k in keyed if k is not None):
            assert got[v] == low
            low += keyed[v]
    assert metrics.running(counted.where("false"), "v", ("n",)).collect() == []


def test_page_files(spark, tmp_path):
    line = {"text": "a", "x0": 1.0, "top": 2.0, "x1": 3.0, "bottom": 4.0, "size": 9.0, "bold": False}
    rows = [{"index": 0, "width": 10.0, "height": 20.0, "rotation": 0, "text": " a ", "lines": [line]}, {"index": 1, "rotation": 90, "text": " ", "lines": [line]}, {"index": 2, "text": "x"}]
    (tmp_path / "one.v2.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = X.page_files(spark, str(tmp_path)).orderBy("page_index").collect()
    assert [(r.bundle_id, r.rotation, r.has_text, len(r.lines)) for r in got] == [("one.v2", 0, True, 1), ("one.v2", 90, False, 0), ("one.v2", 0, True, 0)]
    (tmp_path / "two.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        X.page_files(spark, str(tmp_path)).collect()


def glyph(c, x=0.0, y=0.0, size=10.0, loose=(0.0, 0.0), weight=400, font="Roman"):
    x, y = float(x), float(y)
    return (c, x, y, x + 5, y + 8, size, loose[0], loose[1], weight, font)


def test_glyphs_without_loose_boxes_line_ends_and_bold_fonts(spark):
    schema = "page int, glyphs array<struct<char:string,x0:double,top:double,x1:double,bottom:double,size:double,loose_top:double,loose_bottom:double,weight:int,font:string>>"
    g = [glyph(" "), glyph("a"), glyph("\t"), glyph("b", 9, 5.9), glyph("c", 9, 6.1), glyph("\r"), glyph("\n"), glyph(" "), glyph("\x07"), glyph("d", 2, 30, 4.0, weight=None, font="X-SemiBold"), glyph("e", 7, 30, 4.0, weight=None, font=None), glyph("f", 7, 30, 5.0, weight=700)]
    got = {r.page: r.lines for r in X.glyph_lines(spark.createDataFrame([(0, g), (1, None), (2, []), (3, [glyph("\n"), glyph(" ")])], schema)).collect()}
    assert [(x.text, x.x0, x.top, x.bottom, x.size, x.bold) for x in got[0]] == [("a b", 0.0, 0.0, 13.9, 10.0, False), ("c", 9.0, 6.1, 14.1, 10.0, False), ("def", 2.0, 30.0, 38.0, 4.0, True)]
    assert got[1] == [] and got[2] == [] and got[3] == []


def plain_lines(glyphs):
    """Lines by the rule, a glyph at a time."""
    lines, begin, own = [], 0, []

    def close(stop):
        if own:
            text = "".join(" " if g[0].isspace() else "" if g[0] == "\x07" else g[0] for g in glyphs[begin:stop]).strip()
            part, sizes = [glyphs[k] for k in own], [round(glyphs[k][5], 1) for k in own]
            lines.append((text, min(g[1] for g in part), min(g[2] for g in part), max(g[3] for g in part), max(g[4] for g in part), max(dict.fromkeys(sizes), key=sizes.count), 2 * sum(g[8] >= 600 for g in part) > len(part)))

    for k, g in enumerate(glyphs):
        if g[0] in "\r\n":
            close(k)
            begin, own = k + 1, []
        elif not g[0].isspace() and g[0] != "\x07":
            middle = lambda x: (x[2] + x[4]) / 2
            if own and abs(middle(g) - middle(glyphs[own[0]])) > 0.6 * max(round(g[5], 1), 1):
                close(k)
                begin, own = k, []
            own.append(k)
    close(len(glyphs))
    return lines


def test_glyph_lines_of_many_pages_and_of_a_long_one(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(X, "SLICE", 40)  # pages are folded some at a time
    schema = "page int, glyphs array<struct<char:string,x0:double,top:double,x1:double,bottom:double,size:double,loose_top:double,loose_bottom:double,weight:int,font:string>>"
    some = [[glyph(rng.choice("ab \n\x07\t"), rng.randint(0, 9), rng.choice([0, 1, 20]), rng.choice([10.0, 4.0]), weight=rng.choice([400, 700])) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    long = [glyph("ab"[k % 2], 5 * k, 20 * (k // 2)) for k in range(20_000)]
    rows = [(k, g) for k, g in enumerate([*some, long, None])]
    got = {r.page: [tuple(x) for x in r.lines] for r in X.glyph_lines(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    assert got == {k: plain_lines(g or []) for k, g in rows}


def test_glyphs_of_one_small_file_are_dealt_into_tasks(spark):
    from pagestream.plans.study_queries import QUERIES

    assert spark.read.parquet("/root/testdata/sf0.001/part.parquet").rdd.getNumPartitions() == 1
    assert QUERIES["glyph_lines"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_arms_in_one_pass_equal_arms_alone(spark):
    rng = random.Random(9)
    rows = [(f"b{b}", i, rng.choice([None, 1, 2, 3]), None, rng.random() < 0.3, rng.random()) for b in range(12) for i in range(10)]
    signals = spark.createDataFrame(rows, "bundle_id string, page_index int, page_num int, page_total int, gold_start boolean, p double")
    arms = {f"t{t}": X.student(F.col("p"), t) for t in (0.3, 0.8)} | {"none": F.lit(None).cast("double")}
    got = {r.arm: (r.bundles, r.macro_f1, r.false_splits, r.missed, r.tp) for r in X.arm_scores(signals, arms).collect()}
    for name, c in arms.items():
        alone = signals.withColumn("confidence", F.when(F.col("page_index") > 0, c))
        d = lookahead.decide(alone, keep=("gold_start",))
        s = metrics.flagged_scores(d.select("bundle_id", (F.col("gold_start") & (F.col("page_index") > 0)).alias("g"), (F.col("split") & (F.col("page_index") > 0)).alias("y")), "g", "y").collect()
        n, f1, fp, fn, tp = got[name]
        assert (n, fp, fn, tp) == (12, sum(r.fp for r in s), sum(r.fn for r in s), sum(r.tp for r in s)) and abs(f1 - sum(r.f1 for r in s) / 12) < 1e-12


def test_choices_take_the_first_of_equals(spark):
    grid = spark.createDataFrame([(0.5, 0.9, 9), (0.6, 0.8, 3), (0.7, 0.8, 2), (0.8, 0.8, 2)], "t double, macro_f1 double, false_splits int")
    assert X.choose_threshold(grid, 3).head().t == 0.7 and X.choose_threshold(grid, 1).head().t is None
    bands = spark.createDataFrame([(0, 0.5, True), (1, 0.7, True), (2, 0.7, True), (3, 0.9, False)], "band int, macro_f1 double, eligible boolean")
    assert X.best_eligible(bands).head().band == 1 and X.best_eligible(bands.where("band = 3")).head().band is None


def test_trees_and_timings_are_kept(spark, tmp_path):
    trees = lambda *rows: X.write_trees(spark.createDataFrame(rows, "bundle_id string, tree string"), str(tmp_path / "trees"))
    trees(("a", '{"x":1}'), ("b", "{}"))
    assert {(r.bundle_id, r.value) for r in spark.read.text(str(tmp_path / "trees")).collect()} == {("a", '{"x":1}'), ("b", "{}")}
    trees(("b", "{2}"), ("c", "{}"))
    assert {(r.bundle_id, r.value) for r in spark.read.text(str(tmp_path / "trees")).collect()} == {("a", '{"x":1}'), ("b", "{2}"), ("c", "{}")}
    for s in (1.0, 2.0):
        X.append_timings(spark.createDataFrame([("f", s)], "file string, seconds double"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2


def test_strict_values():
    assert X.unit_interval(1, "x") == 1.0 and X.positive_int(3, "x") == 3 and X.gold_pages(" 7, 3,7 ") == [3, 7]
    for f, bad in ((X.unit_interval, True), (X.unit_interval, 1.1), (X.unit_interval, float("nan")), (X.positive_int, True), (X.positive_int, 0), (X.positive_int, 1.0)):
        with pytest.raises(ValueError):
            f(bad, "x")
    for bad in ("3, x", "3,,7", "", "-1"):
        with pytest.raises(ValueError):
            X.gold_pages(bad)


def test_a_false_split_that_moves_is_a_change(spark):
    score = lambda *rows: spark.createDataFrame(rows, "band int, bundle_id string, f1 double, tp long, fp long, fn long")
    marks = lambda *rows: spark.createDataFrame(rows, "band int, bundle_id string, page_index int")
    after = score((1, "a", 0.5, 1, 1, 1), (1, "b", 1.0, 1, 0, 0), (2, "a", 0.5, 1, 1, 1), (2, "b", 0.0, 0, 0, 1))
    before, old = after.where("band = 1").drop("band"), marks((0, "a", 3), (0, "a", 5), (0, "b", 2)).drop("band")
    out = X.compare_runs(before, after, old, marks((1, "a", 3), (1, "a", 6), (1, "b", 2), (2, "a", 3), (2, "a", 5)))
    assert {r["band"]: r["changed"] for r in out.collect()} == {1: 1, 2: 1}


def test_vectors_of_common_and_blank_texts(spark):
    pages = spark.createDataFrame([(1, "a "), (2, " a"), (3, " "), (4, None), (5, "b")], "k int, text string")
    vectors = spark.createDataFrame([("a",), ("a",)], "t string").select(X.text_key(F.col("t")).alias("key"), F.lit(1).alias("vector"))
    assert {r.k: r.vector for r in X.with_vectors(pages, vectors).collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: None}
