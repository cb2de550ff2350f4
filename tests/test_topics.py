"""Products of neighbouring pages' words and the features over them, by brute force and by plan."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators import boundary, model

PAGES = "bundle_id string, page_index int, text string"


def streams():
    r = random.Random(5)
    words = ["Alpha", "bravo", "CHARLIE", "İstanbul", "ΟΔΟΣ", "straße", "that", "WITH", "of", "x1y2", "delta½", "日本語文", "한국어", "東京"]
    pages = [("long", k, " ".join(r.choices(words, k=r.randrange(40)))) for k in range(1100)]
    pages += [("gap", k, "alpha bravo alpha") for k in (0, 2, 3, 255, 256, 257, 511, 513)]
    return pages + [("odd", k, t) for k, t in enumerate(["alpha", None, "", "that with", "alpha ALPHA", "alpha", "a-b"])]


def test_products_across_parts_by_brute_force(spark):
    pages = streams()
    df = spark.createDataFrame(pages, PAGES)
    counts = {(r.bundle_id, r.page_index): Counter(r.w or []) for r in df.select("bundle_id", "page_index", T.content_words(F.col("text")).alias("w")).collect()}
    dot = lambda a, b: sum(n * b[w] for w, n in a.items())
    want = {(b, i): (sum(c.values()), dot(c, c), *(dot(c, counts.get((b, i - k), Counter())) for k in (1, 2))) for (b, i), c in counts.items()}
    for tasks in (None, 7):
        rows = boundary.topic_dots(df, tasks).collect()
        assert len(rows) == len(pages)
        assert {(r.bundle_id, r.page_index): (r.n_words, r.norm, r.dot1, r.dot2) for r in rows} == want
    assert sum(want["long", i][2] > 0 and want["long", i][3] > 0 for i in (256, 257, 512, 513, 768, 769, 1024, 1025)) == 8


def test_features_move_texts_once_and_no_window_holds_them(spark):
    from pagestream.plans import queries

    plan = queries.features16(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    windows = [line for line in plan if " Window [" in line]
    assert windows and not any("lag(text#" in line for line in windows)  # it held a whole source's texts
    at = next(k for k, line in enumerate(plan) if "Generate explode(" in line and "regexp_extract_all" in line)
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    above = [line for k, line in enumerate(plan[:at]) if all(deep(x) > deep(line) for x in plan[k + 1 : at + 1])]
    first = next(line for line in reversed(above) if "Exchange" in line or "Aggregate" in line)
    assert "HashAggregate(keys=[bundle_id" in first and "word" not in first  # words were exchanged twice


def test_features_of_neighbours(spark):
    texts = ["the cat and the dog\nReferences\n[1] of it", "see arXiv: 2101.00001 at the university", None, "Abstract: introduction\nbibliography follows", "last"]
    rows = [("b", k, k or None, 5, "top" if k == 1 else None, t, 600.0 + 30 * (k == 2), 800.0, 0) for k, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, PAGES.replace("text", "page_num int, page_total int, title string, text") + ", width double, height double, rotation int")
    got = {r.page_index: r for r in model.features(pages).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    told = ("arxiv_stamp", "head_abstract", "head_intro", "head_affil", "prev_refs", "media_jump", "num_is_one", "prev_has_num", "title_top")
    assert [[int(got[k][c]) for c in told] for k in (1, 2, 3, 4)] == [[1, 0, 0, 1, 1, 0, 1, 0, 1], [0, 0, 0, 0, 0, 1, 0, 1, 0], [0, 1, 1, 0, 0, 1, 0, 1, 0], [0, 0, 0, 0, 1, 0, 0, 1, 0]]
