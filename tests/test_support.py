"""Page-number support against all pairs, and tags that are cut where reading had come to."""

import random

from pyspark.sql import functions as F

from pagestream import PipelineConfig, parse
from pagestream.operators import furniture, review


def supported(pages):
    """All pairs: (index, number, total) of one document."""
    if len(pages) == 1:
        return pages[0][1] == 1
    for j, (at, num, of) in enumerate(pages):
        for k, (i, n, t) in enumerate(pages[:j]):
            if num is None or (n is None and k):
                continue
            if t is not None and (num > t or (of is not None and of != t)):
                continue
            if (1 <= num <= at - i + 1) if n is None else (n < num <= n + at - i):
                return True
    return False


def test_number_support_equals_all_pairs(spark):
    r = random.Random(8)
    rows, want = [], {}
    for doc in range(900):
        n, top = r.choice([1, 2, 2, 3, 4, 7, 12]), r.choice([3, 9, 400])
        number = lambda: r.choice([None, r.randrange(0, top), r.randrange(0, top)])  # noqa: B023, E731
        pages = [(5 + 2 * k if doc % 3 else k, number(), r.choice([None, r.randrange(1, top + 1), 3])) for k in range(n)]
        want[doc] = supported(pages)
        rows += [("b", doc, *p) for p in pages]
    df = spark.createDataFrame(rows, "bundle_id string, doc_index int, page_index int, page_num int, page_total int")
    got = {x["doc_index"]: x["supported"] for x in review.number_support(df).collect()}
    assert got == want and 0.2 < sum(want.values()) / len(want) < 0.8


def test_a_document_of_many_pages_takes_seconds(spark):
    # Numbers fall, so that none carries on from any: every pair would have to be seen.
    pages = spark.range(100_000).select(F.lit("b").alias("bundle_id"), F.lit(0).alias("doc_index"), F.col("id").cast("int").alias("page_index"), (200_000 - F.col("id")).cast("int").alias("page_num"), F.when(F.col("id") % 2 == 0, 300_000).alias("page_total"))
    assert [r["supported"] for r in review.number_support(pages).collect()] == [False]


def bounds(spark, rows, **config):
    df = spark.createDataFrame([("b", *r) for r in rows], "bundle_id string, page_index int, doc_index int, confidence double, page_num int, effective boolean")
    return [r["read_to"] for r in furniture.read_bounds(df, **config).orderBy("page_index").collect()]


def test_how_far_was_read(spark):
    plain = [(k, 0, 0.0, k + 1, False) for k in range(4)]
    assert bounds(spark, plain) == [3] * 4
    sure = [*plain, (4, 1, 0.9, 1, True), (5, 1, 0.0, 2, False), (6, 1, 0.0, 3, False)]
    assert bounds(spark, sure) == [4] * 4 + [6] * 3  # settled as soon as it is read
    unsure = [*plain, (4, 1, 0.6, 1, True), (5, 1, 0.0, 2, False), (6, 1, 0.0, 3, False), (7, 1, 0.0, 4, False)]
    assert bounds(spark, unsure) == [6] * 4 + [7] * 4  # two pages later
    assert bounds(spark, unsure, window=0) == [4] * 4 + [7] * 4
    waits = [*plain[:3], (3, 0, 0.5, None, False), (4, 1, 0.9, 1, True), (5, 1, 0.0, 2, False)]
    assert bounds(spark, waits) == [5] * 6  # the page before holds it up


def test_a_head_that_repeats_only_later_isnt_tagged(spark):
    texts = ["Alpha head\n\nsome words here", "Beta line\n\nmore words there", "Gamma line\n\nother words now", "Alpha head\n\nwords again"]
    pages = spark.createDataFrame([("b", k, t) for k, t in enumerate(texts)], "bundle_id string, page_index int, text string")
    limit = spark.createDataFrame([("b", k, 2 if k < 2 else 3) for k in range(4)], "bundle_id string, page_index int, read_to int")
    head = lambda df: {r["page_index"]: r["is_header"] for r in df.collect()}
    assert head(furniture.tags(pages)) == {0: True, 1: False, 2: False, 3: True}
    assert head(furniture.tags(pages, bounds=limit)) == {0: False, 1: False, 2: False, 3: True}


def test_parse_tags_with_what_was_read(spark):
    texts = ["Alpha head\n\nsome words here\n\nPage 1 of 2", "Beta line\n\nmore words there\n\nPage 2 of 2", "Alpha head\n\nother words now\n\nPage 1 of 2", "Gamma line\n\nwords again\n\nPage 2 of 2"]
    pages = spark.createDataFrame([("b", k, t) for k, t in enumerate(texts)], "bundle_id string, page_index int, text string")
    out = parse(pages, PipelineConfig(window=0))  # page 2 splits as soon as it is read
    kinds = {(r["page_index"], r["kind"]) for r in out.blocks.collect()}
    assert (2, "header") in kinds and (0, "header") in kinds and len(out.documents.collect()) == 2
    out.close()


def test_numbers_meet_only_the_levels_that_ranges_reach(spark):
    widths = [1, 2, 3, 6, *(2**k for k in range(2, 32)), *(2**k - 1 for k in range(3, 32))]
    got = spark.createDataFrame([(w,) for w in widths], "w long").select("w", F.size(review._levels(F.col("w"))).alias("n")).collect()
    # All levels up to the one whose intervals are as wide as the range, and one more at most: three or four for a range of six, not 32.
    assert all(min(r.w.bit_length(), 32) <= r.n <= min(r.w.bit_length() + 1, 32) for r in got)
