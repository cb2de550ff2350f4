"""Queries of the operators around the parse, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestream.operators import experiments as X
from pagestream.operators import boundary
from pagestream.plans import queries as Q
from pagestream.plans.more_queries import registrar
from pagestream.plans.oracles import BLOCKS, DECISIONS, PAGES, SIGNALS, STRIP
from pagestream.sources import adapters as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
l AS (SELECT p_partkey, w, unnest(range((len(w) + 1) // 2)) AS l FROM w)
SELECT p_partkey, l::INT AS line, array_to_string(w[2 * l + 1 : 2 * l + 2], ' ') AS text, 96.0::DOUBLE + 20 * l AS top, 10.0::DOUBLE AS size, l = 0 AS bold FROM l""")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as glyphs, two words a line, with soft hyphens, hard spaces, raised last letters and sizes of one point."""
    words = F.split("p_name", " ")

    def glyph(c, i, j, lift):
        top, x = 100.0 + 20.0 * F.floor(i / 2) - lift, 5.0 * j + 100.0 * (i % 2)
        number = lambda v: v.cast("double")
        return F.struct(
            c.alias("char"), number(x).alias("x0"), number(top).alias("top"), number(x + 5).alias("x1"), number(top + 10).alias("bottom"), F.lit(1.0).alias("size"),
            number(top - 0.5).alias("loose_top"), number(top + 11).alias("loose_bottom"), F.when(i < 2, 700).otherwise(400).alias("weight"), F.lit("Body-Roman").alias("font"),
        )

    def word(w, i):
        letters = F.filter(F.split(w, ""), lambda c: c != "")
        own = F.flatten(F.transform(letters, lambda c, j: F.array(glyph(c, i, j, F.when(j == F.length(w) - 1, 4.0).otherwise(0.0)), glyph(F.lit("­"), i, j, F.lit(0.0)))))
        return F.concat(own, F.array(glyph(F.lit(" "), i, F.length(w), F.lit(0.0))))

    # A stored name grows to some seventy glyphs: a small file is dealt into more tasks than it has splits.
    pages = S.spread(S.table(spark, sf_dir, "part").select("p_partkey", "p_name"), S.NAME_BYTES).select("p_partkey", F.flatten(F.transform(words, word)).alias("glyphs"))
    lines = X.glyph_lines(pages).select("p_partkey", F.posexplode("lines").alias("line", "l"))
    return lines.select("p_partkey", "line", "l.text", "l.top", "l.size", "l.bold")


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'invoice' ELSE lang END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'own' END AS flags, CASE WHEN lang = 'en' THEN 'yes' END AS english FROM documents""")
def domain_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two adapters in order, of which one tries to set the key that isn't its own."""
    start = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("kind").alias("k"), F.col("lang").alias("v")), F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("flags").alias("k"), F.lit("own").alias("v"))))))
    put = lambda e, key, value: F.map_concat(F.map_filter(e, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))
    adapters = [X.Adapter("english", F.col("lang") == "en", lambda e: put(e, "english", "yes")), X.Adapter("invoices", F.col("doc_id") % 3 == 0, lambda e: put(put(e, "kind", "invoice"), "flags", "mine"))]
    out = X.apply_adapters(S.table(spark, sf_dir, "documents").select("doc_id", "lang", start.alias("extras")), adapters)
    return out.select("doc_id", *(F.try_element_at("extras", F.lit(k)).alias(k) for k in ("kind", "flags", "english")))


@query(BLOCKS + """
SELECT bundle_id, page_index, reading_order, CASE WHEN kind = 'heading' AND reading_order = min(reading_order) FILTER (kind = 'heading') OVER (PARTITION BY bundle_id, page_index) THEN 'title' ELSE kind END AS kind FROM blocks""")
def first_heading_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_heading_title(S.html_blocks(spark, sf_dir)).select("bundle_id", "page_index", "reading_order", "kind")


_BOX = "WITH b AS (SELECT p_partkey, p_size * 40 - 500 AS x0, 900 - p_size * 9 AS y0, (p_partkey * 37) % 1300 AS x1, (p_partkey * 11) % 700 - 50 AS y1 FROM part), "


@query(_BOX + """
c AS (SELECT p_partkey, least(1000, greatest(0, x0)) AS a, least(1000, greatest(0, y0)) AS b, least(1000, greatest(0, x1)) AS c, least(1000, greatest(0, y1)) AS d FROM b)
SELECT p_partkey, least(a, c)::INT AS x0, least(b, d)::INT AS y0, greatest(a, c)::INT AS x1, greatest(b, d)::INT AS y1, CASE WHEN p_partkey % 9 <> 0 THEN round(100 * least(a, c) / 612.0::DOUBLE, 6) END AS left_percent, CASE WHEN p_partkey % 9 <> 0 THEN round(100 * abs(b - d) / 792.0::DOUBLE, 6) END AS height_percent FROM c""")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with swapped corners and corners outside, in place and in percent of a page; some pages have no size."""
    k = F.col("p_partkey")
    box = X.ordered_box(F.col("p_size") * 40 - 500, 900 - F.col("p_size") * 9, k * 37 % 1300, k * 11 % 700 - 50)
    rows = S.table(spark, sf_dir, "part").select("p_partkey", box.alias("b"), F.when(k % 9 != 0, 612.0).alias("w"))
    percent = X.percent_box(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"), F.col("w"), F.lit(792.0))
    return rows.select("p_partkey", "b.*", F.round(percent["left"], 6).alias("left_percent"), F.round(percent["height"], 6).alias("height_percent"))


@query("""
WITH r AS (SELECT p_partkey, 0 AS place, 'title' AS label, 'Name ' || p_partkey AS text FROM part UNION ALL SELECT p_partkey, 1, 'image', 'seen' FROM part UNION ALL SELECT p_partkey, 2, 'text', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END FROM part)
SELECT p_partkey, place, label, length(text) AS chars, label <> 'image' AND text <> '' AS asked FROM r
UNION ALL SELECT p_partkey, -1, 'page', 10 + length(p_partkey::VARCHAR) + CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 2 + length(p_name) END + CASE WHEN p_partkey % 10 = 0 THEN 12001 ELSE 0 END, p_partkey % 10 <> 0 FROM part""")
def scored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a picture, some with an empty region, and some too long as a page (by what stands before the tags)."""
    k = F.col("p_partkey")
    lead = F.when(k % 10 == 0, F.concat(F.repeat(F.lit("x"), 12000), F.lit(" "))).otherwise("")
    raw = F.concat(lead, F.lit("![title](0,-3,900,20)"), F.format_string("Name %d", k), F.lit("\n![image](5,5,9,9)seen\n\n![text+](1,20,900,50)"), F.when(k % 4 == 0, "").otherwise(F.col("p_name")))
    rows = X.scored_regions(S.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")), ["p_partkey"])
    return rows.select("p_partkey", F.col("at").alias("place"), "label", "chars", "asked")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_partkey % 3 <> 0 END AS right_text FROM part""")
def region_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked names against pages that hold them, or don't; some pages have no true text, some regions are empty."""
    k = F.col("p_partkey")
    gold = F.when(k % 7 != 0, F.concat(F.lit("x "), F.when(k % 3 != 0, F.col("p_name")).otherwise("another"), F.lit(" y")))
    text = F.when(k % 5 != 0, F.concat(F.lit("# **"), "p_name", F.lit("**"))).otherwise("**")
    return S.table(spark, sf_dir, "part").select("p_partkey", X.region_right(text, gold).alias("right_text"))


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lpad(doc_id::VARCHAR, 12, '0')) - 1 AS k FROM documents)
SELECT source || '/' || lpad(doc_id::VARCHAR, 12, '0') AS key FROM r WHERE k % 4 = 0 AND doc_id % 5 <> 0""")
def stride_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth record of a source that isn't done yet."""
    records = S.table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), "doc_id")
    done = records.where("doc_id % 5 = 0").select(F.concat_ws("/", "file", "name").alias("key"))
    return X.stride_todo(records, done, 4).select("key")


_KEY = STRIP.format("coalesce(text, '')")


@query(f"""
WITH d AS (SELECT doc_id, {_KEY} AS body FROM documents), v AS (SELECT body, min(doc_id) AS vector FROM d WHERE doc_id % 3 <> 0 AND body <> '' GROUP BY 1)
SELECT doc_id, vector FROM d LEFT JOIN v USING (body)""")
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the texts have a vector, here a number, under their key."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = docs.where("doc_id % 3 <> 0").select(X.text_key(F.col("text")).alias("key"), "doc_id").where("key is not null").groupBy("key").agg(F.min("doc_id").alias("vector"))
    return X.with_vectors(docs, vectors).select("doc_id", "vector")


_P = "CASE WHEN gold_start AND gold_id % 4 <> 0 THEN 0.9::DOUBLE ELSE ((gold_id * 7 + page_index * 13) % 100) / 100.0::DOUBLE END"
_GRID = (0.5, 0.7, 0.85, 0.95)
_ARMS = SIGNALS + f"""
, z AS (SELECT bundle_id, gold_start AND page_index > 0 AS g, page_index > 0 AS later, coalesce(confidence, 0) AS c, {_P} AS p FROM sig),
e AS (SELECT bundle_id, 'heuristic' AS arm, g, later AND c >= 0.55 AS y FROM z
  {" ".join(f"UNION ALL SELECT bundle_id, 't{t}', g, later AND p >= {t} FROM z" for t in _GRID)} UNION ALL SELECT bundle_id, 'beside', g, later AND (p >= 0.85 OR c >= 0.55) FROM z),
m AS (SELECT arm, bundle_id, count(*) FILTER (g AND y) AS tp, count(*) FILTER (y AND NOT g) AS fp, count(*) FILTER (g AND NOT y) AS fn FROM e GROUP BY 1, 2),
s AS (SELECT arm, count(*) AS bundles, avg(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END) AS macro_f1, sum(fp)::BIGINT AS false_splits, sum(fn)::BIGINT AS missed, sum(tp)::BIGINT AS tp FROM m GROUP BY 1)
"""


def _student(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("gold_start") & (F.col("gold_id") % 4 != 0), 0.9).otherwise((F.col("gold_id") * 7 + F.col("page_index") * 13) % 100 / 100)
    return Q.signals(spark, sf_dir).withColumn("p", p)


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    arms = {"heuristic": F.col("confidence")} | {f"t{t}": X.student(p, t) for t in _GRID} | {"beside": X.beside(F.col("confidence"), X.student(p, 0.85))}
    at_once = lambda rows: rows.withColumn("split", F.coalesce("confidence", F.lit(0.0)) >= 0.55)
    return X.arm_scores(_student(spark, sf_dir), arms, at_once)


@query(_ARMS + "SELECT arm, bundles, round(macro_f1, 6) AS macro_f1, false_splits, missed, tp, CASE WHEN tp + false_splits > 0 THEN round(tp / (tp + false_splits)::DOUBLE, 6) END AS micro_precision, CASE WHEN tp + missed > 0 THEN round(tp / (tp + missed)::DOUBLE, 6) END AS micro_recall FROM s")
def decision_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristics, a student alone at several thresholds, and both, without look-ahead."""
    return _arms(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("macro_f1", "micro_precision", "micro_recall")})


@query(_ARMS + """
SELECT arm[2:]::DOUBLE AS t, round(macro_f1, 6) AS macro_f1 FROM s WHERE arm LIKE 't%' AND false_splits <= (SELECT false_splits + 3 * bundles FROM s WHERE arm = 'heuristic') ORDER BY round(macro_f1, 12) DESC, false_splits, 1 LIMIT 1""")
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The student's threshold with the best macro F1 that makes at most three false splits a bundle more than the heuristics."""
    scores = _arms(spark, sf_dir).persist()
    base = scores.where("arm = 'heuristic'").head()
    grid = scores.where("arm like 't%'").select(F.substring("arm", 2, 9).cast("double").alias("t"), F.round("macro_f1", 12).alias("macro_f1"), "false_splits")
    return X.choose_threshold(grid, base.false_splits + 3 * base.bundles).withColumn("macro_f1", F.round("macro_f1", 6))


@query(SIGNALS + f"""
, z AS (SELECT bundle_id, page_index, gold_start AND page_index > 0 AS g, page_index > 0 AS later, coalesce(confidence, 0) AS c, {_P} AS p FROM sig),
e AS (SELECT bundle_id, page_index, -1 AS band, g, later AND c >= 0.55 AS y FROM z UNION ALL SELECT bundle_id, page_index, 0, g, later AND c >= 0.4 FROM z UNION ALL SELECT bundle_id, page_index, 1, g, later AND c >= 0.4 AND p >= 0.85 FROM z UNION ALL SELECT bundle_id, page_index, 2, g, later AND c >= 0.6 FROM z),
m AS (SELECT band, bundle_id, list(page_index ORDER BY page_index) FILTER (y) AS pages, count(*) FILTER (g AND y) AS tp, count(*) FILTER (y AND NOT g) AS fp, count(*) FILTER (g AND NOT y) AS fn FROM e GROUP BY 1, 2),
fb AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM m),
r AS (SELECT b.band, round(avg(b.f1), 6) AS macro_f1, sum(b.fp)::BIGINT AS false_splits, round(avg(a.f1), 6) AS baseline_macro_f1, sum(a.fp)::BIGINT AS baseline_false_splits, count(*) FILTER (a.pages IS DISTINCT FROM b.pages) AS changed FROM fb a JOIN fb b ON a.bundle_id = b.bundle_id AND a.band = -1 AND b.band >= 0 GROUP BY 1),
x AS (SELECT *, false_splits <= baseline_false_splits AS eligible FROM r)
SELECT *, band = (SELECT band FROM x WHERE eligible ORDER BY macro_f1 DESC, band LIMIT 1) AS best FROM x""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to confirm, each against the decisions without any."""
    rows = _student(spark, sf_dir).withColumn("c", F.coalesce("confidence", F.lit(0.0)))
    later, c = F.col("page_index") > 0, F.col("c")
    rules = (c >= 0.4, (c >= 0.4) & (F.col("p") >= 0.85), c >= 0.6)
    out = X.compare_decisions(rows, F.col("gold_start") & later, later & (c >= 0.55), [later & y for y in rules])
    return X.with_best(out.withColumns({k: F.round(k, 6) for k in ("macro_f1", "baseline_macro_f1")}))


@query(PAGES + "SELECT max(page_num)::INT AS maximum FROM pages WHERE bundle_id::BIGINT % 5 = 0")
def holdout_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    holdout = S.table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select(F.col("o_custkey").cast("string").alias("bundle_id"))
    return X.holdout_maximum(S.order_pages(spark, sf_dir), holdout, "page_num")


@query(r"""
WITH f AS (SELECT regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem FROM pages UNION ALL SELECT 'p' || (page_id % 7) FROM pages)
SELECT stem, count(*) AS files FROM f GROUP BY 1 HAVING count(*) > 1""")
def clashing_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "pages")
    paths = pages.select(F.col("url").alias("path")).unionByName(pages.select(F.format_string("in/p%d.pdf", F.col("page_id") % 7).alias("path")))
    return X.clashing_stems(paths)


@query(DECISIONS + """
, r AS (SELECT bundle_id, doc_index, min(page_index) AS a, max(page_index) AS z FROM indexed GROUP BY 1, 2)
SELECT bundle_id, count(*)::INT AS documents, bundle_id || '-doc-0' AS first_id, max(z)::INT AS last_page, arg_max(z - a + 1, a)::INT AS last_sections FROM r GROUP BY 1""")
def document_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of the split bundles, each page a section, as JSON and read back."""
    indexed = Q._indexed(spark, sf_dir)
    name = F.format_string("%s-doc-%d", "bundle_id", "doc_index")
    documents = boundary.document_ranges(indexed).withColumns({"document_id": name, "title": F.lit(None).cast("string")})
    sections = indexed.select("bundle_id", name.alias("document_id"), F.col("page_index").alias("page_start"), F.col("page_index").alias("page_end"), F.format_string("s%d", "page_index").alias("section_id"), F.lit("h").alias("heading"))
    tree = F.from_json("tree", "struct<documents:array<struct<document_id:string,page_end:int,sections:array<struct<section_id:string>>>>>")["documents"]
    rows = X.document_trees(documents, sections).select("bundle_id", tree.alias("d"))
    last = F.element_at("d", -1)
    return rows.select("bundle_id", F.size("d").alias("documents"), F.col("d")[0]["document_id"].alias("first_id"), last["page_end"].alias("last_page"), F.size(last["sections"]).alias("last_sections"))
