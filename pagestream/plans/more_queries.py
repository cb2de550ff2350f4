"""Queries of the review, evaluation and recognition operators, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators import assemble, boundary, decision, evaluation, lookahead, metrics, recognition, review
from pagestream.plans import pipeline
from pagestream.plans import queries as Q
from pagestream.plans.oracles import _TAGS, BLOCKS, DECISIONS, MARKS, PAGES, SIGNALS, TEXTS
from pagestream.sources import adapters as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registrar(queries: dict, oracles: dict):
    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query


query = registrar(QUERIES, ORACLES)


_FINAL = TEXTS + ", tags AS (" + _TAGS.format(3).strip() + ")"
_SEEN = TEXTS + ", tags AS (" + _TAGS.format(-1).strip() + ")"


@query(_SEEN + """
, h AS (SELECT t.*, l.top FROM tags t JOIN l USING (bundle_id, page_index))
SELECT bundle_id, page_index, coalesce(lag(is_header) OVER w AND top <> lag(top) OVER w, false) AS header_changed, false AS title_top, false AS title_block
FROM h WINDOW w AS (PARTITION BY bundle_id ORDER BY page_index)""")
def header_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads of the conversations, as a reader from the front sees them."""
    pages = Q._conversation_text(spark, sf_dir).withColumns({"width": F.lit(600.0), "height": F.lit(800.0), "rotation": F.lit(0)})
    out = boundary.head_signals(pages, pipeline.page_blocks(pages, final=False))
    return out.select("bundle_id", "page_index", "header_changed", "title_top", "title_block")


@query(_FINAL + r"""
, x AS (SELECT t.*, l.top, l.bottom, replace(c.text, chr(10), ' ') AS body FROM tags t JOIN l USING (bundle_id, page_index)
  JOIN (SELECT conv_id::VARCHAR AS bundle_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS page_index, text FROM conversations) c USING (bundle_id, page_index)),
p AS (
  SELECT bundle_id, page_index, 0 AS o, 'header' AS kind, '-header' AS suffix, top AS text FROM x WHERE is_header
  UNION ALL SELECT bundle_id, page_index, 1, 'paragraph', '', concat_ws(chr(10), CASE WHEN NOT is_header THEN top END, regexp_replace(body, '\s+$', ''), CASE WHEN NOT is_footer THEN 'Kept by the office 2024' END) FROM x
  UNION ALL SELECT bundle_id, page_index, 2, 'footer', '-footer', 'Kept by the office 2024' FROM x WHERE is_footer
  UNION ALL SELECT bundle_id, page_index, 3, 'page_number', '-page_number', bottom FROM x)
SELECT bundle_id, page_index, (row_number() OVER (PARTITION BY bundle_id, page_index ORDER BY o) - 1)::INT AS reading_order, bundle_id || '-p' || page_index || '-b0' || suffix AS block_id, kind, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS text_md5 FROM p""")
def edge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the conversations with heads, feet and page numbers cut out of the text."""
    out = pipeline.page_blocks(Q._conversation_text(spark, sf_dir))
    return out.select("bundle_id", "page_index", "reading_order", "block_id", "kind", F.md5(T.one_space(F.col("text"))).alias("text_md5"))


_DECIDED = DECISIONS + """,
pg AS (SELECT i.*, p.page_num, p.page_total, s.confidence, s.reason AS signal FROM indexed i JOIN pages p USING (bundle_id, page_index) JOIN sig s USING (bundle_id, page_index))
"""


@query(_DECIDED + """,
lastd AS (SELECT bundle_id, max(doc_index) AS doc_index FROM pg GROUP BY 1 HAVING max(doc_index) > 0),
e AS (SELECT pg.* FROM pg JOIN lastd USING (bundle_id, doc_index)),
shape AS (SELECT bundle_id, doc_index, count(*) AS n, min(page_index) AS first, min_by(coalesce(page_num, 0), page_index) AS first_num FROM e GROUP BY 1, 2),
ok AS (SELECT DISTINCT o.bundle_id FROM e o JOIN shape s USING (bundle_id, doc_index) JOIN e a ON a.bundle_id = o.bundle_id AND a.page_index < o.page_index
  WHERE o.page_num IS NOT NULL AND (a.page_num IS NOT NULL OR a.page_index = s.first) AND (a.page_total IS NULL OR (o.page_num <= a.page_total AND (o.page_total IS NULL OR o.page_total = a.page_total)))
    AND CASE WHEN a.page_num IS NULL THEN o.page_num BETWEEN 1 AND o.page_index - a.page_index + 1 ELSE o.page_num > a.page_num AND o.page_num <= a.page_num + o.page_index - a.page_index END)
SELECT bundle_id, doc_index, 0 AS rank, 'weak_boundary' AS flag, page_index AS page FROM pg WHERE effective AND (reason = 'fallback_eager' OR (reason = 'high_confidence' AND NOT list_contains(string_split(coalesce(signal, ''), '+'), 'page_number_reset')))
UNION ALL SELECT bundle_id, doc_index, 1, 'fallback_decision', page_index FROM pg WHERE reason = 'fallback_below' AND signal IS NOT NULL
UNION ALL SELECT bundle_id, doc_index, 2, 'eof_flush', first FROM shape WHERE CASE WHEN n = 1 THEN first_num <> 1 ELSE bundle_id NOT IN (SELECT bundle_id FROM ok) END""")
def uncertainty_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.uncertainty_flags(_indexed(spark, sf_dir))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._indexed(spark, sf_dir, ("page_num", "page_total", "signal"))


@query(_DECIDED + """,
last AS (SELECT bundle_id, max(page_index) AS last, max(doc_index) AS d FROM pg GROUP BY 1),
ev AS (
  SELECT bundle_id, page_index AS r, 0 AS ph, 0 AS sub, 'page_classified' AS kind, page_index, CASE WHEN width > 600 THEN 'text' ELSE 'scan' END AS payload FROM pages
  UNION ALL SELECT bundle_id, page_index, 1, 0, 'block_emitted', page_index, bundle_id || '-p' || page_index || '-b0' FROM pages
  UNION ALL SELECT bundle_id, page_index, 2, 0, 'boundary_proposed', page_index, signal FROM pg WHERE confidence IS NOT NULL
  UNION ALL SELECT bundle_id, least(page_index + 2, last), 3, page_index * 4, 'boundary_decided', page_index, reason FROM pg JOIN last USING (bundle_id)
  UNION ALL SELECT bundle_id, least(page_index + 2, last), 3, page_index * 4 + 1, 'document_closed', page_index, bundle_id || '-doc-' || (doc_index - 1) FROM pg JOIN last USING (bundle_id) WHERE effective
  UNION ALL SELECT bundle_id, least(page_index + 2, last), 3, page_index * 4 + 2, 'document_opened', page_index, bundle_id || '-doc-' || doc_index FROM pg JOIN last USING (bundle_id) WHERE effective OR page_index = 0
  UNION ALL SELECT bundle_id, last, 4, 0, 'document_closed', last, bundle_id || '-doc-' || d FROM last
  UNION ALL SELECT bundle_id, last, 5, 0, 'bundle_closed', last, bundle_id FROM last)
SELECT bundle_id, (row_number() OVER (PARTITION BY bundle_id ORDER BY r, ph, sub) - 1)::INT AS seq, kind, page_index::INT AS page, payload FROM ev""")
def full_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the order pages, each a block; a decision follows two pages later."""
    pages = Q._indexed(spark, sf_dir, ("width", "signal"))
    block = F.concat("bundle_id", F.lit("-p"), F.col("page_index").cast("string"), F.lit("-b0"))
    return review.page_events(pages.withColumns({"page_class": F.when(F.col("width") > 600, "text").otherwise("scan"), "block_ids": F.array(block)}))


@query(BLOCKS + r"""
, d AS (SELECT bundle_id, page_index // 3 AS d, bundle_id || '-' || (page_index // 3) AS document_id, * EXCLUDE (bundle_id) FROM blocks),
b AS (SELECT document_id, block_id, CASE WHEN reading_order % 4 = 3 THEN 'footer' ELSE kind END AS kind, CASE reading_order % 4 WHEN 3 THEN 'Foot ' || (page_index % 2) WHEN 2 THEN text || chr(10) || ' Foot  ' || (page_index % 3) ELSE text END AS text, page_index, reading_order FROM d),
fu AS (SELECT DISTINCT document_id, text AS line FROM b WHERE kind = 'footer'),
docs AS (SELECT document_id, min(page_index) AS s, max(page_index) AS e FROM b GROUP BY 1),
f AS (
  SELECT document_id, 'section_outside_document' AS "check", 'sec' AS ref, (s) || '-' || (e + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END) AS detail FROM docs WHERE s % 2 = 0
  UNION ALL SELECT b.document_id, 'furniture_in_body', block_id, 'Foot ' || (page_index % 3) FROM b JOIN fu ON fu.document_id = b.document_id AND fu.line = 'Foot ' || (page_index % 3) WHERE kind NOT IN ('title', 'footer') AND reading_order % 4 = 2
  UNION ALL SELECT document_id, 'title_equals_furniture', NULL, 'Foot 0' FROM fu WHERE line = 'Foot 0')
SELECT * FROM f""")
def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three checks over the html pages, three a document, with feet that other blocks repeat."""
    at, page = F.col("reading_order") % 4, F.col("page_index")
    text = F.when(at == 3, F.format_string("Foot %d", page % 2)).when(at == 2, F.concat("text", F.format_string("\n Foot  %d", page % 3))).otherwise(F.col("text"))
    blocks = S.html_blocks(spark, sf_dir).select(F.format_string("%s-%d", "bundle_id", F.floor(page / 3)).alias("document_id"), "block_id", F.when(at == 3, "footer").otherwise(F.col("kind")).alias("kind"), text.alias("text"), "page_index")
    docs = blocks.groupBy("document_id").agg(F.min("page_index").alias("page_start"), F.max("page_index").alias("page_end")).withColumn("title", F.lit("Foot  0"))
    sections = docs.select("document_id", F.lit("sec").alias("section_id"), "page_start", (F.col("page_end") + F.when(F.col("page_start") % 2 == 0, 1).otherwise(0)).alias("page_end"))
    return review.review_checks(docs, sections, blocks)


@query(PAGES + """
, s AS (SELECT bundle_id, page_index, page_num, gold_id % 90 AS g, CASE WHEN page_num = 1 THEN 1 WHEN page_num % 2 = 0 THEN 2 ELSE 3 END AS depth,
    CASE WHEN page_num = 1 THEN (gold_id % 90)::VARCHAR WHEN page_num % 2 = 0 THEN (gold_id % 90) || '.' || page_num ELSE (gold_id % 90) || '.' || (page_num - 1) || '.' || page_num END AS num,
    CASE WHEN page_num = 1 THEN NULL WHEN page_num % 2 = 0 THEN (gold_id % 90)::VARCHAR ELSE (gold_id % 90) || '.' || (page_num - 1) END AS want, bundle_id || '-p' || page_index || '-b0-sec' AS id FROM pages WHERE page_num IS NOT NULL)
SELECT c.bundle_id, c.page_index AS page, c.id AS ref, NULL::VARCHAR AS from_id, (SELECT max_by(p.id, p.page_index) FROM s p WHERE p.bundle_id = c.bundle_id AND p.page_index < c.page_index AND p.num = c.want) AS to_id, c.num AS numbering
FROM s c WHERE EXISTS (SELECT 1 FROM s p WHERE p.bundle_id = c.bundle_id AND p.page_index < c.page_index AND p.num = c.want)""")
def rank_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of line items with outline numbers for headings, all of level 1 before."""
    rows = S.order_pages(spark, sf_dir).where("page_num is not null")
    part, n = F.col("gold_id") % 90, F.col("page_num")
    heading = F.when(n == 1, F.format_string("%d Part", part)).when(n % 2 == 0, F.format_string("%d.%d Item", part, n)).otherwise(F.format_string("Section %d.%d.%d. Detail", part, n - 1, n))
    blocks = rows.select("bundle_id", "page_index", F.lit(0).alias("reading_order"), F.lit("heading").alias("kind"), F.lit(1).alias("heading_level"), heading.alias("text"), F.format_string("%s-p%d-b0", "bundle_id", "page_index").alias("block_id"))
    return assemble.repaired(assemble.sections(blocks))


@query(r"""
WITH t AS (SELECT p_partkey, p_size AS n, p_size % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN n || '.' || (n + 1) WHEN 1 THEN n || '.' || n WHEN 2 THEN CASE WHEN n * 7 <= 99 THEN (n * 7)::VARCHAR END WHEN 3 THEN n || '.0' || n WHEN 4 THEN 'ARTICLE ' || n ELSE CASE WHEN n % 4 = 1 THEN 'Article xIv' END END AS token,
  CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN CASE WHEN n * 7 <= 99 THEN 1 END WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE CASE WHEN n % 4 = 1 THEN 1 END END AS depth FROM t""")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_size") % 6
    roman = F.when(n % 4 == 1, F.lit("Article xIv. The end")).otherwise(F.lit("Article IIX x"))
    text = F.when(k == 0, F.format_string("%d.%d %s", n, n + 1, "p_name")).when(k == 1, F.format_string("Section %d.%d", n, n)).when(k == 2, F.format_string("%d Budget", n * 7)).when(k == 3, F.format_string("%d.0%d x\n9.9 y", n, n)).when(k == 4, F.format_string("ARTICLE %d. x", n)).otherwise(roman)
    rows = S.table(spark, sf_dir, "part").select("p_partkey", T.numbering(text).alias("x"))
    return rows.select("p_partkey", "x.token", "x.depth")


@query("""
WITH t AS (SELECT event_id, event_id % 12 AS k, round(abs(value) % 2, 2) AS v FROM events)
SELECT event_id, (CASE WHEN k IN (0, 11) AND v <= 1 THEN v WHEN k IN (3, 7) THEN 1.0 WHEN k = 6 THEN 0.7 END)::DOUBLE AS probability FROM t""")
def sentence_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.format_string("%.2f", F.abs("value") % 2), F.col("event_id") % 12
    forms = [F.concat(F.lit("The probability is "), v, F.lit(".")), F.concat(F.lit("about "), v, F.lit(" percent")), F.concat(F.lit("- "), v), F.lit("score 1"), F.lit("page 1"), F.concat(v, F.lit(" or "), v), F.lit("score .7"), F.lit("p 1"), F.lit("confidence 1"), F.concat(v, F.lit(" per cent")), F.concat(F.lit("it is −"), v), F.concat(v, F.lit(" percentile"))]
    text = forms[-1]
    for n, form in reversed(list(enumerate(forms[:-1]))):
        text = F.when(k == n, form).otherwise(text)
    return S.table(spark, sf_dir, "events").select("event_id", F.round(T.sentence_probability(text), 6).alias("probability"))


@query(MARKS + """,
h AS (SELECT * FROM scores WHERE bundle_id::BIGINT % 5 = 0),
fails AS (SELECT bundle_id, 'low_f1' AS failure FROM scores WHERE f1 < 0.2
  UNION ALL SELECT DISTINCT bundle_id, 'false_ocr' FROM pages WHERE page_num > 6
  UNION ALL SELECT NULL, 'low_macro' FROM h HAVING avg(f1) < 0.95)
SELECT coalesce(bundle_id, '-') AS bundle_id, failure FROM fails""")
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, holdout = Q._scores(spark, sf_dir), F.col("bundle_id").cast("long") % 5 == 0
    wrong = S.order_pages(spark, sf_dir).where("page_num > 6")
    return evaluation.gate_failures(scores, evaluation.Floors(0.2, 0.95), wrong, holdout).select(F.coalesce("bundle_id", F.lit("-")).alias("bundle_id"), "failure")


@query(MARKS + """,
h AS (SELECT count(*) AS bundles, avg(f1) AS m, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM scores WHERE bundle_id::BIGINT % 5 = 0)
SELECT bundles, round(m, 6) AS macro_f1, round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, floor(m * 100) / 100 AS proposed_floor FROM h""")
def holdout_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = Q._scores(spark, sf_dir)
    out = evaluation.holdout_scorecard(scores, scores.where(F.col("bundle_id").cast("long") % 5 == 0))
    return out.select("bundles", *(F.round(c, 6).alias(c) for c in ("macro_f1", "micro_precision", "micro_recall", "micro_f1")), "proposed_floor")


_ARMS = MARKS + """,
em AS (SELECT p.bundle_id, count(*) FILTER (g AND e) AS tp, count(*) FILTER (e AND NOT g) AS fp, count(*) FILTER (g AND NOT e) AS fn
  FROM (SELECT bundle_id, page_index > 0 AND gold_start AS g, page_index > 0 AND coalesce(confidence, 0) >= 0.55 AS e FROM sig) p GROUP BY 1),
es AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM em),
arms AS (SELECT a.bundle_id, a.f1 AS fa, b.f1 AS fb, a.tp AS ta, a.fp AS pa, a.fn AS na, b.tp AS tb, b.fp AS pb, b.fn AS nb FROM es a JOIN scores b USING (bundle_id))
"""


def _eager_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.col("page_index") > 0
    rows = Q.signals(spark, sf_dir).select("bundle_id", "page_index", (F.col("gold_start") & later).alias("gold"), (later & (F.coalesce("confidence", F.lit(0.0)) >= 0.55)).alias("predicted"))
    return metrics.flagged_scores(rows, "gold", "predicted")


@query(_ARMS + """
, r AS (SELECT 'risen' AS roles, *, fa >= 1 AS sat FROM arms WHERE CASE WHEN fa >= 1 THEN fb >= 1 ELSE fb > fa + 1e-12 END UNION ALL SELECT 'all', *, fa >= 1 FROM arms)
, x AS (SELECT roles, coalesce(bool_and(abs(fa - fb) < 1e-12) FILTER (sat), true) AS saturated_unchanged, coalesce(bool_and(fb > fa + 1e-12) FILTER (NOT sat), false) AS every_miss_up, avg(fb) > avg(fa) AS macro_up,
  2 * sum(tb) / sum(2 * tb + pb + nb)::DOUBLE > 2 * sum(ta) / sum(2 * ta + pa + na)::DOUBLE AS micro_up, roles = 'risen' AS residual_open, count(*) FILTER (fb < fa - 1e-12) AS falls FROM r GROUP BY 1)
SELECT *, saturated_unchanged AND every_miss_up AND macro_up AND micro_up AND residual_open AS ship FROM x""")
def ship_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ahead against no look-ahead, by the rule for a new scorer: over bundles that rose or were full, and over all."""
    same = lambda df: df.withColumn("f1", F.round("f1", 12))  # noqa: E731  equal counts are equal scores
    before, after = same(_eager_scores(spark, sf_dir)), same(Q._scores(spark, sf_dir))
    both = before.join(after.select("bundle_id", F.col("f1").alias("then")), "bundle_id")
    risen = evaluation.ship_checks(before, after, both.where("f1 >= 1 and then >= 1"), both.where("f1 < 1 and then > f1"), residual_positives=1)
    every = evaluation.ship_checks(before, after, before.where("f1 >= 1"), before.where("f1 < 1"))
    return risen.withColumn("roles", F.lit("risen")).unionByName(every.withColumn("roles", F.lit("all")))


@query(SIGNALS + """
, e AS (SELECT bundle_id, page_index FROM sig WHERE coalesce(confidence, 0) >= 0.55), s AS (SELECT bundle_id, page_index FROM sig WHERE coalesce(confidence, 0) >= 0.4 AND page_index % 3 <> 0),
x AS (SELECT coalesce(e.bundle_id, s.bundle_id) AS bundle_id, e.page_index AS a, s.page_index AS b FROM e FULL JOIN s ON e.bundle_id = s.bundle_id AND e.page_index = s.page_index WHERE e.page_index IS NULL OR s.page_index IS NULL)
SELECT bundle_id, count(a) AS only_first, count(b) AS only_second FROM x GROUP BY 1""")
def changed_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.signals(spark, sf_dir)
    return evaluation.changed_bundles(rows.where("confidence >= 0.55"), rows.where("confidence >= 0.4 and page_index % 3 <> 0"))


@query(SIGNALS + """
, g AS (SELECT bundle_id, page_index FROM pages WHERE gold_start AND page_index > 0), p AS (SELECT bundle_id, page_index + page_index % 2 AS page_index FROM sig WHERE confidence IS NOT NULL),
b AS (SELECT bundle_id, count(*) AS n_gold FROM g GROUP BY 1), c AS (SELECT bundle_id, count(DISTINCT page_index) AS n_pred FROM p GROUP BY 1), m AS (SELECT g.bundle_id, count(*) AS matched FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.bundle_id = g.bundle_id AND p.page_index = g.page_index) GROUP BY 1)
SELECT bundle_id, coalesce(matched, 0)::BIGINT AS matched, coalesce(n_gold, 0)::BIGINT AS n_gold, coalesce(n_pred, 0)::BIGINT AS n_pred FROM b FULL JOIN c USING (bundle_id) LEFT JOIN m USING (bundle_id)""")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.signals(spark, sf_dir)
    predicted = rows.where("confidence is not null").select("bundle_id", (F.col("page_index") + F.col("page_index") % 2).alias("page_index")).distinct()
    return evaluation.tolerant_scores(rows.where("gold_start and page_index > 0"), predicted, 0).select("bundle_id", "matched", "n_gold", "n_pred")


@query(SIGNALS + """
, g AS (SELECT bundle_id, page_index, row_number() OVER (PARTITION BY bundle_id ORDER BY page_index) AS k FROM pages WHERE gold_start AND page_index > 0),
p AS (SELECT DISTINCT bundle_id, page_index + page_index % 3 AS page_index FROM sig WHERE confidence IS NOT NULL),
near AS (SELECT g.bundle_id, g.k, list(p.page_index ORDER BY abs(p.page_index - g.page_index), p.page_index) AS c FROM g JOIN p ON p.bundle_id = g.bundle_id AND p.page_index BETWEEN g.page_index - 2 AND g.page_index + 2 GROUP BY 1, 2),
turn AS (SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY k) AS k, c FROM near),
m AS (SELECT bundle_id, 0::BIGINT AS k, []::INTEGER[] AS used, 0::BIGINT AS matched FROM (SELECT DISTINCT bundle_id FROM turn)
  UNION ALL SELECT bundle_id, k, CASE WHEN len(f) > 0 THEN list_append(used, f[1]) ELSE used END, matched + CASE WHEN len(f) > 0 THEN 1 ELSE 0 END
  FROM (SELECT m.bundle_id, t.k, m.used, m.matched, list_filter(t.c, lambda x: NOT list_contains(m.used, x)) AS f FROM m JOIN turn t ON t.bundle_id = m.bundle_id AND t.k = m.k + 1)),
z AS (SELECT bundle_id, max(matched) AS matched FROM m GROUP BY 1), b AS (SELECT bundle_id, count(*) AS n_gold FROM g GROUP BY 1), c AS (SELECT bundle_id, count(*) AS n_pred FROM p GROUP BY 1),
r AS (SELECT bundle_id, coalesce(matched, 0)::BIGINT AS matched, coalesce(n_gold, 0)::BIGINT AS n_gold, coalesce(n_pred, 0)::BIGINT AS n_pred FROM b FULL JOIN c USING (bundle_id) LEFT JOIN z USING (bundle_id))
SELECT *, round(CASE WHEN matched > 0 THEN 2 * matched / (n_gold + n_pred)::DOUBLE ELSE 0 END, 6) AS f1, n_pred - matched AS false_splits FROM r""")
def tolerant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries within two pages."""
    rows = Q.signals(spark, sf_dir)
    out = evaluation.tolerant_scores(rows.where("gold_start and page_index > 0"), rows.where("confidence is not null").withColumn("page_index", F.col("page_index") + F.col("page_index") % 3), 2)
    return out.select("bundle_id", "matched", "n_gold", "n_pred", F.round("f1", 6).alias("f1"), "false_splits")


@query("""
WITH r AS (SELECT round(length(text) % 1000 / 1000.0::DOUBLE, 3) AS s, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)),
k AS (SELECT s AS t, sum(count(*) FILTER (NOT ok)) OVER (ORDER BY s) AS tp, sum(count(*) FILTER (ok)) OVER (ORDER BY s) AS fp FROM r GROUP BY s UNION ALL SELECT 0, 0, 0),
n AS (SELECT count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM r),
f AS (SELECT t, tp, tp + fp AS flagged, n, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + bad)::DOUBLE ELSE 0 END AS f1 FROM k, n)
SELECT CASE WHEN flagged > 0 THEN t + 1e-9 ELSE 0 END::DOUBLE AS threshold, flagged::BIGINT AS flagged, n, tp::BIGINT AS tp, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 12) DESC, flagged LIMIT 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").join(S.table(spark, sf_dir, "labels"), "doc_id").select(F.round(F.length("text") % 1000 / 1000, 3).alias("score"), (F.col("quality") == 1).alias("ok"))
    return evaluation.best_threshold(rows, "score", "ok").withColumn("f1", F.round("f1", 6))


@query("""
WITH r AS (SELECT (doc_id % 100) / 100.0::DOUBLE AS cer, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 13) / 13.0::DOUBLE END AS p FROM documents)
SELECT round(avg(cer) FILTER (p IS NOT NULL), 6) AS cer_all, round(avg(cer) FILTER (p >= 0.5), 6) AS cer_accepted, count(*) FILTER (p >= 0.5) AS accepted, count(p) AS scored, count(*) - count(p) AS unscored FROM r""")
def accepted_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.table(spark, sf_dir, "documents").select((F.col("doc_id") % 100 / 100).alias("cer"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 13 / 13).alias("probability"))
    out = evaluation.accepted_error(pages, 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("cer_all", "cer_accepted")})


_ANCHORS = ["the", "and", "ing", "of", "er", "in", "th"]


@query(f"""
WITH a AS (SELECT unnest(range(1, {len(_ANCHORS) + 1})) AS k, unnest({_ANCHORS}) AS w),
p AS (SELECT doc_id, k, instr(text, w) AS at FROM documents, a WHERE instr(text, w) > 0),
q AS (SELECT x.doc_id, count(*) AS pairs, count(*) FILTER (y.at > x.at) AS ordered FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.k > x.k GROUP BY 1),
h AS (SELECT doc_id, count(*) AS hits FROM p GROUP BY 1)
SELECT d.doc_id, coalesce(hits, 0)::INT AS hits, coalesce(pairs, 0)::INT AS pairs, coalesce(ordered, 0)::INT AS ordered FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN q USING (doc_id)""")
def anchor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", evaluation.anchor_order(F.coalesce("text", F.lit("")), _ANCHORS).alias("x"))
    return rows.select("doc_id", "x.hits", "x.pairs", "x.ordered")


@query(MARKS + """
SELECT bundle_id, CASE WHEN f1 < 1 THEN 'miss' WHEN bundle_id IN (SELECT bundle_id FROM scores WHERE f1 >= 1 ORDER BY bundle_id LIMIT 2) THEN 'saturated' ELSE 'train' END AS role FROM scores""")
def chosen_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chosen_bundles(Q._scores(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files of some documents: whole ones, of an older engine, of another page, and broken ones."""
    docs = S.table(spark, sf_dir, "documents").where("doc_id % 4 <> 0")
    sha = F.sha1(F.encode("text", "UTF-8"))
    record = F.format_string('{"schema": 1, "pdf_sha256": "%s", "page": %d, "raw": "x", "engine": "%s", "truncated": false}', sha, F.col("doc_id") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0), F.when(F.col("doc_id") % 5 == 0, "old").otherwise("new"))
    return docs.select(sha.alias("sha"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 7 == 0, F.substring(record, 1, 30)).otherwise(record).alias("record"))


@query("""
SELECT source, CASE WHEN doc_id % 4 = 0 THEN 'pending' WHEN doc_id % 7 = 0 OR doc_id % 9 = 0 THEN 'corrupt' WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'cached' END AS state, count(*) AS pages FROM documents GROUP BY 1, 2""")
def recognition_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = S.table(spark, sf_dir, "documents").select("source", F.sha1(F.encode("text", "UTF-8")).alias("sha"), F.col("doc_id").alias("page"))
    return recognition.with_state(plan, _records(spark, sf_dir), "new").groupBy("source", "state").agg(F.count("*").alias("pages"))


@query("""
SELECT doc_id AS page FROM documents WHERE doc_id % 4 = 0 OR doc_id % 7 = 0 OR doc_id % 9 = 0 OR doc_id % 5 = 0""")
def recognition_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = S.table(spark, sf_dir, "documents").select(F.sha1(F.encode("text", "UTF-8")).alias("sha"), F.col("doc_id").alias("page"))
    return recognition.work_plan(recognition.with_state(plan, _records(spark, sf_dir), "new")).select("page")


@query("""
SELECT coalesce(event_type, 'all') AS stop, count(*) AS pages, round(sum(value), 4) AS seconds, sum(event_id % 100)::BIGINT AS chars FROM events GROUP BY ROLLUP (event_type)""")
def recognition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = S.table(spark, sf_dir, "events").select(F.col("event_type").alias("stop"), F.col("value").alias("seconds"), (F.col("event_id") % 100).alias("chars"))
    return recognition.run_summary(runs).select(F.coalesce("stop", F.lit("all")).alias("stop"), "pages", F.round("seconds", 4).alias("seconds"), "chars")


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '!\[([a-z_]+\+?)\]\((\d+),(\d+),(\d+),(\d+)\)', ' ', 'g'), '</t[dh]>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(t, '&lt;?', '<', 'g'), '&#39;', chr(39)), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&nbsp;?', ' ', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS t FROM a),
c AS (SELECT page_id, list_transform(string_split(replace(replace(t, '**', ''), '|', ' '), chr(10)), lambda x: CASE WHEN regexp_full_match(regexp_replace(x, '^\s*#+\s*', ''), '[\s:-]*') THEN '' ELSE regexp_replace(x, '^\s*#+\s*', '') END) AS l FROM b)
SELECT page_id, md5(trim(regexp_replace(array_to_string(l, ' '), '\s+', ' ', 'g'))) AS text_md5 FROM c""")
def recognition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The html pages as readings: tags, cells, entities and marks out, one space between words."""
    return S.table(spark, sf_dir, "pages").select("page_id", F.md5(recognition.normal(recognition.plain_text(F.col("html")))).alias("text_md5"))


def _damaged(text: Column) -> Column:
    return F.replace(F.replace(F.substring(text, 11, 1 << 30), F.lit("the "), F.lit("")), F.lit("an"), F.lit("a n"))


@query()
def word_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text against a damaged copy of it; tested against a full table of edits."""
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("reference"), _damaged(F.col("text")).alias("read"))
    return recognition.word_error(rows).select("doc_id", F.round("wer", 6).alias("wer"))


@query(r"""
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(replace(p_name, 'e', 'e e'), ' ') AS b FROM part),
v AS (SELECT p_partkey, list_filter(a, lambda x: x <> '') AS a, list_filter(b, lambda x: x <> '') AS b FROM t),
w AS (SELECT p_partkey, a, b, list_distinct(a || b) AS d FROM v)
SELECT p_partkey, CASE WHEN len(a) > 0 THEN round(levenshtein(array_to_string(list_transform(a, lambda x: chr((10 + list_position(d, x))::INT)), ''), array_to_string(list_transform(b, lambda x: chr((10 + list_position(d, x))::INT)), '')) / len(a)::DOUBLE, 6) END AS wer FROM w""")
def word_error_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of part names, which are short enough for the statement's edits of characters."""
    rows = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("reference"), F.replace("p_name", F.lit("e"), F.lit("e e")).alias("read"))
    return recognition.word_error(rows).select("p_partkey", F.round("wer", 6).alias("wer"))


@query(r"""
WITH t AS (SELECT p_partkey, p_name, p_type, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 7 > 0 THEN replace(p_name, 'e', 'ee ') ELSE '' END END AS r, 'Part ' || p_partkey AS head, p_size::VARCHAR AS number FROM part),
v AS (SELECT *, coalesce(r, '') AS s, trim(regexp_replace(coalesce(r, '') || ' ' || CASE WHEN p_partkey % 3 > 0 THEN head ELSE '' END, '\s+', ' ', 'g')) AS page FROM t)
SELECT p_partkey, round(levenshtein(p_name, s) / length(p_name)::DOUBLE, 6) AS cer, (CASE WHEN p_partkey % 3 > 0 OR contains(page, head) THEN 1 ELSE 0 END + CASE WHEN contains(page, number) THEN 1 ELSE 0 END) / 2.0::DOUBLE AS furniture,
  round((CASE WHEN p_partkey % 2 > 0 THEN 1 ELSE 0 END + 1) / 2.0::DOUBLE, 6) AS cells, CASE WHEN contains(s, trim(regexp_replace(p_name, '\s+', ' ', 'g'))) THEN 1 ELSE 0 END::DOUBLE AS lines FROM v""")
def reading_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of part names, some missing or empty: characters, heads and numbers, cells, lines."""
    key = F.col("p_partkey")
    rows = S.table(spark, sf_dir, "part").withColumns({
        "read": F.when(key % 5 > 0, F.when(key % 7 > 0, F.replace("p_name", F.lit("e"), F.lit("ee "))).otherwise("")),
        "head": F.concat(F.lit("Part "), key.cast("string")),
        "raw": F.concat(F.lit("<table><tr><td>"), F.col("p_type"), F.lit("</td><td>"), F.when(key % 2 > 0, "a &amp; b").otherwise("a"), F.lit("</td></tr></table>")),
    })
    page = F.concat_ws(" ", F.coalesce("read", F.lit("")), F.when(key % 3 > 0, F.col("head")))
    furniture = recognition.furniture_recall(F.array("head", F.col("p_size").cast("string"), F.lit("")), page)
    cells = recognition.cell_recall(F.array("p_type", F.lit("a & b"), F.lit("")), F.col("raw"))
    out = recognition.reading_errors(rows.withColumns({"furniture": furniture, "cells": cells, "lines": recognition.line_recall(F.col("p_name"), F.col("read"))}), "p_name")
    return out.select("p_partkey", F.round("cer", 6).alias("cer"), "furniture", F.round("cells", 6).alias("cells"), F.col("lines").cast("double").alias("lines"))


@query("""
WITH t AS (SELECT p_partkey, p_size % 10 / 10.0::DOUBLE AS p0, p_size % 7 / 7.0::DOUBLE AS p1 FROM part)
SELECT p_partkey, ((CASE WHEN p0 >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN p1 >= 0.5 OR p_partkey % 3 = 0 THEN 1 ELSE 0 END) + 1)::INT AS kept, (p_partkey % 900 + 1)::INT AS x1, 'Name ' || p_partkey AS first_text FROM part JOIN t USING (p_partkey)""")
def region_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a tagged reading without those below a probability; the last has none and stays."""
    raw = F.format_string("![title](0,0,%d,20)\nName %d\n![text+](1,20,900,50) %s\nmore\n\n![footer](0,950,900,999) foot", F.col("p_partkey") % 900 + 1, F.col("p_partkey"), "p_name")
    found = recognition.regions(raw)
    probabilities = F.array(F.col("p_size") % 10 / 10, F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") % 7 / 7))
    rows = S.table(spark, sf_dir, "part").select("p_partkey", found.alias("r"), F.size(recognition.kept_regions(found, probabilities, 0.5)).alias("kept"))
    return rows.select("p_partkey", "kept", F.col("r")[0]["x1"].alias("x1"), F.col("r")[0]["text"].alias("first_text"))


@query("""
SELECT o_orderkey::VARCHAR AS bundle_id, (p - 1)::INT AS page_index, 'Page ' || p || ' of ' || (o_custkey % 5 + 1) AS text FROM (SELECT o_orderkey, o_custkey, unnest(range(1, o_custkey % 5 + 2)) AS p FROM orders)""")
def placeholder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.placeholder_pages(S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("bundle_id"), (F.col("o_custkey") % 5 + 1).cast("int").alias("pages")))


@query(SIGNALS + "SELECT bundle_id, page_index, coalesce(confidence BETWEEN 0.45 AND 0.6, false) AS asked FROM sig")
def confirm_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.signals(spark, sf_dir).select("bundle_id", "page_index", decision.in_band(F.col("confidence"), 0.45, 0.6).alias("asked"))


@query("""
SELECT page_class, CASE WHEN page_class = 'scan' AND doc_id % 3 = 0 THEN '' ELSE 'read ' || doc_id END AS reply, CASE WHEN page_class = 'scan' THEN 'scans' ELSE 'general' END AS engine, NULL::VARCHAR AS error, doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'scan' ELSE 'mixed' END AS page_class FROM documents)""")
def engine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans go to their engine, whose empty replies are final; the broken engine passes the others on."""

    def broken(texts: list[str]) -> list[str]:
        raise RuntimeError("out of order")

    scans = lambda texts: ["" if int(t) % 3 == 0 else f"read {t}" for t in texts]
    general = lambda texts: [f"read {t}" for t in texts]
    engines = [("broken", frozenset({"mixed", "scan"}), broken), ("scans", frozenset({"scan"}), scans), ("general", frozenset({"mixed"}), general)]
    pages = S.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "scan").otherwise("mixed").alias("page_class"), F.col("doc_id").cast("string").alias("raw"))
    return decision.with_fallback(pages, engines).drop("raw")


@query("""
WITH p AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS i FROM documents),
g AS (SELECT source, 'd' || (i // 4) AS item FROM p WHERE i % 4 <> 3), q AS (SELECT source, 'd' || (i // 5) AS item FROM p)
SELECT source, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(a) AS n_gold, count(b) AS n_pred FROM (SELECT coalesce(x.source, y.source) AS source, x.item AS a, y.item AS b FROM (SELECT DISTINCT * FROM g) x FULL JOIN (SELECT DISTINCT * FROM q) y ON x.source = y.source AND x.item = y.item) GROUP BY 1""")
def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = S.table(spark, sf_dir, "documents").select("source", i.alias("i"))
    item = lambda k: F.format_string("d%d", F.floor(F.col("i") / k))
    out = evaluation.set_scores(rows.where("i % 4 <> 3").select("source", item(4).alias("item")), rows.select("source", item(5).alias("item")), "source", "item")
    return out.select("source", "matched", "n_gold", "n_pred")
