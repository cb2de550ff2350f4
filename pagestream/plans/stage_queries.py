"""Queries of the confirmer, page files, page-number support, cut tags and cross-validation, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagestream.operators import confirm, crossval, furniture, review
from pagestream.plans import queries as Q
from pagestream.plans.more_queries import registrar
from pagestream.plans.oracles import PAGES, TEXTS
from pagestream.shipping import shared_folder
from pagestream.sources import adapters as S
from pagestream.sources import page_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)

#: Six calls a bundle; beyond them pages are refused one by one.
CONFIRMER = confirm.Confirmer(confirm.ConfirmConfig(calls=confirm.CallConfig(max_calls=6, strict=False)), confirm.recorded, sleep=lambda s: None)

CONFIRMED = """
WITH p AS (
  SELECT (conv_id // 6)::VARCHAR AS bundle_id, conv_id, (row_number() OVER (PARTITION BY conv_id // 6 ORDER BY conv_id, turn, role, text) - 1)::INT AS page_index FROM conversations),
c AS (SELECT *, (conv_id * 31 + page_index * 17) % 60 + 30 AS c, (conv_id + 3 * page_index) % 5 AS kind FROM p),
o AS (SELECT *, c BETWEEN 40 AND 74 AND page_index > 0 AS asked FROM c),
q AS (SELECT *, sum(asked::INT) OVER w AS call FROM o WINDOW w AS (PARTITION BY bundle_id ORDER BY page_index)),
s AS (SELECT *, sum((asked AND call <= 6 AND kind IN (2, 4))::INT) OVER (PARTITION BY bundle_id ORDER BY page_index) AS strikes FROM q),
r AS (
  SELECT *, CASE WHEN NOT asked THEN NULL WHEN strikes - (call <= 6 AND kind IN (2, 4))::INT >= 3 THEN 'closed' WHEN call > 6 THEN 'over_budget'
    WHEN kind IN (0, 3) THEN 'split' WHEN kind = 1 THEN 'continue' WHEN strikes = 3 THEN 'exhausted' ELSE 'strike' END AS outcome FROM s)
SELECT bundle_id, page_index, CASE WHEN c >= 75 THEN true WHEN c < 40 THEN false WHEN outcome = 'split' THEN true WHEN outcome = 'continue' THEN false ELSE c >= 55 END AS split,
  CASE WHEN c >= 75 THEN 'high_confidence' WHEN c < 40 THEN 'no_signal' WHEN outcome = 'split' THEN 'confirmed_split' WHEN outcome = 'continue' THEN 'confirmed_continue' WHEN c >= 55 THEN 'fallback_eager' ELSE 'fallback_below' END AS reason,
  outcome, CASE WHEN outcome IS NULL OR outcome IN ('closed', 'over_budget') THEN 0 WHEN kind = 3 THEN 2 WHEN kind = 4 THEN 3 ELSE 1 END::INT AS attempts
FROM r"""


def _asked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six conversations a bundle, unnumbered, with what a model would have answered to each page."""
    turns = S.table(spark, sf_dir, "conversations").withColumn("b", F.expr("conv_id div 6"))
    order = Window.partitionBy("b").orderBy("conv_id", "turn", "role", "text")
    pages = turns.select(F.col("b").cast("string").alias("bundle_id"), (F.row_number().over(order) - 1).cast("int").alias("page_index"), "conv_id", "text")
    kind = (F.col("conv_id") + 3 * F.col("page_index")) % 5
    says = lambda content: F.struct(F.lit(200).alias("status"), F.to_json(F.struct(F.array(F.struct(F.struct(F.lit(content).alias("content")).alias("message"))).alias("choices"))).alias("body"))
    busy = F.struct(F.lit(503).alias("status"), F.lit("").alias("body"))
    replies = F.when(kind == 0, F.array(says("0.9"))).when(kind == 1, F.array(says('{"probability": 0.2, "label": "continue"}'))).when(kind == 2, F.array(says("no idea")))
    replies = replies.when(kind == 3, F.array(busy, says("The probability is 0.7."))).otherwise(F.array(busy, busy, busy))
    confidence = ((F.col("conv_id") * 31 + F.col("page_index") * 17) % 60 + 30) / F.lit(100.0)
    return pages.select("bundle_id", "page_index", confidence.alias("confidence"), F.lit(None).cast("int").alias("page_num"), F.lit(None).cast("int").alias("page_total"), F.col("text").alias("message"), replies.alias("replies"))


@query(CONFIRMED)
def confirmed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a recorded model confirms, strikes out on or may not be asked about, in one batch."""
    out = confirm.decide(_asked_pages(spark, sf_dir), CONFIRMER)
    return out.select("bundle_id", "page_index", "split", "reason", "outcome", "attempts")


@query(CONFIRMED)
def confirmed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from a stream that is stopped and resumed in the middle of every bundle."""
    from pagestream.streaming.confirm import replay

    out = replay(_asked_pages(spark, sf_dir), shared_folder(spark, "confirmed"), CONFIRMER, cuts=(9,))
    return out.select("bundle_id", "page_index", "split", "reason", "outcome", "attempts")


@query("WITH d AS (" + CONFIRMED + """)
SELECT bundle_id, count(*) FILTER (outcome IN ('split', 'continue', 'strike', 'exhausted')) AS calls, sum(attempts)::BIGINT AS attempts, count(*) FILTER (outcome IN ('strike', 'exhausted')) AS strikes,
  coalesce(string_agg(CASE WHEN outcome IN ('strike', 'exhausted', 'over_budget') THEN page_index::VARCHAR END, ',' ORDER BY page_index), '') AS degraded FROM d GROUP BY 1""")
def confirm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = confirm.usage(confirm.decide(_asked_pages(spark, sf_dir), CONFIRMER))
    return out.withColumn("degraded", F.array_join("degraded", ","))


@query(r"""
WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS bundle_id, page_id, html FROM pages)
SELECT bundle_id, (row_number() OVER (PARTITION BY bundle_id ORDER BY page_id) - 1)::INT AS page_index, md5(html) AS text_md5, octet_length(encode(html))::DOUBLE AS width FROM h""")
def page_source_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages as page files, one host a file, read back through the data source."""
    pages = S.table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("bundle_id"), "page_id", "html")
    order = Window.partitionBy("bundle_id").orderBy("page_id")
    made = pages.select("bundle_id", (F.row_number().over(order) - 1).cast("int").alias("page_index"), F.octet_length("html").cast("double").alias("width"), F.lit(0).alias("rotation"), F.col("html").alias("text"))
    where = shared_folder(spark, "pages")
    page_source.write_pages(made, where)
    back = page_source.read_pages(spark, where, columns="page_index,text,width")
    return back.select(F.regexp_extract("bundle_id", "^bundle=([^/]*)/", 1).alias("bundle_id"), "page_index", F.md5("text").alias("text_md5"), "width")


@query(PAGES + """
, d AS (SELECT *, (page_index // 9)::INT AS doc_index FROM pages),
s AS (SELECT bundle_id, doc_index, count(*) AS n, min(page_index) AS first, min_by(coalesce(page_num, -1), page_index) AS first_num FROM d GROUP BY 1, 2),
a AS (SELECT d.*, first FROM d JOIN s USING (bundle_id, doc_index) WHERE page_num IS NOT NULL OR page_index = first),
c AS (
  SELECT DISTINCT a.bundle_id, a.doc_index FROM a JOIN d q ON q.bundle_id = a.bundle_id AND q.doc_index = a.doc_index AND q.page_index > a.page_index AND q.page_num IS NOT NULL
  WHERE (a.page_total IS NULL OR (q.page_num <= a.page_total AND (q.page_total IS NULL OR q.page_total = a.page_total)))
    AND CASE WHEN a.page_num IS NULL THEN q.page_num BETWEEN 1 AND q.page_index - a.page_index + 1 ELSE q.page_num > a.page_num AND q.page_num <= a.page_num + q.page_index - a.page_index END)
SELECT s.bundle_id, s.doc_index, CASE WHEN n = 1 THEN first_num = 1 ELSE c.bundle_id IS NOT NULL END AS supported FROM s LEFT JOIN c USING (bundle_id, doc_index)""")
def number_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine line items a document, so that documents mix the counts of several orders."""
    pages = S.order_pages(spark, sf_dir).withColumn("doc_index", F.floor(F.col("page_index") / 9).cast("int"))
    return review.number_support(pages)


@query(TEXTS + """
, r AS (SELECT *, CASE WHEN (page_index // 3 + 1) * 3 <= total - 1 THEN least((page_index // 3 + 1) * 3 + 2, total - 1) ELSE total - 1 END AS read_to FROM l)
SELECT a.bundle_id, a.page_index, a.read_to::INT AS read_to,
  EXISTS (SELECT 1 FROM l b WHERE b.bundle_id = a.bundle_id AND b.page_index <> a.page_index AND b.page_index BETWEEN a.page_index - 3 AND least(a.page_index + 3, a.read_to)) AS is_footer,
  EXISTS (SELECT 1 FROM l b WHERE b.bundle_id = a.bundle_id AND b.page_index <> a.page_index AND b.page_index BETWEEN a.page_index - 3 AND least(a.page_index + 3, a.read_to) AND b.top = a.top) AS is_header
FROM r a""")
def furniture_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and feet of documents of three turns, with what was read when each closed: its next page takes look-ahead."""
    texts = Q._conversation_text(spark, sf_dir)
    opens = F.col("page_index") % 3 == 0
    decided = texts.select("bundle_id", "page_index", F.floor(F.col("page_index") / 3).cast("int").alias("doc_index"), F.when(opens, 0.6).otherwise(0.0).alias("confidence"), F.when(~opens, F.col("page_index") + 1).alias("page_num"), (opens & (F.col("page_index") > 0)).alias("effective"))
    bounds = furniture.read_bounds(decided, window=2)
    return furniture.tags(texts, bounds=bounds).join(bounds, ["bundle_id", "page_index"]).select("bundle_id", "page_index", "read_to", "is_footer", "is_header")


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels from two features of the text, in folds by source: out-of-fold scores and a model for each fold."""
    rows = Q._labelled(spark, sf_dir).join(S.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows = crossval.group_folds(rows, "source")
    fitted = crossval.cross_validate(rows, names=("log_chars", "marks"))
    area = crossval.out_of_fold(rows, fitted)
    models = [(k, n, *(round(x, 6) for x in (w.bias, *w.weights))) for k, (n, w) in enumerate(zip(fitted.rows, [*fitted.folds, fitted.whole], strict=True))]
    made = spark.createDataFrame(models, "fold int, train_rows long, bias double, log_chars double, marks double")
    return made.join(F.broadcast(area.select(F.round("auroc", 6).alias("auroc"), "threshold", F.round("f1", 6).alias("f1"))), F.lit(True))  # one row
