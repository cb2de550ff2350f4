"""The registered page-stream queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators import assemble, boundary, decision, furniture, layout, lookahead, metrics, model
from pagestream.plans import pipeline, report
from pagestream.sources import adapters as S

Query = Callable[[SparkSession, str], DataFrame]


def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.page_class(F.col("text")).alias("c")).select("doc_id", "c.page_class", "c.confidence", "c.has_text_ops")


def text_layer_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    n = T.stripped_length(F.col("text"))
    out = docs.rollup("source").agg(F.count("*").alias("pages"), F.count_if(n >= T.MIN_CHARS).alias("text_pages"), F.sum(n).cast("long").alias("chars"))
    return out.select(F.coalesce("source", F.lit("total")).alias("source"), "pages", "text_pages", "chars")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the documents, one a line: single line ends become blank lines first."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return docs.select("doc_id", F.posexplode(T.split_blocks(F.col("text"))).alias("reading_order", "text"))


def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("doc_id", "reading_order", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = T.block_kind(F.col("text"), F.col("reading_order") == 0)
    return _blocks(spark, sf_dir).select("doc_id", "reading_order", kind.alias("k")).select("doc_id", "reading_order", "k.kind", "k.heading_level")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels in many forms, made from line items."""
    n, m = F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_suppkey") % 9
    form = F.col("l_partkey") % 8
    label = (
        F.when(form == 0, F.format_string("Page %d of %d", n, m))
        .when(form == 1, F.format_string("%d/%d", n, m))
        .when(form == 2, F.format_string("p. %d of %d", n, m))
        .when(form == 3, F.format_string("- %d -", n))
        .when(form == 4, F.format_string("  page %d  ", n))
        .when(form == 5, F.format_string("\n%d of %d\nmore", n, m))
        .when(form == 6, F.format_string("ratio %d/%d in text", n, m))
        .otherwise(F.format_string("Total due PAGE %d / %d", n, m))
    )
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", label.alias("label"))


def page_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("label")
    rows = _labels(spark, sf_dir).select("label", T.page_fraction(c).alias("f"), T.keyword_fraction(c).alias("k"), T.bare_number(c).alias("bare"), c.rlike(T.LABELLED_NUMBER).alias("labelled"), T.trailing_label(c).alias("t"))
    return rows.groupBy("label", F.col("f.num").alias("num"), F.col("f.total").alias("total"), F.col("k.num").alias("keyword_num"), "bare", "labelled", F.col("t.body").alias("trailing_body"), F.col("t.label").alias("trailing_label")).agg(F.count("*").alias("n"))


def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", T.content_words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.array_min("w").alias("first_word"))


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("lang", T.detect_language(F.col("text")).alias("guess"))
    return docs.groupBy("lang", "guess").agg(F.count("*").alias("n"))


def topic_similarity_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boundary.adjacent_similarity(S.document_pages(spark, sf_dir), S.document_tasks(spark, sf_dir))
    return rows.where("page_index > 0").select("bundle_id", "page_index", F.round("similarity", 6).alias("similarity"))


def language_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boundary.with_previous(S.document_pages(spark, sf_dir).withColumn("guess", T.detect_language(F.col("text"))), ("guess",))
    return rows.where("page_index > 0").select("bundle_id", "page_index", (~T.same_language(F.col("prev_guess"), F.col("guess"))).alias("changed"))


def topic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.topic_signals(S.document_pages(spark, sf_dir), S.document_tasks(spark, sf_dir)).select("bundle_id", "page_index", "topic_shift", "language_changed")


def page_number_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.number_signals(S.order_pages(spark, sf_dir)).select("bundle_id", "page_index", "page_number_reset", "sequence_completed")


def media_box_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as line items give them: quantities for widths, so that jumps of more than 20 and unknown sizes occur."""
    pages = S.order_pages(spark, sf_dir).withColumns({"width": F.when(F.col("page_num").isNotNull(), 600.0 + (F.col("page_index") * 7) % 45), "rotation": F.when(F.col("page_index") % 17 == 0, 90).otherwise(0)})
    return boundary.number_signals(pages).select("bundle_id", "page_index", "media_box_changed")


def embed_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boundary.with_previous(S.embedding_pages(spark, sf_dir), ("embedding",), 2)
    cosine = boundary.embedding_cosine(F.col("embedding"), F.col("prev_embedding"), F.col("prev2_embedding"))
    return rows.select("bundle_id", "page_index", cosine.alias("c")).select("bundle_id", "page_index", F.round("c", 6).alias("cosine"), F.coalesce(F.col("c") <= boundary.EMBED_SHIFT_MAX, F.lit(False)).alias("embed_shift"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.combine(boundary.number_signals(S.order_pages(spark, sf_dir)))


def boundary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("bundle_id", "page_index", F.round("confidence", 6).alias("confidence"), "reason")


def eager_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookahead.eager(signals(spark, sf_dir)).select("bundle_id", "page_index", "split", "reason", F.round("confidence", 6).alias("confidence"))


def _decided(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return lookahead.decide(signals(spark, sf_dir), keep=keep)


def lookahead_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("bundle_id", "page_index", "split", "reason")


def _indexed(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every page of these streams is one block."""
    decided = S.deal_bundles(spark, sf_dir, _decided(spark, sf_dir, keep))
    return boundary.document_index(decided.withColumn("n_blocks", F.lit(1)), always_filled=True)


def document_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.document_ranges(_indexed(spark, sf_dir))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the starts of gold and of predicted documents; a bundle's first page is neither."""
    rows = _indexed(spark, sf_dir, ("gold_start",))
    return rows.select("bundle_id", "page_index", (F.col("gold_start") & (F.col("page_index") > 0)).alias("gold"), F.col("effective").alias("predicted"))


def boundary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("gold") & F.col("predicted"), "tp").when(F.col("gold"), "fn").when(F.col("predicted"), "fp")
    return _both(spark, sf_dir).select("bundle_id", (F.col("page_index") - 1).alias("page_index"), mark.alias("mark")).where("mark is not null")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.flagged_scores(_both(spark, sf_dir), "gold", "predicted")


def boundary_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("bundle_id", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.gate(_scores(spark, sf_dir), bundle_floor=0.0, macro_floor=0.6)
    return out.select("bundles", "failed", "passed", F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, openings, closings and the end, in order: seq counts within the bundle.

    A page's events are counted before they are listed, so that pages are sorted and not their events.
    """
    w = Window.partitionBy("bundle_id").orderBy("page_index")
    rows = _indexed(spark, sf_dir).withColumn("last", F.lead("page_index").over(w).isNull())
    event = lambda when, kind, payload: F.when(when, F.struct(F.lit(kind).alias("kind"), payload.alias("payload")))
    opens, document = F.col("effective") | (F.col("page_index") == 0), lambda d: F.format_string("doc-%d", d)
    number = 1 + F.col("effective").cast("int") + opens.cast("int") + 2 * F.col("last").cast("int")
    counted = rows.withColumn("before", F.coalesce(F.sum(number).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    events = F.array_compact(F.array(
        event(F.lit(True), "boundary_decided", F.col("reason")),
        event(F.col("effective"), "document_closed", document(F.col("doc_index") - 1)),
        event(opens, "document_opened", document(F.col("doc_index"))),
        event(F.col("last"), "document_closed", document(F.col("doc_index"))),
        event(F.col("last"), "bundle_closed", F.lit("")),
    ))
    every = counted.select("bundle_id", "page_index", "before", F.posexplode(events).alias("at", "e"))
    return every.select("bundle_id", (F.col("before") + F.col("at")).alias("seq"), "e.kind", F.col("page_index").alias("page"), "e.payload")


def _conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = S.conversation_pages(spark, sf_dir)
    foot = F.when(F.col("total") % 2 == 0, F.format_string("Page %d of %d", F.col("page_index") + 1, "total")).otherwise(F.format_string("%d", F.col("page_index") + 1))
    head = F.concat(F.lit("Log of "), "role")
    return turns.select("bundle_id", "page_index", F.concat_ws("\n", head, F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("Kept by the office 2024"), foot).alias("text"))


def furniture_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.tags(_conversation_text(spark, sf_dir)).select("bundle_id", "page_index", "is_page_number", "is_footer", "is_header")


def furniture_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.tags(_conversation_text(spark, sf_dir), final=False).select("bundle_id", "page_index", "is_page_number", "is_footer", "is_header")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assemble.sections(S.html_blocks(spark, sf_dir))
    return out.select("bundle_id", "ord", "section_id", "level", "parent_ord", "page_start", "page_end", "n_blocks", F.md5("heading").alias("heading_md5"))


def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.titles(S.html_blocks(spark, sf_dir))


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks = S.html_blocks(spark, sf_dir).select("bundle_id", F.col("page_index").alias("doc_index"), "block_id", "reading_order")
    near = F.when(F.col("reading_order") % 5 == 0, F.concat("block_id", F.lit("x"))).when(F.col("reading_order") % 3 == 0, F.format_string("%s-p%d-b0", "bundle_id", F.col("doc_index") + 1)).otherwise(F.col("block_id"))
    return blocks.groupBy("bundle_id", "doc_index").agg(F.collect_list(near).alias("cited")), blocks


def unresolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, blocks = _cited(spark, sf_dir)
    return assemble.citations(docs, blocks).where("not resolved").groupBy("bundle_id", "doc_index", "block_id").agg(F.count("*").alias("n"))


def citation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.citation_integrity(*_cited(spark, sf_dir)).select("bundle_id", F.round("integrity", 6).alias("integrity"))


def review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body blocks that repeat a running foot of their host as a whole or as a line."""
    blocks = S.html_blocks(spark, sf_dir)
    feet = blocks.where("kind = 'footer'").select("bundle_id", T.edge_key(F.col("text")).alias("k")).distinct()
    lines = blocks.where("kind <> 'footer'").select("bundle_id", "kind", F.explode(F.split("text", "\n")).alias("line")).withColumn("k", T.edge_key(F.col("line")))
    return lines.join(feet, ["bundle_id", "k"], "left_semi").groupBy("bundle_id", "kind").agg(F.count("*").alias("n"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition records for some documents: current, stale and corrupt ones."""
    docs = S.table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    state = F.when(F.col("doc_id") % 7 == 0, "corrupt").when(F.col("doc_id") % 5 == 0, "stale").otherwise("cached")
    return docs.select(F.sha1(F.encode("text", "UTF-8")).alias("sha"), F.col("doc_id").alias("page"), state.alias("state"), F.length("text").alias("raw_chars"), (F.col("doc_id") % 11 == 0).alias("truncated"))


def ocr_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recognition would have to do, by source: a page is pending without a record."""
    docs = S.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.sha1(F.encode("text", "UTF-8")).alias("sha"))
    joined = docs.join(_cache(spark, sf_dir), ["sha", "page"], "left")
    used = F.col("state") == "cached"
    return joined.groupBy("source", F.coalesce("state", F.lit("pending")).alias("state")).agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.when(used, F.col("raw_chars"))), F.lit(0)).cast("long").alias("chars"), F.count_if(used & F.col("truncated")).alias("truncated"))


def false_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a text layer that recognition answered nevertheless."""
    docs = S.table(spark, sf_dir, "documents")
    pages = docs.where(T.stripped_length(F.col("text")) >= T.MIN_CHARS).select(F.col("doc_id").alias("page"))
    return _cache(spark, sf_dir).where("state = 'cached'").select("page").join(pages, "page", "left_semi").distinct()


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").join(S.table(spark, sf_dir, "labels"), "doc_id")
    out = metrics.auroc(rows.select(F.length("text").alias("score"), F.col("quality").alias("label")), "score", "label")
    return out.select("n_pos", "n_neg", F.round("auroc", 9).alias("auroc"))


def threshold_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").join(S.table(spark, sf_dir, "labels"), "doc_id")
    share = F.size(F.array_distinct(T.words_of(F.col("text")))) / F.greatest(F.size(T.words_of(F.col("text"))), F.lit(1))
    out = metrics.sweep(rows.select(share.alias("score"), F.col("quality").alias("label")), "score", "label", [k / 20 for k in range(1, 20)])
    return out.select("threshold", "n_pred", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ranks by counting: distinct values and their running counts."""
    rows = S.table(spark, sf_dir, "events").groupBy("event_type", F.round("value", 2).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    ranked = rows.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(q) * F.col("total")), F.lit(1)), F.col("v")))
    return ranked.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@5, MRR and recall@10: queries are every 20th vector against all vectors, in blocks; the gold is the label."""
    from pagestream.operators.retrieval import retrieval

    vectors = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("gold"))
    out = retrieval(vectors.where("id % 20 = 0"), vectors)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("ndcg5", "mrr", "recall10")))


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.encode("source", "UTF-8")), F.lit(5))
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(fold).alias("folds"))


def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand on both sides of a split by source: there have to be none for a clean evaluation."""
    docs = S.table(spark, sf_dir, "documents").select("source", F.md5("text").alias("text_md5"))
    held = F.col("source").isin("src1", "src3", "src5")
    return docs.where(held).select("text_md5").intersect(docs.where(~held).select("text_md5"))


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rates of part names read with a confusion of letters."""
    parts = S.table(spark, sf_dir, "part")
    read = F.translate("p_name", "aeo", "@3")
    return parts.select("p_partkey", F.round(F.levenshtein("p_name", read) / F.greatest(F.length("p_name"), F.lit(1)), 6).alias("cer"))


def range_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold ranges of each bundle have to tile its pages: gaps, overlaps and wrong ends are counted."""
    pages = S.order_pages(spark, sf_dir)
    ranges = pages.groupBy("bundle_id", "gold_id").agg(F.min("page_index").alias("start"), F.max("page_index").alias("end"))
    w = Window.partitionBy("bundle_id").orderBy("start")
    checked = ranges.withColumn("step", F.lead("start").over(w) - F.col("end"))
    return checked.groupBy("bundle_id").agg(F.count("*").alias("documents"), F.count_if(F.col("step") > 1).alias("gaps"), F.count_if(F.col("step") < 1).alias("overlaps"), F.min("start").alias("first_page"), F.max("end").alias("last_page"))


def neighbor_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.bundle_window()
    head = T.fold(F.col("text"), 40)
    rows = S.conversation_pages(spark, sf_dir).withColumn("head", head)
    return rows.select("bundle_id", "page_index", F.md5(F.concat_ws(" | ", F.lag("head").over(w), F.lead("head", 1).over(w), F.lead("head", 2).over(w))).alias("heads_md5"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned lines made from orders: an order is a bundle of one page, a line item a line."""
    rows = S.deal_bundles(spark, sf_dir, S.table(spark, sf_dir, "lineitem").withColumn("bundle_id", F.col("l_orderkey").cast("string")))
    w = Window.partitionBy("bundle_id").orderBy(*S.LINE_ORDER[1:])
    n = F.row_number().over(w) - 1
    size = F.when(F.col("l_partkey") % 11 == 0, 20.0).when(F.col("l_partkey") % 7 == 0, 12.5).when(F.col("l_partkey") % 13 == 0, 8.0).otherwise(11.0)
    text = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("Item "), F.col("l_partkey"), F.lit("."))).when(F.col("l_suppkey") % 9 == 0, F.concat(F.lit("Page "), F.col("l_linenumber"))).otherwise(F.concat(F.lit("Line "), F.col("l_partkey")))
    placed = rows.select("bundle_id", F.lit(0).alias("page_index"), F.lit(792.0).alias("height"), n.alias("pos"), text.alias("text"), (50.0 + F.col("l_suppkey") % 5).alias("x0"), size.alias("size"), (F.col("l_returnflag") == "A").alias("bold"))
    top = 30.0 + F.col("pos") * F.when(F.length("text") % 2 == 0, 14.0).otherwise(130.0)
    return placed.withColumn("top", top).withColumns({"bottom": F.col("top") + F.col("size"), "x1": F.col("x0") + F.length("text") * 5.0})


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.layout_blocks(_lines(spark, sf_dir))
    return out.select("bundle_id", "reading_order", "kind", "band", "heading_level", "small", F.md5("text").alias("text_md5"), F.round("x0", 3).alias("x0"), F.round("y0", 3).alias("y0"), F.round("x1", 3).alias("x1"), F.round("y1", 3).alias("y1"))


def grounding_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged recognition output made from conversations."""
    turns = S.conversation_pages(spark, sf_dir)
    n = F.col("page_index") + 1
    raw = F.when(F.length("text") % 3 == 0, F.concat_ws("\n\n", F.lit("# Head"), F.lit("- point"), F.lit("plain words"))).otherwise(F.concat(F.lit("lead in\n![title](900,20,-5,60)\n## Part "), n, F.lit("\n![text+](10,80,400,90) Body of the turn Page "), n, F.lit(" of "), F.col("total"), F.lit("\n![footer](0,950,1200,990) page "), n, F.lit("/"), F.col("total"), F.lit("\n![odd](1,2,3,4)\nend")))
    pages = turns.select("bundle_id", "page_index", raw.alias("raw"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    out = layout.grounding_blocks(pages)
    return out.select("bundle_id", "page_index", "reading_order", "kind", "heading_level", "text", *(F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


def ocr_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native or recognised blocks by page class, counted."""
    docs = S.table(spark, sf_dir, "documents").select(F.col("source").alias("bundle_id"), F.col("doc_id").alias("page_index"), "text")
    kind = F.when(F.col("page_index") % 4 == 0, "scan").when(F.col("page_index") % 4 == 1, "mixed").otherwise("text")
    pages = docs.select("bundle_id", "page_index", kind.alias("page_class"))
    native = docs.select("bundle_id", "page_index", F.lit("native").alias("origin"))
    seen = docs.where("page_index % 3 = 0").select("bundle_id", "page_index", F.lit("ocr").alias("origin"))
    routed = layout.route(pages, native, seen).join(pages, ["bundle_id", "page_index"])
    return routed.groupBy("bundle_id", "page_class", "origin").agg(F.count("*").alias("n"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.document_pages(spark, sf_dir)
    i = F.col("page_index")
    return pages.withColumns({"page_num": F.when(i % 3 > 0, i % 5 + 1), "page_total": F.when(i % 3 > 1, F.lit(5)), "title": F.when(i % 7 == 0, "top").when(i % 7 == 1, "lower"), "width": F.when(i % 11 == 0, 595.0).otherwise(640.0), "height": F.lit(792.0), "rotation": F.lit(0)})


def features16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.features(_facts(spark, sf_dir), S.document_tasks(spark, sf_dir)).select("bundle_id", "page_index", *(F.round(f, 6).alias(f) for f in model.FEATURES))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of labelled documents."""
    docs = S.table(spark, sf_dir, "documents").join(S.table(spark, sf_dir, "labels"), "doc_id")
    marks = F.length(F.regexp_replace("text", r"[^#*$%&|]", "")) / F.greatest(F.length("text"), F.lit(1))
    return docs.select("doc_id", F.log1p(F.length("text")).alias("log_chars"), marks.alias("marks"), F.col("quality").alias("y"))


def logistic_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = model.train(_labelled(spark, sf_dir), names=("log_chars", "marks"), epochs=300)
    return spark.createDataFrame([(n, round(m, 6), round(s, 6), round(c, 4), round(w.bias, 4)) for n, m, s, c in zip(w.feature_names, w.mean, w.std, w.weights, strict=True)], "feature string, mean double, std double, weight double, bias double")


def logistic_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = model.Weights([7.0, 0.01], [1.0, 0.02], [0.3, -1.7], 0.25, ("log_chars", "marks"))
    return _labelled(spark, sf_dir).select("doc_id", F.round(model.probability(w), 6).alias("probability"))


def loop_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose end compresses so well that generation must have looped."""
    docs = S.table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.repeat(F.substring("text", 1, 6), 400))).otherwise(F.col("text"))
    out = decision.loop_ratio(docs.select("doc_id", text.alias("text")))
    return out.select("doc_id", decision.loop_fired(F.col("loop_ratio")).alias("fired"))


def reply_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.format_string("%.2f", F.abs("value") % 2), F.col("event_id") % 5
    reply = F.when(k == 0, v).when(k == 1, F.concat(F.lit('{"probability": '), v, F.lit("}"))).when(k == 2, F.concat(F.lit("probability is "), v)).when(k == 3, F.lit("NaN")).otherwise(F.lit("no idea"))
    rows = S.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("bundle_id"), F.col("event_id").alias("page_index"), decision.reply_probability(reply).alias("probability"))
    return decision.strikes(rows).select("bundle_id", "page_index", F.round("probability", 6).alias("probability"), "strike", "exhausted")


def fewshot_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of made replies that name blocks of their own, other or no documents."""
    blocks = S.html_blocks(spark, sf_dir)
    docs = blocks.groupBy("bundle_id", F.col("page_index").alias("doc_index")).agg(F.array_sort(F.collect_list("block_id")).alias("known"))
    source = lambda *ids: F.struct(F.lit("v").alias("value"), F.array(*ids).alias("source_block_ids"))
    fields = F.create_map(F.lit("own"), source(F.col("known")[0]), F.lit("other"), source(F.col("known")[0], F.concat(F.col("known")[0], F.lit("x"))), F.lit("none"), F.struct(F.lit("v").alias("value"), F.array().cast("array<string>").alias("source_block_ids")))
    return decision.grounded_fields(docs.withColumn("fields", fields)).groupBy("bundle_id", "field", "drop").agg(F.count("*").alias("n"))


def student_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of each vector with the one before, and with the mean of the two before; 0 where there are none."""
    rows = boundary.with_previous(S.embedding_pages(spark, sf_dir), ("embedding",), 2)
    zero = F.lit(None).cast("array<float>")
    one = boundary.embedding_cosine(F.col("embedding"), F.col("prev_embedding"), zero)
    two = boundary.embedding_cosine(F.col("embedding"), F.col("prev_embedding"), F.col("prev2_embedding"))
    return rows.select("bundle_id", "page_index", F.round(F.coalesce(one, F.lit(0.0)), 6).alias("cos1"), F.round(F.coalesce(two, F.lit(0.0)), 6).alias("cos2"), (F.col("page_index") == 0).alias("first"))


def streaming_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-ahead decisions, from a stream in several batches."""
    from pagestream.shipping import shared_folder
    from pagestream.streaming.lookahead import replay

    out = replay(spark, signals(spark, sf_dir), shared_folder(spark, "replay"))
    return out.select("bundle_id", "page_index", "split", "reason")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagestream.streaming.lookahead import windowed_counts

    return windowed_counts(S.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagestream.streaming.lookahead import sessions

    return sessions(S.table(spark, sf_dir, "events"), "12 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.render(_decided(spark, sf_dir), boundary_marks(spark, sf_dir))
    return out.select("bundle_id", F.length("html").alias("chars"), F.size(F.split("html", "<tr class")).alias("rows"))


def bundle_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents joined into bundles of three by a seeded order, with their first pages by running sums."""
    docs = S.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 9 + 1).alias("pages"), F.md5(F.concat(F.lit("seed-7:"), F.col("o_orderkey"))).alias("k"))
    # The seeded order is made in parts of the key, so that no task sorts all documents.
    part = docs.withColumn("part", F.substring("k", 1, 2))
    w = Window.partitionBy("part").orderBy("k")
    grouped = part.withColumn("n", F.row_number().over(w) - 1).withColumn("bundle_id", F.concat_ws("-", "part", F.floor(F.col("n") / 3)))
    inside = Window.partitionBy("bundle_id").orderBy("n")
    start = F.sum("pages").over(inside) - F.col("pages")
    return grouped.select("bundle_id", "o_orderkey", start.alias("page_start"), (start + F.col("pages") - 1).alias("page_end"))


def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole parse over the conversations: documents with their ranges and titles."""
    out = pipeline.parse(_conversation_text(spark, sf_dir))
    return out.documents.select("bundle_id", "doc_index", "page_start", "page_end", F.md5("title").alias("title_md5"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        classify_pages, text_layer_census, block_split, block_kinds, page_label_parse, content_words, detect_language, topic_similarity_adjacent,
        language_changed, topic_shift, page_number_reset, media_box_jump, embed_shift, boundary_score, eager_split, lookahead_split,
        document_ranges, boundary_marks, boundary_prf, gate, event_log, furniture_final, furniture_streaming, sections, doc_titles,
        unresolved_citations, citation_integrity, review_checks, ocr_cache_join, false_ocr, auroc, threshold_tune,
        percentile_nearest_rank, retrieval_metrics, grouped_folds, split_disjoint, error_rates,
        range_validation, neighbor_heads, layout_blocks, grounding_parse, ocr_routing, features16, logistic_train, logistic_predict, loop_detect,
        reply_ladder, fewshot_grounding, student_features, streaming_parity, event_windows, event_sessions, review_report, bundle_plan, parse_documents,
    )
}
