"""What a reader should look at again: uncertainty flags, review checks, and the event log of a parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators.assemble import FURNITURE


def weak_boundary() -> Column:
    """A split without evidence from page numbers."""
    reset = F.array_contains(F.split(F.coalesce("signal", F.lit("")), r"\+"), "page_number_reset")
    return F.col("split") & ((F.col("reason") == "fallback_eager") | ((F.col("reason") == "high_confidence") & ~reset))


#: Levels of the dyadic intervals that hold any number of 32 bits.
LEVELS = 32


def _levels(width: Column) -> Column:
    """The levels whose intervals may lie in a range of ``width`` numbers (1 or more); one more, as logarithms are rounded."""
    return F.sequence(F.lit(0), F.least(F.floor(F.log2(width)).cast("int") + 1, F.lit(LEVELS - 1)))


def _cover(low: Column, high: Column) -> Column:
    """[low, high] as the fewest dyadic intervals (level, node), two a level at most."""
    levels = _levels(high - low + 1)

    def nodes(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        first, last = F.ceil(low / size), F.floor((high + 1) / size) - 1
        left, right = F.when((first <= last) & (first % 2 != 0), first), F.when((first <= last) & (last % 2 == 0), last)
        return F.transform(F.array_distinct(F.array_compact(F.array(left, right))), lambda n: F.struct(k.alias("level"), n.cast("long").alias("node")))

    return F.flatten(F.transform(levels, nodes))


def number_support(pages: DataFrame) -> DataFrame:
    """bundle_id, doc_index, supported: some page's number carries on from an earlier page of the document.

    pages(bundle_id, doc_index, page_index, page_num, page_total).  Anchors are the numbered pages and the first one.
    A document of one page has to be page 1.

    A number carries on from an anchor if it is above the anchor's, and its lead over the page index isn't above the
    anchor's lead; both together imply that the anchor is the earlier page.  So no pages are paired: in the order of
    numbers, the largest lead so far is compared, among anchors without a total and among those of the same total.  A
    page without a total may carry on from anchors of any, as long as its number is within it: anchors' ranges of
    numbers are cut into dyadic intervals, which a number meets once a level that the document's ranges reach.
    """
    key = ["bundle_id", "doc_index"]
    shape = pages.groupBy(*key).agg(F.count("*").alias("n"), F.min("page_index").alias("first"), F.min_by("page_num", "page_index").alias("first_num"), F.min_by("page_total", "page_index").alias("first_total"))
    num, of = F.col("num"), F.col("of")
    rows = pages.where("page_num is not null").select(*key, "page_index", F.col("page_num").cast("long").alias("num"), F.col("page_total").cast("long").alias("of"))
    rows = rows.withColumn("lead", num - F.col("page_index"))
    below = lambda *by: Window.partitionBy(*by).orderBy("num").rangeBetween(Window.unboundedPreceding, -1)
    open_ = F.max(F.when(of.isNull(), F.col("lead"))).over(below(*key)) >= F.col("lead")
    same = of.isNotNull() & (num <= of) & (F.max("lead").over(below(*key, "of")) >= F.col("lead"))
    counted = rows.withColumn("hit", F.coalesce(open_, F.lit(False)) | F.coalesce(same, F.lit(False))).where("hit").select(*key)
    # An unnumbered first page may or may not have been counted.
    opening = rows.join(shape.where("first_num is null"), key).where((num >= 1) & (F.col("lead") <= 1 - F.col("first")) & (F.col("first_total").isNull() | ((num <= F.col("first_total")) & (of.isNull() | (of == F.col("first_total")))))).select(*key)
    total = rows.where(of.isNotNull() & (num < of))
    ranges = total.select(*key, "lead", F.explode(_cover(num + 1, of)).alias("d")).groupBy(*key, "d.level", "d.node").agg(F.max("lead").alias("most"))
    # Only levels that the document's widest range can have: none without a range.
    wide = total.groupBy(*key).agg(F.max(of - num).alias("wide"))
    loose = rows.where(of.isNull()).join(wide, key).select(*key, "lead", F.explode(F.transform(_levels(F.col("wide")), lambda k: F.struct(k.alias("level"), F.floor(num / F.pow(F.lit(2.0), k)).cast("long").alias("node")))).alias("d")).groupBy(*key, "d.level", "d.node").agg(F.min("lead").alias("least"))
    met = ranges.join(loose, [*key, "level", "node"]).where("least <= most").select(*key)
    carried = counted.unionByName(opening).unionByName(met).distinct().withColumn("carried", F.lit(True))
    one = F.coalesce(F.col("first_num") == 1, F.lit(False))
    return shape.join(carried, key, "left").select(*key, F.when(F.col("n") == 1, one).otherwise(F.coalesce("carried", F.lit(False))).alias("supported"))


def uncertainty_flags(pages: DataFrame) -> DataFrame:
    """Flags of closed documents from decided pages (split, reason, confidence, signal, effective, doc_index, page_num, page_total).

    weak_boundary: the split that opened a document has no page numbers behind it; fallback_decision: a proposed split
    was dropped below the fallback; eof_flush: a bundle's last document (of several) ended without page numbers.
    """
    opened = pages.where(F.col("effective") & weak_boundary()).select("bundle_id", "doc_index", F.lit(0).alias("rank"), F.lit("weak_boundary").alias("flag"), F.col("page_index").alias("page"))
    dropped = pages.where("reason = 'fallback_below' and signal is not null").select("bundle_id", "doc_index", F.lit(1).alias("rank"), F.lit("fallback_decision").alias("flag"), F.col("page_index").alias("page"))
    last = pages.groupBy("bundle_id").agg(F.max("doc_index").alias("doc_index")).where("doc_index > 0")
    ends = pages.join(last, ["bundle_id", "doc_index"], "left_semi")
    first = ends.groupBy("bundle_id", "doc_index").agg(F.min("page_index").alias("page"))
    flushed = number_support(ends).where("not supported").join(first, ["bundle_id", "doc_index"]).select("bundle_id", "doc_index", F.lit(2).alias("rank"), F.lit("eof_flush").alias("flag"), "page")
    return opened.unionByName(dropped).unionByName(flushed)


def review_checks(documents: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """document_id, check, ref, detail.

    documents(document_id, page_start, page_end, title), sections(document_id, section_id, page_start, page_end),
    blocks(document_id, block_id, kind, text).
    """
    spans = documents.select("document_id", F.col("page_start").alias("from"), F.col("page_end").alias("to"))
    outside = sections.join(spans, "document_id").where((F.col("page_start") < F.col("from")) | (F.col("page_end") > F.col("to")))
    found = outside.select("document_id", F.lit("section_outside_document").alias("check"), F.col("section_id").alias("ref"), F.format_string("%d-%d", "page_start", "page_end").alias("detail"))
    furniture = blocks.where(F.col("kind").isin(*FURNITURE)).select("document_id", T.one_space(F.col("text")).alias("line")).where("line <> ''").distinct()
    body = blocks.where(~F.col("kind").isin("title", *FURNITURE))
    # The whole text, then its lines in order: the first that equals a furniture line is told.
    lines = F.concat(F.array(F.col("text")), F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"))
    each = body.select("document_id", "block_id", F.posexplode(F.transform(lines, T.one_space)).alias("at", "line"))
    hits = each.join(furniture, ["document_id", "line"]).groupBy("document_id", "block_id").agg(F.min_by("line", "at").alias("detail"))
    in_body = hits.select("document_id", F.lit("furniture_in_body").alias("check"), F.col("block_id").alias("ref"), "detail")
    titled = documents.select("document_id", F.lit(None).cast("string").alias("ref"), T.one_space(F.col("title")).alias("line")).unionByName(blocks.where("kind = 'title'").select("document_id", F.col("block_id").alias("ref"), T.one_space(F.col("text")).alias("line")))
    titles = titled.join(furniture, ["document_id", "line"]).select("document_id", F.lit("title_equals_furniture").alias("check"), "ref", F.col("line").alias("detail"))
    return found.unionByName(in_body).unionByName(titles)


def page_events(pages: DataFrame, window: int = 2) -> DataFrame:
    """bundle_id, seq, kind, page, payload: all events of a parse in the order a stream gives them, from one row a page.

    pages(bundle_id, page_index, page_class, block_ids array<string>, signal, reason, effective, doc_index).  A page is
    classified, its blocks come, a boundary may be proposed before it; its decision follows ``window`` pages later, or
    at the end, and closes and opens documents.

    Events are counted before they are listed: a page is read after all earlier pages and the decisions that were due
    before it, and decided after all pages up to ``window`` later and all earlier decisions.  So pages are sorted, events aren't.
    """
    order = Window.partitionBy("bundle_id").orderBy("page_index")
    opens = F.col("effective") | (F.col("page_index") == 0)
    read = 1 + F.coalesce(F.size("block_ids"), F.lit(0)) + F.col("signal").isNotNull().cast("int")
    rows = pages.withColumns({"_read": read.cast("long"), "_made": 1 + F.col("effective").cast("long") + opens.cast("long")})
    upto = lambda c, k: F.coalesce(F.sum(c).over(order.rangeBetween(Window.unboundedPreceding, k)), F.lit(0))
    last = F.lead("page_index").over(order).isNull()
    rows = rows.withColumns({"_at": upto("_read", -1) + upto("_made", -window - 1), "_decided_at": upto("_read", window) + upto("_made", -1), "_last": last})
    document = lambda d: F.concat("bundle_id", F.lit("-doc-"), d.cast("string"))
    closes = F.col("effective").cast("long")
    # Kinds of events with where they begin and their payloads, none or null where there are none; no lambdas, which Spark would interpret.
    kinds = [
        ("page_classified", F.col("_at"), F.array("page_class")),
        ("block_emitted", F.col("_at") + 1, F.col("block_ids")),
        ("boundary_proposed", F.col("_at") + F.col("_read") - 1, F.when(F.col("signal").isNotNull(), F.array("signal"))),
        ("boundary_decided", F.col("_decided_at"), F.array("reason")),
        ("document_closed", F.col("_decided_at") + 1, F.when(F.col("effective"), F.array(document(F.col("doc_index") - 1)))),
        ("document_opened", F.col("_decided_at") + 1 + closes, F.when(opens, F.array(document(F.col("doc_index"))))),
        ("document_closed", F.col("_decided_at") + F.col("_made"), F.when(F.col("_last"), F.array(document(F.col("doc_index"))))),
        ("bundle_closed", F.col("_decided_at") + F.col("_made") + 1, F.when(F.col("_last"), F.array("bundle_id"))),
    ]
    listed = rows.select("bundle_id", "page_index", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), first.alias("first"), payloads.alias("payloads")) for kind, first, payloads in kinds))).alias("e"))
    every = listed.select("bundle_id", "page_index", "e.kind", "e.first", F.posexplode("e.payloads").alias("at", "payload"))
    return every.select("bundle_id", (F.col("first") + F.col("at")).cast("int").alias("seq"), "kind", F.col("page_index").alias("page"), "payload")


def event_log(classes: DataFrame, blocks: DataFrame, signals: DataFrame, indexed: DataFrame, window: int = 2) -> DataFrame:
    """``page_events`` of a parse's tables: classes(page_class), blocks(reading_order, block_id), signals(confidence, reason) and indexed pages."""
    key = ["bundle_id", "page_index"]
    listed = blocks.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "block_id"))), lambda b: b["block_id"]).alias("block_ids"))
    proposed = signals.select(*key, F.when(F.col("confidence").isNotNull(), F.col("reason")).alias("signal"))
    pages = indexed.select(*key, "reason", "effective", "doc_index").join(classes.select(*key, "page_class"), key).join(listed, key, "left").join(proposed, key, "left")
    return page_events(pages, window)
