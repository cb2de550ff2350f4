"""Positioned lines to typed blocks, and recognition output to typed blocks, as windows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestream.functions import text as T

# --- fixed values: geometry ratios and label maps that results depend on ---
BAND, TITLE_RATIO, TITLE_ZONE, HEADING_RATIO, BOLD_RATIO, GAP = 0.08, 1.3, 0.45, 1.12, 0.95, 1.2
DEFAULT_WIDTH, DEFAULT_HEIGHT = 612.0, 792.0
GROUNDING_LABELS = {
    "text": "paragraph", "title": "heading", "list": "list_item", "header": "header", "footer": "footer", "page_number": "page_number", "footnote": "paragraph", "caption": "caption",
    "formula": "formula", "code": "code", "table": "table", "image": "figure", "chart": "figure", "header_image": "header", "footer_image": "footer", "aside_text": "paragraph",
}
REGION_LABELS = {
    "doc_title": "title", "paragraph_title": "heading", "text": "paragraph", "content": "paragraph", "abstract": "paragraph", "header": "header", "footer": "footer", "number": "page_number",
    "table": "table", "image": "figure", "chart": "figure", "figure_title": "caption", "chart_title": "caption", "table_title": "caption", "formula": "formula", "display_formula": "formula",
    "inline_formula": "formula", "seal": "stamp", "algorithm": "code", "footnote": "paragraph", "vision_footnote": "paragraph", "aside_text": "paragraph", "reference": "paragraph",
    "reference_content": "paragraph", "header_image": "header", "footer_image": "footer",
}
TAG = r"!\[([a-z_]+)(\+?)\]\((-?\d+),(-?\d+),(-?\d+),(-?\d+)\)[ \t]*\n?"
# --- end of fixed values ---


def labelled(label: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(known, label), F.lit("unknown"))


def layout_blocks(lines: DataFrame) -> DataFrame:
    """lines(bundle_id, page_index, height, pos, text, x0, top, x1, bottom, size, bold) to blocks.

    Bands come first and last; the biggest content lines in the upper part are
    the title, up to the first line that isn't; neighbouring paragraph lines
    join where the gap is small.
    """
    key = ["bundle_id", "page_index"]
    height = F.coalesce("height", F.lit(DEFAULT_HEIGHT))
    band = F.when(F.col("bottom") <= height * BAND, "top").when(F.col("top") >= height * (1 - BAND), "bottom")
    page, sized = Window.partitionBy(*key), Window.partitionBy(*key, "size")
    # The size of most characters, of equals the first: windows, so that lines are dealt by page once.
    weight = F.struct(F.sum(F.length("text")).over(sized).alias("chars"), (-F.min("pos").over(sized)).alias("first_seen"))
    rows = lines.where(F.col("bundle_id").isNotNull() & F.col("page_index").isNotNull()).withColumn("weight", weight)
    rows = rows.withColumns({"body": F.max_by("size", "weight").over(page), "band": band}).drop("weight")
    rows = rows.withColumn("biggest", F.max(F.when(F.col("band").isNull(), F.col("size"))).over(page))
    # Order: top band by position, content as it came, bottom band by position.
    part = F.when(F.col("band") == "top", 0).when(F.col("band").isNull(), 1).otherwise(2)
    rows = rows.withColumns({"part": part, "at": F.when(F.col("band").isNotNull(), F.col("top")).otherwise(0.0)})
    flow = page.orderBy("part", "at", "pos")
    upto = flow.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(flow))
    candidate = F.col("band").isNull() & (F.col("body") > 0) & (F.col("biggest") >= F.col("body") * TITLE_RATIO) & (F.col("size") == F.col("biggest")) & (F.col("top") <= height * TITLE_ZONE)
    rows = rows.withColumn("candidate", candidate)
    rows = rows.withColumn("first", F.min(F.when(F.col("candidate"), F.col("n"))).over(page))
    broken = F.sum(F.when((F.col("n") >= F.col("first")) & ~F.col("candidate"), 1).otherwise(0)).over(upto)
    rows = rows.withColumn("is_title", F.col("candidate") & (broken == 0))
    short = (F.length("text") <= 80) & ~F.col("text").rlike(r"(?U)[.,]\s*$")
    heading = short & (F.col("body") > 0) & ((F.col("size") >= F.col("body") * HEADING_RATIO) | (F.col("bold") & (F.col("size") >= F.col("body") * BOLD_RATIO)))
    kind = F.when(F.col("band").isNotNull(), F.when(F.col("text").rlike(T.BAND_LABEL), "page_number").otherwise("paragraph")).when(F.col("is_title"), "title").when(heading, "heading").otherwise("paragraph")
    rows = rows.withColumn("kind", kind)
    lag = lambda c: F.lag(c).over(flow)
    same = F.col("band").isNull() & lag("band").isNull() & lag("kind").isNotNull() & (lag("kind") == F.col("kind"))
    close = (F.col("top") - lag("bottom")) < F.greatest(F.col("size"), F.lit(1.0)) * GAP
    joins = F.coalesce(same & ((F.col("kind") == "title") | ((F.col("kind") == "paragraph") & close)), F.lit(False))
    rows = rows.withColumn("opens", ~joins).withColumn("reading_order", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(upto) - 1)
    by = lambda f, c: f(c, "n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    out = rows.groupBy(*key, "reading_order").agg(text.alias("text"), F.min("x0").alias("x0"), by(F.min_by, "top").alias("y0"), F.max("x1").alias("x1"), by(F.max_by, "bottom").alias("y1"), F.first("kind").alias("kind"), F.first("band").alias("band"), by(F.min_by, "size").alias("size"), F.first("body").alias("body"))
    return out.withColumns({
        "block_id": F.format_string("%s-p%d-b%d", "bundle_id", "page_index", "reading_order"),
        "heading_level": F.when(F.col("kind") == "title", 0).when(F.col("kind") == "heading", 1),
        "small": (F.col("body") > 0) & (F.col("size") < F.col("body") * BOLD_RATIO),
        "confidence": F.lit(0.8),
    }).drop("body")


def markdown_blocks(raw: Column) -> Column:
    """Array of (kind, level, text) of paragraphs of marked-up text."""
    parts = F.filter(F.transform(F.split(raw, r"\n\s*\n"), T.strip), lambda p: p != "")

    def block(p: Column) -> Column:
        hashes = F.length(F.regexp_extract(p, r"^(#+)", 1))
        kind = F.when(hashes == 1, "title").when(hashes > 1, "heading").when(p.startswith("<table") | p.startswith("|"), "table").when(p.rlike(r"^([-*•]|\d+[.)])\s"), "list_item").otherwise("paragraph")
        return F.struct(kind.alias("kind"), F.when(hashes > 0, hashes).alias("level"), F.regexp_replace(p, r"^#+\s*", "").alias("text"))

    return F.transform(parts, block)


def grounding_blocks(pages: DataFrame) -> DataFrame:
    """pages(bundle_id, page_index, raw, width, height) of tagged recognition output to blocks with boxes in points.

    Without tags the output is read as marked-up text.  A title's marks give its
    level; a head or foot that is a page label as a whole is a page number; a
    trailing page label of a text block becomes a block of its own.
    """
    found = pages.withColumns({"tags": F.regexp_extract_all("raw", F.lit(f"({TAG})"), F.lit(1)), "bodies": F.split("raw", TAG)})
    tagged = found.where(F.size("tags") > 0).select("bundle_id", "page_index", "width", "height", F.posexplode(F.arrays_zip("tags", F.slice("bodies", F.lit(2), F.size("tags")).alias("bodies"))).alias("i", "z"), T.strip(F.col("bodies")[0]).alias("lead"))
    part = lambda k: F.regexp_extract("z.tags", TAG, k)
    box = lambda k: F.least(F.greatest(part(k).try_cast("int"), F.lit(0)), F.lit(1000))
    text, label = T.strip(F.col("z.bodies")), part(1)
    marks = F.length(F.regexp_extract(text, r"^(#+)", 1))
    level = F.when(label == "title", F.greatest(marks, F.lit(1)))
    clean = F.when(label == "title", F.regexp_replace(text, r"^#+\s*", "")).otherwise(text)
    kind = F.when(level == 1, "title").when(label.isin("header", "footer") & T.keyword_fraction(clean).isNotNull(), "page_number").otherwise(labelled(label, GROUNDING_LABELS))
    w, h = F.coalesce("width", F.lit(DEFAULT_WIDTH)), F.coalesce("height", F.lit(DEFAULT_HEIGHT))
    blocks = tagged.select("bundle_id", "page_index", F.lit(1).alias("part"), "i", kind.alias("kind"), level.alias("level"), clean.alias("text"), label.alias("label"), (F.least(box(3), box(5)) / 1000 * w).alias("x0"), (F.least(box(4), box(6)) / 1000 * h).alias("y0"), (F.greatest(box(3), box(5)) / 1000 * w).alias("x1"), (F.greatest(box(4), box(6)) / 1000 * h).alias("y1"))
    # Marked-up text: all of it without tags, or what comes before the first tag.
    loose = found.select("bundle_id", "page_index", F.posexplode(markdown_blocks(F.col("bodies")[0])).alias("i", "m")).select("bundle_id", "page_index", F.lit(0).alias("part"), "i", "m.kind", "m.level", "m.text", F.lit(None).cast("string").alias("label"), *(F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    every = blocks.unionByName(loose)
    # Trailing labels: the block as it is, or its body and the label behind it.
    may = F.col("kind").isin("paragraph", "title", "heading", "list_item", "unknown") & (F.col("label").isNull() | (F.col("label") == "text"))
    whole = may & T.keyword_fraction(F.col("text")).isNotNull()
    piece = lambda k, lv, t: F.struct(k.alias("kind"), lv.alias("level"), t.alias("text"))
    none = F.lit(None).cast("int")
    pieces = (
        F.when(whole, F.array(piece(F.lit("page_number"), none, F.col("text"))))
        .when(may & T.trailing_label(F.col("text")).isNotNull(), F.array(piece(F.col("kind"), F.col("level"), T.trailing_label(F.col("text"))["body"]), piece(F.lit("page_number"), none, T.trailing_label(F.col("text"))["label"])))
        .otherwise(F.array(piece(F.col("kind"), F.col("level"), F.col("text"))))
    )
    flat = every.select("bundle_id", "page_index", "part", "i", "label", "x0", "y0", "x1", "y1", F.posexplode(pieces).alias("k", "p"))
    order = Window.partitionBy("bundle_id", "page_index").orderBy("part", "i", "k")
    return flat.select("bundle_id", "page_index", (F.row_number().over(order) - 1).alias("reading_order"), "p.kind", F.col("p.level").alias("heading_level"), "p.text", "label", "x0", "y0", "x1", "y1")


def region_blocks(pages: DataFrame, dpi: float) -> DataFrame:
    """pages(bundle_id, page_index, regions array<struct<label, bbox array<double>, text>>) to blocks; boxes from pixels to points."""
    s = 72.0 / dpi
    rows = pages.select("bundle_id", "page_index", F.posexplode("regions").alias("reading_order", "r"))
    at = lambda k: F.try_element_at("r.bbox", F.lit(k + 1)) * s
    return rows.select("bundle_id", "page_index", "reading_order", labelled(F.coalesce("r.label", F.lit("")), REGION_LABELS).alias("kind"), T.strip(F.coalesce("r.text", F.lit(""))).alias("text"), at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"))


def route(pages: DataFrame, native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Blocks by page class: text and unknown pages native; scans and suspect pages recognised, even if that is empty; mixed pages recognised, native where that is empty."""
    key = ["bundle_id", "page_index"]
    kinds = pages.select(*key, "page_class")
    has = recognised.select(*key).distinct().withColumn("_seen", F.lit(True))
    use = kinds.join(has, key, "left").withColumn("_ocr", F.col("page_class").isin("scan", "suspect_encoding") | ((F.col("page_class") == "mixed") & F.col("_seen").isNotNull())).select(*key, "_ocr")
    one = native.join(use.where("not _ocr"), key, "left_semi")
    return one.unionByName(recognised.join(use.where("_ocr"), key, "left_semi"), allowMissingColumns=True)
