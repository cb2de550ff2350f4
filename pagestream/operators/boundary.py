"""Boundary signals between neighbouring pages, as windows over ordered page streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.sources.adapters import bundle_window, size_jump

# --- fixed values: weights and levels of the signals, in the order they are added ---
WEIGHTS = {"page_number_reset": 0.45, "sequence_completed": 0.2, "header_changed": 0.25, "media_box_changed": 0.2, "title_top": 0.45, "title_block": 0.25, "topic_shift": 0.2, "language_changed": 0.25, "embed_shift": 0.15}
PROPOSE, COMBINED, CAP_WITHOUT_RESET, CAP = 0.4, 0.6, 0.74, 0.95
TOPIC_SHIFT_MAX, EMBED_SHIFT_MAX = 0.01, 0.5
# --- end of fixed values ---
#: Low bits of the page numbers of one part of a bundle.
PART_BITS = 8


def with_previous(pages: DataFrame, columns: Iterable[str], steps: int = 1) -> DataFrame:
    """Adds prev_<column> (and prev2_<column>), all over one sort."""
    w = bundle_window()
    made = {f"prev_{c}": F.lag(c, 1).over(w) for c in columns}
    if steps > 1:
        made |= {f"prev2_{c}": F.lag(c, 2).over(w) for c in columns}
    return pages.withColumns(made)


def page_number_reset() -> Column:
    return F.coalesce((F.col("page_num") == 1) & (F.col("prev_page_num") > 1), F.lit(False))


def sequence_completed() -> Column:
    return page_number_reset() & F.coalesce(F.col("prev_page_num") == F.col("prev_page_total"), F.lit(False))


def number_signals(pages: DataFrame) -> DataFrame:
    """Flags of the signals that page numbers and sizes give."""
    rows = with_previous(pages, ("page_num", "page_total", "width", "height", "rotation"))
    return rows.withColumns({"page_number_reset": page_number_reset(), "sequence_completed": sequence_completed(), "media_box_changed": size_jump() & (F.col("page_index") > 0)})


def topic_dots(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pages with n_words, norm (of their content-word counts) and dot1, dot2 (products with the page before and the one before that).

    Texts are dealt once, by parts of their bundles, into ``tasks``; a part's last two pages are dealt to the next one too,
    so that words meet their neighbours' per (bundle, part, word) without another exchange: no page's words are compared
    with another's one by one, and a bundle of any length is spread over its parts.  Sums over a page's occurrences of
    a word's counts are those over its words of products.
    """
    i, last = F.col("page_index"), (1 << PART_BITS) - 1
    part = F.shiftright(i, PART_BITS)
    parts = F.when(i.bitwiseAND(last) >= last - 1, F.array(part, part + 1)).otherwise(F.array(part))
    cut = pages.select("bundle_id", "page_index", "text", F.explode(parts).alias("part"))
    place = "bundle_id", "part"
    dealt = cut.repartition(tasks, *place) if tasks else cut.repartition(*place)
    # An outer explode, as a plain one would look for words below the exchange too, to drop pages without any.
    runs = dealt.select(*place, "page_index", F.explode_outer(T.content_runs(F.col("text"))).alias("run"))
    words = runs.select(*place, "page_index", F.lower("run").alias("word")).where(T.is_content(F.col("word")))
    # The hash comes first, for a quick sort.
    w = Window.partitionBy("hash", *place, "word").orderBy("page_index")
    upto = {f"n{k}": F.count("*").over(w.rangeBetween(Window.unboundedPreceding, -k)) for k in range(4)}
    near = words.withColumn("hash", F.xxhash64(*place, "word")).withColumns(upto)
    on = lambda k: F.sum(F.col(f"n{k}") - F.col(f"n{k + 1}"))
    sums = near.groupBy(*place, "page_index").agg(F.count("*").alias("n_words"), on(0).alias("norm"), on(1).alias("dot1"), on(2).alias("dot2"))
    own = sums.where(F.col("part") == part).drop("part")
    return pages.join(own, ["bundle_id", "page_index"], "left").na.fill(0, ["n_words", "norm", "dot1", "dot2"])


def adjacent_similarity(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """similarity: cosine of each page's content words with those of the page before; 0 if either has none."""
    rows = with_previous(topic_dots(pages, tasks), ("norm",))
    known = (F.col("norm") > 0) & (F.col("prev_norm") > 0)
    return rows.withColumn("similarity", F.when(known, F.col("dot1") / F.sqrt(F.col("norm").cast("double") * F.col("prev_norm"))).otherwise(0.0))


def topic_signals(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """Flags of vocabulary and language shifts, from pages with text.

    The two pages before count as one: its norm follows from theirs and their product.
    """
    rows = topic_dots(pages.withColumn("guess", T.detect_language(F.col("text"))), tasks)
    rows = with_previous(rows, ("n_words", "norm", "dot1", "guess"), 2)
    norm = F.col("prev_norm") + F.coalesce("prev2_norm", F.lit(0)) + 2 * F.when(F.col("page_index") > 1, F.col("prev_dot1")).otherwise(0)
    cosine = F.when((F.col("norm") > 0) & (norm > 0), (F.col("dot1") + F.col("dot2")) / F.sqrt(F.col("norm").cast("double") * norm)).otherwise(0.0)
    enough = (F.col("n_words") >= T.MIN_WORDS) & (F.col("prev_n_words") >= T.MIN_WORDS) & F.col("guess").isNotNull() & F.col("prev_guess").isNotNull()
    return rows.withColumns({
        "topic_shift": F.coalesce(enough & (cosine <= TOPIC_SHIFT_MAX), F.lit(False)),
        "language_changed": (F.col("page_index") > 0) & ~T.same_language(F.col("prev_guess"), F.col("guess")),
    })


def title_position(blocks: Column) -> Column:
    """top if the first body block of a page is its title, lower if a later one is; small lines of the top band are no body."""
    small_head = lambda x: F.coalesce((x["layout"]) & (x["band"] == "top") & x["small"], F.lit(False))
    body = F.filter(blocks, lambda x: ~x["kind"].isin("header", "footer", "page_number") & ~small_head(x))
    return F.when(F.try_element_at(body, F.lit(1))["kind"] == "title", "top").when(F.exists(body, lambda x: x["kind"] == "title"), "lower")


def head_facts(blocks: DataFrame) -> DataFrame:
    """By page: the head's fingerprint, whether it is tagged, its style (layout pages), whether the page has a layout, and the title's position.

    blocks(bundle_id, page_index, reading_order, kind, text[, layout, band, small, size, top]).
    """
    given = {"layout": "boolean", "band": "string", "small": "boolean", "size": "double", "top": "double"}
    blocks = blocks.select("bundle_id", "page_index", "reading_order", "kind", "text", *((F.col(c) if c in blocks.columns else F.lit(None)).cast(t).alias(c) for c, t in given.items()))
    listed = blocks.groupBy("bundle_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("reading_order", "kind", "text", *given))).alias("b"))
    b = F.col("b")
    lead = F.substring(F.split(F.lower(T.strip(b[0]["text"])), "\n")[0], 1, 80)
    tagged = F.exists(b, lambda x: (x["kind"] == "header") & (T.strip(x["text"]) != ""))
    is_head = lambda x: F.coalesce(x["layout"] & ((x["kind"] == "header") | ((x["band"] == "top") & x["small"])), F.lit(False))
    style = F.transform(F.filter(b, is_head), lambda x: F.struct(x["size"].alias("size"), F.bround(F.coalesce(x["top"], F.lit(0.0)) / 4).alias("at"), F.coalesce(x["small"], F.lit(False)).alias("small")))
    return listed.select("bundle_id", "page_index", F.coalesce(lead, F.lit("")).alias("head"), tagged.alias("head_tagged"), F.try_element_at(style, F.lit(1)).alias("head_style"), F.exists(b, lambda x: F.coalesce(x["layout"], F.lit(False))).alias("is_layout"), title_position(b).alias("title"))


def header_changed() -> Column:
    """A tagged running head stops or changes, unless its template stays, or a chapter opener only drops it.

    Needs head_facts with the page before's as prev_ columns, and sizes for ``size_jump``.
    """
    before, now = F.col("prev_head_style"), F.col("head_style")
    same = before.isNotNull() & before.eqNullSafe(now)
    dropped = before.isNotNull() & F.coalesce(before["small"], F.lit(False)) & now.isNull() & F.col("is_layout") & F.coalesce(F.col("title") == "top", F.lit(False)) & ~size_jump()
    changed = F.col("prev_head_tagged") & (F.col("head") != "") & (F.col("prev_head") != "") & (F.col("head") != F.col("prev_head"))
    return F.coalesce(changed, F.lit(False)) & ~same & ~dropped


def head_signals(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages(bundle_id, page_index, width, height, rotation) with header_changed, title_top and title_block."""
    facts = pages.join(head_facts(blocks), ["bundle_id", "page_index"], "left").na.fill({"head": "", "head_tagged": False, "is_layout": False})
    rows = with_previous(facts, ("head", "head_tagged", "head_style", "width", "height", "rotation"))
    later = F.col("page_index") > 0
    return rows.withColumns({"header_changed": header_changed() & later, "title_top": F.coalesce(F.col("title") == "top", F.lit(False)) & later, "title_block": F.coalesce(F.col("title") == "lower", F.lit(False)) & later}).drop(*(c for c in rows.columns if c.startswith("prev_")), "head", "head_tagged", "head_style", "is_layout", "title")


def embedding_cosine(current: Column, one: Column, two: Column) -> Column:
    """Cosine of a vector with the mean of the known ones of the two before it; null if none is known."""
    zero = lambda a: F.coalesce(a, F.transform(current, lambda _: F.lit(0.0).cast("float")))
    n = F.when(one.isNotNull(), 1).otherwise(0) + F.when(two.isNotNull(), 1).otherwise(0)
    mean = F.zip_with(zero(one), zero(two), lambda a, b: (a.cast("double") + b.cast("double")) / n)
    dot = F.aggregate(F.zip_with(current, mean, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    length = norm(mean) * norm(current)
    return F.when((n > 0) & (length > 0), dot / length)


def combine(flags: DataFrame) -> DataFrame:
    """confidence and reason from the flags among ``WEIGHTS`` that are columns; null on a bundle's first page and below the level to propose."""
    present = [r for r in WEIGHTS if r in flags.columns]
    on = {r: F.coalesce(F.col(r), F.lit(False)) for r in present}
    score = F.lit(0.0)
    for r in present:
        score = score + F.when(on[r], WEIGHTS[r]).otherwise(0.0)
    has = lambda r: on.get(r, F.lit(False))
    # One change of content is one vote: a language change stands for the topic's, both for the embedding's.
    both = has("topic_shift") & has("language_changed")
    score = score - F.when(both, WEIGHTS["topic_shift"]).otherwise(0.0)
    content = has("topic_shift") | has("language_changed") | has("embed_shift")
    votes = F.when(content, 1).otherwise(0)
    for r in ("page_number_reset", "header_changed", "media_box_changed", "title_top"):
        votes = votes + F.when(has(r), 1).otherwise(0)
    lifted = F.when(votes >= 2, F.greatest(score, F.lit(COMBINED))).otherwise(score)
    capped = F.when(has("page_number_reset"), lifted).otherwise(F.least(lifted, F.lit(CAP_WITHOUT_RESET)))
    fires = (F.col("page_index") > 0) & (lifted >= PROPOSE)
    reason = F.concat_ws("+", *(F.when(on[r], r) for r in present))
    return flags.withColumns({"confidence": F.when(fires, F.least(capped, F.lit(CAP))), "reason": F.when(fires, F.when(reason == "", "boundary").otherwise(reason))}).withColumn("signal", F.col("reason"))


def with_model(signals: DataFrame, probability: str) -> DataFrame:
    """Raises the confidence to a model's probability (at most 0.74; ignored below the level to propose); never lowers it."""
    p = F.when(F.col(probability) >= PROPOSE, F.least(F.col(probability), F.lit(CAP_WITHOUT_RESET)))
    raised = (F.col("page_index") > 0) & p.isNotNull() & (F.col("confidence").isNull() | (p > F.col("confidence")))
    return signals.withColumns({"confidence": F.when(raised, p).otherwise(F.col("confidence")), "reason": F.when(raised, F.concat_ws("+", "reason", F.lit("model"))).otherwise(F.col("reason"))}).withColumn("signal", F.col("reason"))


def document_index(decisions: DataFrame, blocks: str = "n_blocks", apply: bool = True, always_filled: bool = False) -> DataFrame:
    """doc_index of each page: a split takes effect if a block was seen since the split before it.

    ``apply=False``: one document.  ``always_filled``: all pages have blocks, so that every split but a first page's takes effect.
    """
    w = bundle_window()
    if apply and always_filled:
        marked = decisions.withColumn("effective", F.col("split") & (F.col("page_index") > 0))
        return marked.withColumn("doc_index", F.sum(F.when(F.col("effective"), 1).otherwise(0)).over(w).cast("int"))
    if not apply:
        return decisions.withColumns({"effective": F.lit(False), "doc_index": F.lit(0)})
    run = decisions.withColumn("_run", F.sum(F.when(F.col("split"), 1).otherwise(0)).over(w))
    filled = run.groupBy("bundle_id", "_run").agg(F.sum(blocks).alias("_blocks"))
    before = Window.partitionBy("bundle_id").orderBy("_run")
    prior = filled.withColumn("_prior", F.lag("_blocks").over(before)).select("bundle_id", "_run", "_prior")
    joined = run.join(prior, ["bundle_id", "_run"])
    effective = F.col("split") & (F.coalesce("_prior", F.lit(0)) > 0) & (F.col("page_index") > 0)
    marked = joined.withColumn("effective", effective)
    return marked.withColumn("doc_index", F.sum(F.when(F.col("effective"), 1).otherwise(0)).over(w).cast("int")).drop("_run", "_prior")


def document_ranges(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("bundle_id", "doc_index").agg(F.min("page_index").alias("page_start"), F.max("page_index").alias("page_end"))
