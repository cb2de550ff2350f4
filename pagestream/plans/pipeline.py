"""The whole parse of a page stream: classify, split into blocks, tag, score, decide, assemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators import assemble, boundary, confirm, furniture, lookahead, metrics, review
from pagestream.operators.model import Weights, features, probability


@dataclass(frozen=True)
class PipelineConfig:
    """``split_on_boundary=False`` makes and reports decisions, but applies none; ``confirmer`` is asked about what look-ahead leaves open."""

    split_on_boundary: bool = True
    min_boundary_confidence: float = 0.55
    commit_confidence: float = 0.75
    window: int = 2
    weights: Weights | None = None
    confirmer: confirm.Confirmer | None = None

    def __post_init__(self):
        if not 0 <= self.min_boundary_confidence <= 1 or not 0 <= self.commit_confidence <= 1 or self.window < 0:
            raise ValueError("confidences have to be in 0..1 and the window not negative")


@dataclass(frozen=True)
class Result:
    pages: DataFrame
    blocks: DataFrame
    decisions: DataFrame
    documents: DataFrame
    sections: DataFrame
    flags: DataFrame
    events: DataFrame
    held: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Release what the parse keeps persisted: signals and decisions."""
        for df in self.held:
            df.unpersist()


def raw_blocks(pages: DataFrame) -> DataFrame:
    """Typed blocks of plain text pages, before anything is known of running heads and feet."""
    kinds = T.block_kind(F.col("text"), (F.col("page_index") == 0) & (F.col("reading_order") == 0))
    split = pages.select("bundle_id", "page_index", F.posexplode(T.split_blocks(F.col("text"))).alias("reading_order", "text"))
    return split.withColumn("k", kinds).select("bundle_id", "page_index", "reading_order", F.format_string("%s-p%d-b%d", "bundle_id", "page_index", "reading_order").alias("block_id"), "k.kind", "k.heading_level", "text")


def page_blocks(pages: DataFrame, final: bool = True, bounds: DataFrame | None = None) -> DataFrame:
    """Typed blocks; edge lines that repeat or number pages are cut out and tagged. ``final``: seen from both sides, up to ``bounds``."""
    return furniture.tag_blocks(raw_blocks(pages), pages, final, bounds)


def page_facts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages with n_blocks, page_num, page_total, title and body_text (all blocks but heads, feet and page numbers)."""
    listed = blocks.groupBy("bundle_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("reading_order", "kind", "text"))).alias("b"))
    body = F.filter("b", lambda x: ~x["kind"].isin(*assemble.FURNITURE))
    title = F.when(F.try_element_at(body, F.lit(1))["kind"] == "title", "top").when(F.exists(body, lambda x: x["kind"] == "title"), "lower")
    number = T.page_number(F.col("b"))
    facts = listed.select("bundle_id", "page_index", F.size("b").alias("n_blocks"), number["num"].alias("page_num"), number["total"].alias("page_total"), title.alias("title"), F.array_join(F.transform(body, lambda x: x["text"]), " ").alias("body_text"))
    return pages.join(facts, ["bundle_id", "page_index"], "left").na.fill(0, ["n_blocks"])


def parse(pages: DataFrame, config: PipelineConfig = PipelineConfig()) -> Result:
    """pages(bundle_id, page_index, text[, width, height, rotation, message, replies]) to blocks, decisions, documents, sections, flags and events.

    Signals see a page's edges as a reader who comes from the front; blocks are tagged from both
    sides, with what was read when their document closed.  A confirmer is
    sent a page's ``message``, or its text where there is none; decisions then have ``outcome`` and ``attempts``.
    """
    for name, value in (("width", F.lit(None).cast("double")), ("height", F.lit(None).cast("double")), ("rotation", F.lit(0))):
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    seen = page_blocks(pages, final=False)
    facts = page_facts(pages, seen)
    size = ("width", "height", "rotation")
    number = boundary.number_signals(facts.select("bundle_id", "page_index", "page_num", "page_total", "n_blocks", *size)).select("bundle_id", "page_index", "page_num", "page_total", "n_blocks", "page_number_reset", "sequence_completed", "media_box_changed")
    heads = boundary.head_signals(pages.select("bundle_id", "page_index", *size), seen).select("bundle_id", "page_index", "header_changed", "title_top", "title_block")
    topics = boundary.topic_signals(facts.select("bundle_id", "page_index", F.coalesce("body_text", F.lit("")).alias("text"))).select("bundle_id", "page_index", "topic_shift", "language_changed")
    key = ["bundle_id", "page_index"]
    # The exchange by bundle, which the windows of the decisions need too, keeps Catalyst from copying each flag's whole expression into the score.
    flags = number.join(heads, key).join(topics, key).repartition("bundle_id")
    signals = boundary.combine(flags).persist()  # read by decisions and events; so are the decisions by all that follows
    if config.weights is not None:
        scored = features(facts).withColumn("p", probability(config.weights)).select(*key, "p")
        signals = boundary.with_model(signals.join(scored, key, "left"), "p")
    split, keep = lookahead.SplitConfig(config.window, config.commit_confidence, config.min_boundary_confidence), ("n_blocks", "page_num", "page_total", "signal")
    if config.confirmer is None:
        decided = lookahead.decide(signals, split, keep=keep).persist()
    else:
        message = F.col("message") if "message" in pages.columns else F.col("text")
        sent = pages.select(*key, F.left(message, F.lit(config.confirmer.config.calls.max_chars)).alias("message"), *(["replies"] if "replies" in pages.columns else []))
        decided = confirm.decide(signals.join(sent, key), config.confirmer, split, keep).persist()
    indexed = boundary.document_index(decided, apply=config.split_on_boundary)
    bounds = furniture.read_bounds(indexed, split.window, max(split.commit, split.fallback), split.propose)
    blocks = page_blocks(pages, bounds=bounds)
    name = F.format_string("%s-doc-%d", "bundle_id", "doc_index")
    placed = blocks.join(indexed.select(*key, "doc_index"), key).withColumn("document_id", name)
    documents = boundary.document_ranges(indexed).withColumn("document_id", name).join(assemble.titles(placed, "document_id"), "document_id", "left")
    sections = assemble.repaired_sections(assemble.sections(placed, "document_id"), "document_id")
    doubts = review.uncertainty_flags(indexed)
    events = review.event_log(pages.select(*key, T.page_class(F.col("text"))["page_class"].alias("page_class")), seen, signals, indexed)
    return Result(signals, placed, indexed, documents, sections, doubts, events, (signals, decided))


def inspect(pages: DataFrame) -> DataFrame:
    """One line an event, shortened."""
    c = pages.select("bundle_id", "page_index", T.page_class(F.col("text")).alias("c"))
    return c.select(F.format_string("%-20s page=%d %s", F.lit("page_classified"), "page_index", F.substring(F.to_json("c"), 1, 180)).alias("line"))


def evaluate(gold: DataFrame, predicted: DataFrame, bundle_floor: float, macro_floor: float) -> tuple[DataFrame, DataFrame]:
    """Ranges(bundle_id, doc_index, page_start, page_end) of both sides to (scores, gate)."""
    scores = metrics.boundary_scores(gold, metrics.boundaries(gold), metrics.boundaries(predicted))
    return scores, metrics.gate(scores, bundle_floor, macro_floor)
