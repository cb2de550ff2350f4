"""Section trees as flat tables: nesting, titles, extents, paths, citations, review checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestream.functions import text as T

FURNITURE = ("header", "footer", "page_number")
LEVELS = 7


def body(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.col("kind").isin(*FURNITURE))


def _order(key: str):
    return Window.partitionBy(key).orderBy("page_index", "reading_order")


def sections(blocks: DataFrame, key: str = "bundle_id") -> DataFrame:
    """One row a section: ord, section_id, level, heading, parent_ord, page_start, page_end, n_blocks.

    A heading's parent is the nearest one before it with a lower level; blocks
    hang on the latest heading, those before any on one anonymous section.
    Levels go up to 6, so each level's latest heading is one window.
    """
    w = _order(key)
    is_head = F.col("kind").isin("title", "heading")
    level = F.when(F.col("kind") == "title", 0).when(is_head, F.least(F.coalesce("heading_level", F.lit(1)), F.lit(LEVELS - 1)))
    rows = body(blocks).withColumns({"pos": F.row_number().over(w), "head": is_head, "level": level})
    rows = rows.withColumn("opens", F.col("head") | (F.col("pos") == 1))
    rows = rows.withColumn("ord", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(w))
    # An anonymous first section has level 1.
    opened = F.when(F.col("opens"), F.coalesce("level", F.lit(1)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lasts = {f"last{k}": F.last(F.when(opened == k, F.col("ord")), ignorenulls=True).over(before) for k in range(LEVELS)}
    rows = rows.withColumns({"opened": opened, **lasts})
    candidates = F.array(*(F.when(F.col("opened") > k, F.col(f"last{k}")) for k in range(LEVELS)))
    parent = F.array_max(candidates)
    # What stands before the next section and at the bundle's end gives extents, without a join; sections keep the blocks' sort.
    whole = Window.partitionBy(key)
    rows = rows.withColumns({"before_page": F.lag("page_index").over(w), "parent_ord": parent, "pages_end": F.max("page_index").over(whole), "n": F.count("*").over(whole)})
    heads = rows.where(F.col("opens") & F.col(key).isNotNull())
    own_end, stop = F.coalesce(F.lead("before_page").over(w), F.col("pages_end")), F.coalesce(F.lead("pos").over(w), F.col("n") + 1)
    heads = heads.withColumns({"own_end": own_end, "n_blocks": stop - F.col("pos")})
    # A subtree is contiguous: it ends before the next section whose level is not above its own, and pages only grow.
    # Looking back from the end, the latest of each level is one running value.
    back = Window.partitionBy(key).orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.least(*(F.when(F.col("opened") >= k, F.min(F.when(F.col("opened") == k, F.struct("ord", "before_page"))).over(back)) for k in range(LEVELS)))
    page_end = F.when(after.isNull(), F.col("pages_end")).otherwise(after["before_page"])
    return heads.select(key, "ord", F.when(F.col("head"), F.concat("block_id", F.lit("-sec"))).otherwise(F.lit("anon-1")).alias("section_id"), F.col("opened").alias("level"), F.when(F.col("head"), F.substring(F.split("text", "\n")[0], 1, 200)).alias("heading"), "parent_ord", F.col("page_index").alias("page_start"), "own_end", "n_blocks", page_end.alias("page_end"))


def titles(blocks: DataFrame, key: str = "bundle_id") -> DataFrame:
    """The first title or heading among the first eight body blocks, else the first block; its first line."""
    rows = body(blocks).withColumn("pos", F.row_number().over(_order(key)))
    line = F.substring(F.split("text", "\n")[0], 1, 200)
    head = F.min(F.when((F.col("pos") <= 8) & F.col("kind").isin("title", "heading") & (F.col("text") != ""), F.struct("pos", line.alias("line"))))
    first = F.min(F.when((F.col("pos") == 1) & (F.col("text") != ""), F.struct("pos", line.alias("line"))))
    return rows.groupBy(key).agg(F.coalesce(head["line"], first["line"]).alias("title"))


def numbered_parents(sections_: DataFrame, key: str = "bundle_id") -> DataFrame:
    """For each section with an outline number: the nearest one before it whose number is its number without the last part."""
    return _with_numbers(sections_, key).where("token is not null").select(key, "ord", "depth", "token", "number_parent")


def _with_numbers(sections_: DataFrame, key: str) -> DataFrame:
    """All sections with depth and token of their outline number, number_parent and that one's section_id as number_id; null without."""
    columns = sections_.columns
    rows = sections_.withColumn("number", T.numbering(F.col("heading")))
    parts = F.col("number.parts")
    own, want = F.array_join(parts, "."), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))
    # An as-of join in one pass: a section stands at the number it wants and at the one it bears, where the latest is carried on.
    section = F.struct(*columns, F.col("number.depth").alias("depth"), F.col("number.token").alias("token"))
    rows = rows.select(key, "ord", section.alias("section"), own.alias("own"), want.alias("want"), F.struct("ord", "section_id").alias("bearer"))
    side = lambda match, here, bearer: F.struct(match.alias("match"), here.alias("here"), bearer.alias("bearer"))
    nobody, nothing = F.lit(None).cast(rows.schema["bearer"].dataType), F.lit(None).cast(rows.schema["section"].dataType)
    sides = F.array_compact(F.array(side(F.col("want"), F.col("section"), nobody), F.when(F.col("own").isNotNull(), side(F.col("own"), nothing, F.col("bearer")))))
    each = rows.select(key, "ord", F.explode(sides).alias("x")).select(key, "ord", "x.match", "x.here", "x.bearer")
    w = Window.partitionBy(key, "match").orderBy("ord", F.col("bearer").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = each.withColumn("found", F.when(F.col("match").isNotNull(), F.last("bearer", ignorenulls=True).over(w))).where("here is not null")
    return found.select("here.*", F.col("found.ord").alias("number_parent"), F.col("found.section_id").alias("number_id"))


def _ends(sections_: DataFrame, key: str) -> DataFrame:
    """page_end of each section from its own last page and its children's, whatever their order; parents stand before children."""
    schema = f"{key} string, ord long, page_end int"

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", ascending=False)
        end = dict(zip(frame["ord"], frame["own_end"], strict=True))
        for o, p in zip(frame["ord"], frame["parent_ord"], strict=True):
            if not pd.isna(p):
                end[int(p)] = max(end[int(p)], end[o])
        return pd.DataFrame({key: frame[key], "ord": frame["ord"], "page_end": [end[o] for o in frame["ord"]]})

    return sections_.select(F.col(key).cast("string").alias(key), "ord", "parent_ord", "own_end").groupBy(key).applyInPandas(work, schema)


def _moved(sections_: DataFrame, key: str) -> DataFrame:
    """Sections with level, parent_ord and own_end put right, moved, and from_parent if moved; number_id is a moved one's new parent."""
    joined = _with_numbers(sections_, key)
    movable = F.col("level") != 0
    moved = movable & F.col("number_parent").isNotNull() & ~F.col("parent_ord").eqNullSafe(F.col("number_parent"))
    out = joined.withColumns({"moved": F.coalesce(moved, F.lit(False)), "new_level": F.when(movable & F.col("depth").isNotNull(), F.col("depth")).otherwise(F.col("level"))})
    out = out.withColumns({"from_parent": F.when(F.col("moved"), F.col("parent_ord")), "parent_ord": F.when(F.col("moved"), F.col("number_parent")).otherwise(F.col("parent_ord")), "own_end": F.coalesce("own_end", "page_start")})
    return out.drop("level", "depth", "number_parent").withColumnRenamed("new_level", "level")


def repaired_sections(sections_: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Sections whose outline number disagrees with their level, put right: level, parent_ord and page_end, and from_parent if moved.

    The level becomes the number's depth; the parent the section that bears the number without its last part, if
    there is one.  Titles keep their level and place.
    """
    out = _moved(sections_, key)
    return out.drop("page_end", "number_id").join(_ends(out, key), [key, "ord"])


def repaired(sections_: DataFrame, key: str = "bundle_id") -> DataFrame:
    """One flag a moved section: its page and id, the ids of its old and new parent, and the number."""
    rows = _moved(sections_, key)
    # Old parents are looked up where sections stand at their own place and, if moved, at their old parent's.
    flag = F.when(F.col("moved"), F.struct(F.col("page_start").alias("page"), F.col("section_id").alias("ref"), F.col("number_id").alias("to_id"), F.col("token").alias("numbering")))
    rows = rows.select(key, "ord", "section_id", "from_parent", flag.alias("flag"))
    side = lambda at, name, here: F.struct(at.alias("at"), name.alias("name"), here.alias("here"))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast(rows.schema["flag"].dataType)
    sides = F.array_compact(F.array(side(F.col("ord"), F.col("section_id"), nothing), F.when(F.col("flag").isNotNull(), side(F.col("from_parent"), none, F.col("flag")))))
    each = rows.select(key, F.explode(sides).alias("x")).select(key, "x.at", "x.name", "x.here")
    named = each.withColumn("from_id", F.when(F.col("at").isNotNull(), F.max("name").over(Window.partitionBy(key, "at")))).where("here is not null")
    return named.select(key, "here.page", "here.ref", "from_id", "here.to_id", "here.numbering")


def citations(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """documents(bundle_id, doc_index, cited array<string>), blocks(bundle_id, doc_index, block_id): cited ids with a resolved flag; ids of the same and earlier documents are known."""
    cited = documents.select("bundle_id", "doc_index", F.explode("cited").alias("block_id"))
    known = blocks.groupBy("bundle_id", "block_id").agg(F.min("doc_index").alias("known_from"))
    return cited.join(known, ["bundle_id", "block_id"], "left").withColumn("resolved", F.coalesce(F.col("known_from") <= F.col("doc_index"), F.lit(False)))


def citation_integrity(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Share of citations that some block of the bundle resolves; 1 without citations."""
    cited = documents.select("bundle_id", F.explode_outer("cited").alias("block_id"))
    ids = blocks.select("bundle_id", "block_id").distinct().withColumn("known", F.lit(1))
    share = F.avg(F.when(F.col("block_id").isNotNull(), F.coalesce("known", F.lit(0))))
    return cited.join(ids, ["bundle_id", "block_id"], "left").groupBy("bundle_id").agg(F.coalesce(share, F.lit(1.0)).alias("integrity"))
