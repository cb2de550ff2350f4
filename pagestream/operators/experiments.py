"""Around the parse: page files, glyph lines, adapters, scored regions, decision arms, threshold choice, comparisons, sinks."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pagestream.functions import text as T
from pagestream.operators import boundary, lookahead, metrics, recognition
from pagestream.shipping import ship

# --- fixed values: geometry of glyphs, labels without text, limits ---
LOOSE_PER_POINT, SAME_LINE, BOLD_WEIGHT = 1.15, 0.6, 600
BOLD_NAMES = ("bold", "black", "heavy", "semibold", "demi")
NO_TEXT = ("image", "header_image", "footer_image")
LONGEST_SCORED = 12000
STUDENT = 0.74
# --- end of fixed values ---
GEOMETRY = ("x0", "top", "x1", "bottom", "size", "loose_top", "loose_bottom")
#: Glyphs that are folded at once.
SLICE = 1 << 16
LINE = "struct<text:string,x0:double,top:double,x1:double,bottom:double,size:double,bold:boolean>"


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSONL files, one file a bundle: bundle_id, page_index, width, height, rotation, text, lines, has_text.

    A bundle is named by its file's path below ``path``; rotated pages have no lines.  A bad line fails the read.
    """
    from pagestream.sources.page_source import read_pages

    rows = read_pages(spark, path)
    upright = F.coalesce(F.col("rotation") % 360 == 0, F.lit(True))
    lines = F.when(upright, F.coalesce("lines", F.array().cast(f"array<{LINE}>"))).otherwise(F.array().cast(f"array<{LINE}>"))
    return rows.select("bundle_id", "page_index", "width", "height", F.coalesce("rotation", F.lit(0)).alias("rotation"), F.coalesce("text", F.lit("")).alias("text"), lines.alias("lines"), (T.strip(F.coalesce("text", F.lit(""))) != "").alias("has_text"))


def _by_value(column: pa.Array, f: Callable) -> list:
    """``f`` of each entry, called once a distinct one; nulls too."""
    coded = column.dictionary_encode(null_encoding="encode")
    made = [f(v) for v in coded.dictionary.to_pylist()]
    return [made[k] for k in coded.indices.to_pylist()]


def _plain(c: str | None) -> str:
    return "".join(" " if x.isspace() else "" if unicodedata.category(x) in ("Cc", "Cf") else x for x in c or "")


def _point(size: float | None, loose: float | None) -> float:
    s = round(size, 1)
    return round(loose / LOOSE_PER_POINT, 1) if loose > 2 * s else s


def _batch_lines(glyphs: pa.StructArray, ends: list[int]) -> tuple[list[int], dict[str, list]]:
    """Lines of pages whose glyphs lie one behind the other, up to ``ends``: how many each page has, and their columns.

    Geometry is measured from the page's upper left corner.  One step a glyph, so that long pages take no more than many short ones.
    """
    part = {c: glyphs.field(c) for c in ("char", *GEOMETRY, "weight", "font")}
    x0, top, x1, bottom, size, loose_top, loose_bottom = (part[c].to_numpy(zero_copy_only=False).astype(float) for c in GEOMETRY)
    loose = loose_bottom - loose_top
    middle = np.where(loose > 0, (loose_top + loose_bottom) / 2, (top + bottom) / 2).tolist()
    known: dict[tuple, float] = {}
    sizes = [known[p] if p in known else known.setdefault(p, _point(*p)) for p in zip(size.tolist(), loose.tolist(), strict=True)]
    reach = (np.maximum(np.array(sizes, float), 1) * SAME_LINE).tolist()
    plain, shown = _by_value(part["char"], _plain), _by_value(part["char"], lambda c: _plain(c).strip() != "")
    newline = _by_value(part["char"], lambda c: c is not None and c != "" and c in "\r\n")
    dark = _by_value(part["font"], lambda f: any(b in (f or "").lower() for b in BOLD_NAMES))
    heavy = (pc.fill_null(part["weight"], 0).to_numpy(zero_copy_only=False) >= BOLD_WEIGHT) | np.array(dark, bool)
    counts, firsts, visible, texts = [], [], [], []
    begin = 0
    for end in ends:
        lines, first = len(firsts), -1  # the first glyph of the line at hand
        for k in range(begin, end):
            if newline[k]:
                if first >= 0:
                    texts.append("".join(plain[begin:k]).strip())
                begin, first = k + 1, -1
            elif shown[k]:
                away = first >= 0 and abs(middle[k] - middle[first]) > reach[k]
                if away:
                    texts.append("".join(plain[begin:k]).strip())
                    begin = k
                if first < 0 or away:
                    first = k
                    firsts.append(len(visible))
                visible.append(k)
        if first >= 0:
            texts.append("".join(plain[begin:end]).strip())
        begin = end
        counts.append(len(firsts) - lines)
    at, stops = np.array(visible, int), [*firsts[1:], len(visible)]
    fold = lambda f, a: f.reduceat(a[at], firsts) if firsts else a[:0]
    modes = [Counter(sizes[k] for k in visible[lo:hi]).most_common(1)[0][0] for lo, hi in zip(firsts, stops, strict=False)]
    bold = 2 * fold(np.add, heavy.astype(int)) > np.subtract(stops[: len(firsts)], firsts)
    return counts, {"text": texts, "x0": fold(np.minimum, x0), "top": fold(np.minimum, top), "x1": fold(np.maximum, x1), "bottom": fold(np.maximum, bottom), "size": modes, "bold": bold}


def glyph_lines(pages: DataFrame) -> DataFrame:
    """``pages`` with their ``glyphs`` (char, x0, top, x1, bottom, size, loose_top, loose_bottom, weight, font) folded to ``lines``.

    Line ends and glyphs too far above or below a line's first one start a line; white space is one space, control and
    format characters go; a line's size is its commonest, and it is bold if most glyphs are.  Null glyphs: no lines.
    """
    ship(pages.sparkSession)
    rest = [c for c in pages.columns if c != "glyphs"]
    schema = S.StructType([*(pages.schema[c] for c in rest), S.StructField("lines", S._parse_datatype_string(f"array<{LINE}>"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [("text", pa.string()), *((c, pa.float64()) for c in GEOMETRY[:5]), ("bold", pa.bool_())]
        for b in batches:
            listed = b.column(b.schema.get_field_index("glyphs"))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)).tolist()
            # Some pages at a time, so that the values held beside the batch are bounded by a page.
            for lo, hi in _slices(ends):
                base = ends[lo - 1] if lo else 0
                counts, made = _batch_lines(listed.slice(lo, hi - lo).flatten(), [e - base for e in ends[lo:hi]])
                lines = pa.StructArray.from_arrays([pa.array(made[n], t) for n, t in names], names=[n for n, _ in names])
                folded = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), lines)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in rest), folded], names=[*rest, "lines"])

    return pages.mapInArrow(work, schema)


def _slices(ends: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of pages of some ``SLICE`` glyphs, one page at least."""
    lo, base = 0, 0
    for k, e in enumerate(ends):
        if e - base >= SLICE or k == len(ends) - 1:
            yield lo, k + 1
            lo, base = k + 1, e


@dataclass(frozen=True)
class Adapter:
    """A domain's addition to documents: ``enrich`` makes the new extras (map of strings) where ``applies`` holds."""

    name: str
    applies: Column
    enrich: Callable[[Column], Column]


def apply_adapters(documents: DataFrame, adapters: list[Adapter], owned: str = "flags") -> DataFrame:
    """documents(extras map<string,string>) through the adapters in order; the owned key stays as it was, or away."""
    none = F.create_map().cast("map<string,string>")
    out = documents.withColumns({"extras": F.coalesce("extras", none), "_owned": F.coalesce("extras", none)})
    for a in adapters:
        out = out.withColumn("extras", F.when(F.coalesce(a.applies, F.lit(False)), a.enrich(F.col("extras"))).otherwise(F.col("extras")))
    others = F.map_filter("extras", lambda k, _: k != owned)
    return out.withColumn("extras", F.when(F.map_contains_key("_owned", owned), F.map_concat(others, F.map_filter("_owned", lambda k, _: k == owned))).otherwise(others)).drop("_owned")


def first_heading_title(blocks: DataFrame) -> DataFrame:
    """The first heading of each page becomes its title."""
    page = Window.partitionBy("bundle_id", "page_index")
    first = F.min(F.when(F.col("kind") == "heading", F.col("reading_order"))).over(page)
    return blocks.withColumn("kind", F.when((F.col("kind") == "heading") & (F.col("reading_order") == first), "title").otherwise(F.col("kind")))


def ordered_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners within 0..1000, the smaller first."""
    a, b, c, d = (F.least(F.lit(1000), F.greatest(F.lit(0), v.cast("int"))) for v in (x0, y0, x1, y1))
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def percent_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """left, top, width and height of a box in percent of its page; null for pages without a size."""
    known = (width > 0) & (height > 0)
    return F.when(known, F.struct((100 * x0 / width).alias("left"), (100 * y0 / height).alias("top"), (100 * (x1 - x0) / width).alias("width"), (100 * (y1 - y0) / height).alias("height")))


def scored_regions(pages: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """What a verifier is asked of each page: its regions, and the page (at -1) without tags.

    keys, at, label, text, chars, asked; pictures, empty regions and pages that are too long aren't asked about.
    """
    each = pages.select(*keys, F.posexplode(recognition.regions(F.col(raw))).alias("at", "r"))
    regions = each.select(*keys, "at", F.col("r.label").alias("label"), F.col("r.text").alias("text"), F.length("r.text").alias("chars"), (~F.col("r.label").isin(*NO_TEXT) & (F.col("r.text") != "")).alias("asked"))
    text = T.strip(F.regexp_replace(raw, recognition.BOX_TAG, ""))
    whole = pages.select(*keys, F.lit(-1).alias("at"), F.lit("page").alias("label"), text.alias("text")).withColumn("chars", F.length("text"))
    return regions.unionByName(whole.withColumn("asked", F.coalesce(F.col("chars") <= LONGEST_SCORED, F.lit(False))))


def region_right(text: Column, gold: Column) -> Column:
    """A region is right if its text, without marks, lies in the page's true text; null without either."""
    read = recognition.normal(recognition.plain_text(text))
    return F.when((read != "") & gold.isNotNull(), F.contains(gold, read))


def stride_todo(records: DataFrame, done: DataFrame, stride: int) -> DataFrame:
    """records(file, name): every ``stride``-th name of a file (from the first) whose key "file/name" isn't done(key)."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("name")) - 1
    key = F.concat_ws("/", "file", "name")
    return records.withColumn("_at", place).where(F.col("_at") % stride == 0).select("file", "name", key.alias("key")).join(done.select("key").distinct(), "key", "left_anti")


def text_key(text: Column, limit: int | None = None) -> Column:
    """SHA-1 of a page's stripped text (of its first ``limit`` characters, if given); null for blank pages."""
    body = T.strip(text if limit is None else F.substring(T.strip(text), 1, limit))
    return F.when(body != "", F.sha1(F.encode(body, "UTF-8")))


def with_vectors(pages: DataFrame, vectors: DataFrame, column: str = "text", limit: int | None = None) -> DataFrame:
    """``pages`` with the ``vector`` of their text from vectors(key, vector); null for blank and unknown texts.

    Equal texts are looked up once, so that a common one doesn't gather its pages in one task.
    """
    keyed = pages.withColumn("_key", text_key(F.col(column), limit))
    known = vectors.select(F.col("key").alias("_key"), "vector").dropDuplicates(["_key"])
    return keyed.join(known, "_key", "left").drop("_key")


def student(p: Column, threshold: float) -> Column:
    """A student's probability as a decision arm gives it: just below sure from the threshold on, else 0; null if unknown."""
    return F.when(p.isNotNull(), F.when(p >= threshold, F.lit(STUDENT)).otherwise(F.lit(0.0)))


def beside(confidence: Column, probability: Column) -> Column:
    """An arm beside the heuristics: raises their confidence, never lowers it; below the level to propose it says nothing."""
    said = F.when(probability >= boundary.PROPOSE, probability)
    return F.greatest(confidence, said)


def arm_scores(signals: DataFrame, arms: dict[str, Column], decide: Callable[..., DataFrame] | None = None) -> DataFrame:
    """arm, bundles, macro_f1, false_splits, missed, tp, micro_precision, micro_recall of decisions by each arm's confidence.

    signals(bundle_id, page_index, page_num, page_total, gold_start); ``decide`` defaults to the look-ahead.  All arms
    run in one pass: an arm's bundles are bundles of their own.
    """
    choices = F.array(*(F.struct(F.lit(name).alias("arm"), c.cast("double").alias("confidence")) for name, c in arms.items()))
    each = signals.select("bundle_id", "page_index", "page_num", "page_total", "gold_start", F.explode(choices).alias("a"))
    rows = each.select(F.concat_ws("\x1f", "a.arm", "bundle_id").alias("bundle_id"), "page_index", "page_num", "page_total", "gold_start", F.when(F.col("page_index") > 0, F.col("a.confidence")).alias("confidence"))
    decided = (decide or (lambda r: lookahead.decide(r, keep=("gold_start",))))(rows)
    later = F.col("page_index") > 0
    scores = metrics.flagged_scores(decided.select("bundle_id", (F.col("gold_start") & later).alias("gold"), (F.col("split") & later).alias("predicted")), "gold", "predicted")
    out = scores.groupBy(F.substring_index("bundle_id", "\x1f", 1).alias("arm")).agg(F.count("*").alias("bundles"), F.avg("f1").alias("macro_f1"), F.sum("fp").alias("false_splits"), F.sum("fn").alias("missed"), F.sum("tp").alias("tp"))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other)))
    return out.withColumns({"micro_precision": share("false_splits"), "micro_recall": share("missed")})


def choose_threshold(grid: DataFrame, false_splits: int) -> DataFrame:
    """grid(t, macro_f1, false_splits): the t with the best macro F1 among those without more false splits; of equals fewer, then the first."""
    allowed = F.when(F.col("false_splits") <= false_splits, F.struct("macro_f1", (-F.col("false_splits")).alias("few"), (-F.col("t")).alias("first")))
    return grid.agg(F.max_by("t", allowed).alias("t"), F.max(allowed)["macro_f1"].alias("macro_f1"))


def compare_runs(before: DataFrame, after: DataFrame, marks_before: DataFrame, marks_after: DataFrame) -> DataFrame:
    """One row a band of after(band, bundle_id, f1, tp, fp, fn) against before(bundle_id, ...): scores, changed bundles, eligible.

    A bundle is changed if its predicted boundaries (marks(bundle_id, page_index), after with band) are others, however
    many they are.  A band is eligible if it makes no more false splits than the run before.
    """
    side = lambda df, x: df.select(*(["band"] if "band" in df.columns else []), "bundle_id", *(F.col(c).alias(f"{c}_{x}") for c in ("f1", "fp")))
    rows = side(after, "b").join(side(before, "a"), "bundle_id")
    old = marks_before.select("bundle_id", "page_index").distinct()
    met = marks_after.select("band", "bundle_id", "page_index").distinct().join(old.withColumn("old", F.lit(1)), ["bundle_id", "page_index"], "left")
    mine = met.groupBy("band", "bundle_id").agg(F.count("*").alias("marks"), F.count("old").alias("shared"))
    rows = rows.join(mine, ["band", "bundle_id"], "left").join(old.groupBy("bundle_id").agg(F.count("*").alias("old_marks")), "bundle_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    differs = (n("shared") != n("marks")) | (n("shared") != n("old_marks"))
    out = rows.groupBy("band").agg(F.avg("f1_b").alias("macro_f1"), F.sum("fp_b").alias("false_splits"), F.avg("f1_a").alias("baseline_macro_f1"), F.sum("fp_a").alias("baseline_false_splits"), F.count_if(differs).alias("changed"))
    return out.withColumn("eligible", F.col("false_splits") <= F.col("baseline_false_splits"))


def compare_decisions(pages: DataFrame, gold: Column, before: Column, after: list[Column]) -> DataFrame:
    """``compare_runs`` of decisions that stand beside each other on pages(bundle_id, ...), a band for each of ``after``: one aggregation by bundle."""
    flags = pages.select("bundle_id", gold.alias("gold"), before.alias("y"), *(y.alias(f"y{k}") for k, y in enumerate(after)))
    g = F.col("gold")

    def counts(y: Column, x: str) -> list[Column]:
        return [F.count_if(g & y).alias(f"tp{x}"), F.count_if(~g & y).alias(f"fp{x}"), F.count_if(g & ~y).alias(f"fn{x}")]

    names = [f"y{k}" for k in range(len(after))]
    counted = flags.groupBy("bundle_id").agg(*counts(F.col("y"), ""), *(c for y in names for c in counts(F.col(y), y)), *(F.max(F.col("y") != F.col(y)).alias(f"changed{y}") for y in names))
    f1 = lambda x: metrics.prf(F.col(f"tp{x}"), F.col(f"tp{x}") + F.col(f"fp{x}"), F.col(f"tp{x}") + F.col(f"fn{x}"))[2]
    bands = F.array(*(F.struct(f1(y).alias("f1"), F.col(f"fp{y}").alias("fp"), F.col(f"changed{y}").alias("changed")) for y in names))
    rows = counted.select(f1("").alias("f1"), F.col("fp"), F.posexplode(bands).alias("band", "b"))
    out = rows.groupBy("band").agg(F.avg("b.f1").alias("macro_f1"), F.sum("b.fp").alias("false_splits"), F.avg("f1").alias("baseline_macro_f1"), F.sum("fp").alias("baseline_false_splits"), F.count_if("b.changed").alias("changed"))
    return out.withColumn("eligible", F.col("false_splits") <= F.col("baseline_false_splits"))


def best_eligible(bands: DataFrame) -> DataFrame:
    """The eligible band with the best macro F1, of equals the first; null if none is."""
    return bands.agg(_best_band().alias("band"))


def with_best(bands: DataFrame) -> DataFrame:
    """``bands``, few rows, with best: whether it is the band that ``best_eligible`` names."""
    return bands.withColumn("best", F.col("band") == _best_band().over(Window.partitionBy(F.lit(0))))


def _best_band() -> Column:
    return F.max_by("band", F.when(F.col("eligible"), F.struct("macro_f1", (-F.col("band")).alias("first"))))


def holdout_maximum(pages: DataFrame, holdout: DataFrame, value: str) -> DataFrame:
    """The largest value on any page of the holdout bundles."""
    return pages.join(holdout.select("bundle_id").distinct(), "bundle_id", "left_semi").agg(F.max(value).alias("maximum"))


def clashing_stems(files: DataFrame) -> DataFrame:
    """files(path): stems that several files share, whose trees would overwrite each other."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return files.groupBy(stem.alias("stem")).agg(F.count("*").alias("files")).where("files > 1")


def document_trees(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """bundle_id and its documents with their sections as one JSON text, in order."""
    inner = sections.groupBy("bundle_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("page_start", "section_id", "page_end", "heading"))).alias("sections"))
    rows = documents.join(inner, ["bundle_id", "document_id"], "left")
    none = F.array().cast("array<struct<page_start:int,section_id:string,page_end:int,heading:string>>")
    each = rows.select("bundle_id", F.struct("page_start", "document_id", "page_end", "title", F.coalesce(F.col("sections").cast("array<struct<page_start:int,section_id:string,page_end:int,heading:string>>"), none).alias("sections")).alias("d"))
    return each.groupBy("bundle_id").agg(F.to_json(F.struct(F.first("bundle_id").alias("bundle_id"), F.array_sort(F.collect_list("d")).alias("documents"))).alias("tree"))


def write_trees(trees: DataFrame, path: str) -> None:
    """One JSON line a bundle, by bundle; bundles that come are written anew, whole or not at all, others stay."""
    trees.select("bundle_id", F.col("tree").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bundle_id").text(path)


def append_timings(timings: DataFrame, path: str) -> None:
    """JSON lines beside those that are there."""
    timings.write.mode("append").json(path)


def unit_interval(value: object, name: str) -> float:
    """A number in 0..1; True and False are no numbers."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError(f"{name} has to be a number in 0..1")
    return float(value)


def positive_int(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} has to be a positive whole number")
    return value


def gold_pages(text: str) -> list[int]:
    """"3, 7" to pages, in order, each once."""
    parts = [p.strip() for p in text.split(",")]
    if any(not re.fullmatch(r"\d+", p) for p in parts):
        raise ValueError(f"not a list of pages: {text}")
    return sorted({int(p) for p in parts})
