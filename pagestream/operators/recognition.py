"""Recognition output and its cache: record states, work plans, resumable writes, clean-up, measures, engines."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.functions.edits import edits
from pagestream.shipping import ship

# --- fixed values: formats ---
SCHEMA = 1
TAG = r"!\[([a-z_]+\+?)\]\((\d+),(\d+),(\d+),(\d+)\)"
BOX_TAG = r"!\[([a-z_]+)\+?\]\((-?\d+),(-?\d+),(-?\d+),(-?\d+)\)"
CHECK_EVERY = 64
ENGINES = ("off", "on", "auto", "lighton", "mlx", "paddle")
NOTHING = ("", "empty", "n/a", "none", "null")
PAGE_FIELDS = (("header", ""), ("title", "# "), ("body_text", ""), ("tables", ""), ("footer", ""), ("page_number", ""))
# --- end of fixed values ---
#: Stands between cells; no character reference makes it.
CELL = "\u001e"
RECORD = "struct<schema:int,pdf_sha256:string,page:int,raw:string,engine:string,truncated:boolean>"


def record_state(raw: Column, sha: Column, page: Column, engine: str, schema: int = SCHEMA) -> Column:
    """pending without a record, corrupt if it isn't what it says, stale by another engine, else cached."""
    r = F.from_json(raw, RECORD)
    ok = (r["schema"] == schema) & (r["pdf_sha256"] == sha) & (r["page"] == page) & r["raw"].isNotNull()
    return F.when(raw.isNull(), "pending").when(~F.coalesce(ok, F.lit(False)), "corrupt").when(F.coalesce(r["engine"] == engine, F.lit(False)), "cached").otherwise("stale")


def with_state(plan: DataFrame, records: DataFrame, engine: str) -> DataFrame:
    """plan(sha, page) with the state and the record of each page; records(sha, page, record json)."""
    joined = plan.join(records.select("sha", "page", "record"), ["sha", "page"], "left")
    return joined.withColumn("state", record_state(F.col("record"), F.col("sha"), F.col("page"), engine))


def work_plan(stated: DataFrame, limit: int | None = None, force: bool = False) -> DataFrame:
    """The pages that recognition has to read: all but cached ones, in order; ``limit`` is the caller's."""
    todo = stated if force else stated.where("state <> 'cached'")
    return todo.orderBy("sha", "page").limit(limit) if limit is not None else todo


def write_records(records: DataFrame, path: str) -> None:
    """records(sha, page, record) by sha: those of the files that come are written anew, whole or not at all; others stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sha").parquet(path)


def run_summary(runs: DataFrame) -> DataFrame:
    """runs(stop, seconds, chars): totals by the reason a page stopped, and of all."""
    return runs.rollup("stop").agg(F.count("*").alias("pages"), F.sum("seconds").alias("seconds"), F.sum("chars").cast("long").alias("chars"))


def untag(raw: Column) -> Column:
    """Without grounding tags."""
    return T.strip(F.regexp_replace(raw, TAG + r"\s*", ""))


def unescaped(text: Column) -> Column:
    """Character references by name and number become characters, once. Only texts with one go to Python."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.coalesce(unescape(F.when(text.contains("&"), text)), text)


def plain_text(raw: Column) -> Column:
    """Without tags, cell borders, entities, heading marks, emphasis and rules of lines."""
    t = F.regexp_replace(raw, TAG, " ")
    t = F.regexp_replace(t, r"</t[dh]>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = unescaped(t)
    t = F.regexp_replace(t, r"(?m)^\s*#+\s*", "")
    t = F.replace(F.replace(t, F.lit("**"), F.lit("")), F.lit("|"), F.lit(" "))
    return F.regexp_replace(t, r"(?m)^[\s:-]+$", "")


def normal(text: Column) -> Column:
    return T.one_space(F.replace(text, F.lit("|"), F.lit(" ")))


def table_cells(raw: Column) -> Column:
    """Cells of html tables, then of piped lines; rules and empty cells are left out."""
    inside = F.transform(F.regexp_extract_all(raw, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.replace(F.regexp_replace(c, r"<[^>]+>", ""), F.lit(CELL), F.lit(" ")))
    # All cells of a text are unescaped at once, between marks that no reference makes.
    tagged = F.transform(F.split(unescaped(F.nullif(F.concat(F.array_join(inside, CELL), F.lit(CELL)), F.lit(CELL))), CELL), normal)
    tagged = F.coalesce(tagged, F.array().cast("array<string>"))
    piped = F.flatten(F.transform(F.filter(F.transform(F.split(raw, "\n"), T.strip), lambda x: x.startswith("|")), lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), normal)))
    return F.filter(F.concat(tagged, piped), lambda c: (c != "") & ~c.rlike(r"^:?-+:?$"))


def reading_errors(texts: DataFrame, reference: str = "reference", read: str = "read") -> DataFrame:
    """``texts`` with cer and wer: edits of characters and of words by those of the reference, over whole texts.

    A missing or empty reading loses all (1.0); a reference without characters or words has no such error (null).
    Characters are code points as they come; see ``normal`` and ``plain_text`` for clean ones.
    """
    ship(texts.sparkSession)

    @F.pandas_udf("cer double, wer double")
    def errors(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        def share(a: str | list[str], b: str | list[str]) -> float | None:
            return edits(a, b) / len(a) if a else None

        pairs = [(a or "", b or "") for a, b in zip(one, two, strict=True)]
        return pd.DataFrame({"cer": [share(a, b) for a, b in pairs], "wer": [share(a.split(), b.split()) for a, b in pairs]}, dtype="float64")

    return texts.withColumn("_errors", errors(F.col(reference), F.col(read))).select(*texts.columns, "_errors.cer", "_errors.wer")


def word_error(texts: DataFrame, reference: str = "reference", read: str = "read") -> DataFrame:
    """``texts`` with wer: edits of words by the words of the reference; null without any."""
    ship(texts.sparkSession)

    @F.pandas_udf("double")
    def wer(one: pd.Series, two: pd.Series) -> pd.Series:
        words = (((a or "").split(), (b or "").split()) for a, b in zip(one, two, strict=True))
        return pd.Series([edits(a, b) / len(a) if a else None for a, b in words], dtype="float64")

    return texts.withColumn("wer", wer(F.col(reference), F.col(read)))


def cell_recall(cells: Column, raw: Column) -> Column:
    """The share of the reference's table cells (an array; empty ones don't count) that the reading has as cells."""
    wanted = F.transform(F.filter(cells, lambda c: c != ""), normal)
    # The cells come as an argument, as Spark allows no Python function inside a lambda's body.
    found = F.array_repeat(table_cells(F.coalesce(raw, F.lit(""))), F.size(wanted))
    return F.when(F.size(wanted) > 0, F.size(F.filter(F.zip_with(wanted, found, lambda c, cells: F.array_contains(cells, c)), lambda x: x)) / F.size(wanted))


def furniture_recall(items: Column, read: Column) -> Column:
    """The share of heads, feet and page numbers (an array; null and empty ones don't count) that the reading holds anywhere."""
    wanted = F.filter(items, lambda c: c != "")
    text = normal(F.coalesce(read, F.lit("")))
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda c: F.contains(text, normal(c)))) / F.size(wanted))


def line_recall(reference: Column, read: Column) -> Column:
    """The share of the reference's lines that the reading holds."""
    lines = F.filter(F.transform(F.split(reference, "\n"), normal), lambda x: x != "")
    text = F.coalesce(read, F.lit(""))
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: F.contains(text, x))) / F.size(lines))


def regions(raw: Column) -> Column:
    """Array of (label, x0, y0, x1, y1, text) from a tagged reading."""
    parts = F.regexp_extract_all(raw, F.lit(rf"(?s)({BOX_TAG}.*?)(?={BOX_TAG}|\z)"), F.lit(1))
    number = lambda x, k: F.regexp_extract(x, BOX_TAG, k).try_cast("int")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, BOX_TAG, 1).alias("label"), *(number(x, k + 2).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))), T.strip(F.regexp_replace(x, BOX_TAG, "")).alias("text")))


def kept_regions(regions_: Column, probabilities: Column, threshold: float) -> Column:
    """Regions whose probability (by place) isn't known or reaches the threshold."""
    return F.filter(F.transform(regions_, lambda x, i: F.when(F.coalesce(F.try_element_at(probabilities, i + 1) >= threshold, F.lit(True)), x)), lambda x: x.isNotNull())


def first_key_json(text: str) -> object:
    """JSON, in a code fence or not, in which the first of equal keys wins."""
    text = text.strip()
    if text.startswith("```"):
        text = text.strip("`")
        text = text[max(text.find("{"), 0) :]

    def first(pairs: list[tuple[str, object]]) -> dict:
        out: dict[str, object] = {}
        for k, v in pairs:
            out.setdefault(k, v)
        return out

    return json.loads(text, object_pairs_hook=first)


def _flat(value: object) -> str:
    """A field as text: list items as paragraphs, objects as "key: value" lines; words for nothing are nothing."""
    match value:
        case list():
            return "\n\n".join(map(_flat, value))
        case dict():
            return "\n".join(f"{k}: {_flat(v)}" for k, v in value.items())
    text = "" if value is None else str(value).strip()
    return "" if text.lower() in NOTHING else text


def json_markdown(page: object) -> str:
    """A page read as an object to Markdown in the order of the page; other fields and blank ones are left out."""
    if not isinstance(page, dict):
        return ""
    texts = ((mark, _flat(page.get(name))) for name, mark in PAGE_FIELDS)
    return "\n\n".join(mark + text for mark, text in texts if text)


def drain(chunks: Iterator[str], fires, most: int, every: int = CHECK_EVERY) -> tuple[str, str]:
    """(text, stop) of a stream of tokens: eos, max_tokens, or loop, which ``fires`` tells of the text every ``every`` tokens."""
    text, n = [], 0
    for piece in chunks:
        text.append(piece)
        n += 1
        if n % every == 0 and fires("".join(text)):
            return "".join(text), "loop"
        if n >= most:
            return "".join(text), "max_tokens"
    return "".join(text), "eos"


def choose_engine(wanted: str | None, available: set[str]) -> str | None:
    """The engine of a setting: off is none, a name has to be there, on has to find one, auto takes what there is."""
    choice = (wanted or "auto").strip().lower()
    if choice not in ENGINES:
        raise ValueError(f"unknown engine setting: {wanted}; one of {', '.join(ENGINES)}")
    if choice == "off":
        return None
    if choice in ("on", "auto"):
        found = next((e for e in ENGINES[3:] if e in available), None)
        if found is None and choice == "on":
            raise ValueError("recognition is on, but no engine is available")
        return found
    if choice not in available:
        raise ValueError(f"engine {choice} is not available")
    return choice


# --- loaders ---


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSONL rows (split, doc_name, page_no, ...) to one row a document, its pages in order; a bad line fails."""
    rows = spark.read.schema("split string, doc_name string, page_no int, image string").json(path, mode="FAILFAST")
    return rows.groupBy("split", "doc_name").agg(F.array_sort(F.collect_list(F.struct("page_no", "image"))).alias("pages"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSONL labels (file_name, sub_documents) to gold ranges, pages from 0: bundle_id, doc_index, page_start, page_end, title."""
    rows = spark.read.schema("file_name string, sub_documents array<struct<start_page:int,end_page:int,identifier:string,type:string>>").json(path, mode="FAILFAST")
    each = rows.select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("bundle_id"), F.posexplode("sub_documents").alias("doc_index", "d"))
    title = F.coalesce(F.nullif("d.identifier", F.lit("")), F.nullif("d.type", F.lit("")), F.format_string("doc-%d", F.col("doc_index")))
    return each.select("bundle_id", "doc_index", (F.col("d.start_page") - 1).alias("page_start"), (F.col("d.end_page") - 1).alias("page_end"), title.alias("title"))


def done_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys of a JSONL log that a broken run may have cut: a bad last line is left out, a bad one before fails."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("l"))
    each = lines.select(F.size("l").alias("n"), F.posexplode("l").alias("at", "line")).where(F.trim("line") != "")
    value = F.coalesce(F.get_json_object("line", f"$.{key}"), F.lit(""))
    broken = (value == "") & (F.col("at") < F.col("n") - 1)
    keys = each.select(F.when(broken, F.raise_error(F.lit("a line in the middle of the log is broken"))).otherwise(value).alias(key))
    return keys.distinct().where(F.col(key) != "")


def pinned(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files(path, sha256) that the manifest(sha256) names."""
    return files.join(manifest.select("sha256").distinct(), "sha256", "left_semi")


def placeholder_pages(bundles: DataFrame) -> DataFrame:
    """bundles(bundle_id, pages) to pages whose text is "Page p of n"."""
    each = bundles.select("bundle_id", "pages", F.explode(F.sequence(F.lit(1), "pages")).alias("p")).where("pages > 0")
    return each.select("bundle_id", (F.col("p") - 1).cast("int").alias("page_index"), F.format_string("Page %d of %d", "p", "pages").alias("text"))


