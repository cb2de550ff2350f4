"""Quality rules with adaptive thresholds per language and source.

Each document has a few text metrics.  For every (lang, source) group and
metric a quantile sketch is kept: logarithmic bins with their counts (relative
error ``GAMMA - 1``), which merge by adding, whatever the order, so that the
same input always gives the same thresholds.  A group's upper fence is

    q50 + reach * (q(tail) - q50) + floor

or, for ratios of rare marks that most documents don't have at all,

    q50 * (q(tail) / q50) ** reach

of smoothed ratios (half a mark more, one character more), so that groups whose
documents have none differ by what their lengths can show; against that fence a
document counts without one of its marks, so that a single one is never held
against a short text.  Fences are made with the median and a tail quantile of the group's own sketch, so that it
follows each group's habits: documents of a source that uses many symbols or
repeats its lines are held against that source.  A tail of 0.75 stands for
metrics in which bad documents may be a large minority; 0.99 for metrics that
only the odd document has at all.  Where a fence of ``repeat_ratio`` exceeds the
base rule's limit, it rejects nothing more.  ``floor`` is a resolution, not a cutoff: it
is what single words or lines of a short text can make.  The lower fence of
two-sided rules mirrors the upper one with q(1 - tail).  Groups below
``least_rows`` documents take the sketch of their language, then that of all
documents, both merged from the groups' own.  The fences are joined to the
documents, which fail if any metric lies outside.

Base rules come first and are fixed: too few words, or too many words in
windows found twice.  Documents that fail them don't enter the sketches.

Edge cases: null and blank texts have no words and fail the base rule; null
languages or sources are groups of their own; repeated rows count each; the
metrics' names may clash with extra columns, which are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R
from .text_metrics import NAMES, metrics

GAMMA = 1.02


@dataclass(frozen=True)
class Rule:
    """A ratio of two metrics, the tail quantile and reach of its fence, and its resolution; ``marks``: a ratio of rare marks."""

    name: str
    top: str
    bottom: str
    tail: float
    reach: float
    floor: float
    two_sided: bool = False
    marks: bool = False


RULES = (
    Rule("symbol_ratio", "n_symbols", "word_chars", 0.75, 4.0, 0.0, marks=True),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", 0.99, 2.0, 0.1),
    Rule("repeat_ratio", "n_repeat_words", "n_words", 0.99, 2.0, 0.03),
    Rule("mean_word_chars", "word_chars", "n_words", 0.75, 10.0, 0.5, two_sided=True),
)
BASE_WORDS, BASE_REPEAT_PERCENT = 10, 20


def with_metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id (null: NULL_ID), the kept columns, and the metrics of NAMES."""
    R.prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.strings(b.column("text"))
            found = metrics(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", *keep)] + [pa.array(found[n], pa.int64()) for n in NAMES], names=["doc_id", *keep, *NAMES])

    texts = R.keyed(docs, *(F.col(c).cast("string").alias(c) for c in keep), "text")
    return R.map_arrow(texts, work, ", ".join(["doc_id long", *(f"`{c}` string" for c in keep), *(f"{n} long" for n in NAMES)]))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def _ratio(rule: Rule) -> Column:
    return F.when(F.col(rule.bottom) > 0, F.col(rule.top) / F.col(rule.bottom)).otherwise(F.lit(0.0))


def _sketched(rule: Rule) -> Column:
    """The value that enters the sketch."""
    return (F.col(rule.top) + 0.5) / (F.col(rule.bottom) + 1) if rule.marks else _ratio(rule)


def _held(rule: Rule) -> Column:
    """The value that is held against the fence."""
    return F.when(F.col(rule.bottom) > 0, F.greatest(F.col(rule.top) - 1, F.lit(0)) / F.col(rule.bottom)).otherwise(F.lit(0.0)) if rule.marks else _ratio(rule)


def _bin(value: Column) -> Column:
    """Bin 0 holds zero, bin k (k > 0) values in (GAMMA^(k-1), GAMMA^k] times 1e-6."""
    return F.when(value <= 1e-6, F.lit(0)).otherwise(F.ceil(F.log(value * 1e6) / F.log(F.lit(GAMMA))).cast("int"))


def _value(bin_: Column) -> Column:
    """The middle of a bin."""
    return F.when(bin_ == 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), bin_ - 0.5) * 1e-6)


def sketches(measured: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, rule, bin, n: one mergeable sketch for each group and rule."""
    bins = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), _bin(_sketched(r)).alias("bin")) for r in RULES)))
    return measured.where(~base_failed()).select(*keys, bins.alias("s")).groupBy(*keys, "s.rule", "s.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n, and a map from rule to (low, high)."""
    whole = Window.partitionBy(*keys, "rule")  # a sketch has a few thousand bins at most
    ranked = sketch.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), _value(F.col("bin"))))
    by_rule = lambda f: F.coalesce(*(F.when(F.col("rule") == r.name, f(r)) for r in RULES))
    upper = F.coalesce(*(F.when(F.first("rule") == r.name, at(r.tail)) for r in RULES))
    lower = F.coalesce(*(F.when(F.first("rule") == r.name, at(1 - r.tail)) for r in RULES if r.two_sided))
    quantiles = ranked.groupBy(*keys, "rule").agg(F.max("total").alias("total"), at(0.5).alias("q50"), upper.alias("upper"), lower.alias("lower"))
    above = lambda r: F.col("q50") * F.pow(F.col("upper") / F.col("q50"), r.reach) if r.marks else F.col("q50") + r.reach * (F.col("upper") - F.col("q50")) + r.floor
    high = by_rule(above)
    low = F.col("q50") - by_rule(lambda r: F.lit(r.reach)) * (F.col("q50") - F.col("lower")) - by_rule(lambda r: F.lit(r.floor))
    return quantiles.groupBy(*keys).agg(F.max("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("rule", F.struct(low.alias("low"), high.alias("high")).alias("fence")))).alias("fences"))


def judged(measured: DataFrame, keys: tuple[str, ...] = ("lang", "source"), least_rows: int = 100) -> DataFrame:
    """``measured`` (see :func:`with_metrics`) with base_failed, the ratios and kept."""
    sketch = R.stage(sketches(measured, keys), "sketches")
    levels = [keys[:k] for k in range(len(keys), -1, -1)]
    out = measured
    chosen: list[Column] = []
    for k, level in enumerate(levels):
        table = fences(sketch if k == 0 else merged(sketch, level), level) if level else fences(merged(sketch, ()).withColumn("_all", F.lit(0)), ("_all",)).drop("_all")
        table = table.select(*(F.col(c).alias(f"_{c}") for c in level), F.col("n").alias(f"_n{k}"), F.col("fences").alias(f"_f{k}"))
        if level:
            on = F.lit(True)
            for c in level:
                on &= out[c].eqNullSafe(table[f"_{c}"])
            out = out.join(table, on, "left").drop(*(f"_{c}" for c in level))
        else:
            out = out.join(F.broadcast(table.limit(1)), F.lit(True), "left")  # one row
        chosen.append(F.when(F.col(f"_n{k}") >= (least_rows if level else 0), F.col(f"_f{k}")))
    fence = F.coalesce(*chosen)
    inside = F.lit(True)
    for r in RULES:
        f = fence[r.name]
        inside &= F.coalesce(_held(r) <= f["high"], F.lit(True)) & F.coalesce(_held(r) >= f["low"], F.lit(True))
    return out.select(*measured.columns, base_failed().alias("base_failed"), *(_ratio(r).alias(r.name) for r in RULES), (~base_failed() & inside).alias("kept"))


def quality_verdicts(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), least_rows: int = 100) -> DataFrame:
    """doc_id, keys, metrics, base_failed, ratios, kept."""
    measured = R.stage(with_metrics(docs, *keys), "metrics")
    out = judged(measured, keys, least_rows)
    return out.select(R.plain_id(), *(c for c in out.columns if c != "doc_id"))


def quality_filter(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), least_rows: int = 100) -> DataFrame:
    """The documents (all columns) that are kept; ids are taken as unique."""
    bad = quality_verdicts(docs, keys, least_rows).where(~F.col("kept")).select(F.coalesce("doc_id", F.lit(R.NULL_ID)).alias("gone_id")).distinct()
    return R.without(docs, R.stage(bad, "bad"))
