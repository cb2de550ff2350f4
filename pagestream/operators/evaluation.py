"""Evaluation beyond single scores: tolerant matching, gates with floors, holdouts, ship rules, thresholds, text measures."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators.metrics import prf, running
from pagestream.shipping import ship


@dataclass(frozen=True)
class Floors:
    """Least F1 of each bundle, and of the mean."""

    bundle: float
    macro: float


# --- fixed values: floors of the evaluation sets ---
FLOORS = {"builtin": Floors(1.0, 1.0), "whole_documents": Floors(0.0, 0.6), "mixed_files": Floors(0.0, 0.0), "mixed_files_cached": Floors(0.0, 0.41)}
# --- end of fixed values ---


def _fold(batches: Iterator[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    """Matches of sorted islands, streamed: only boundaries within the tolerance of the page at hand are held."""
    key, gold, free = None, deque(), deque()

    def settle(before: float) -> int:
        """Gold boundaries whose reach ends ``before`` take the nearest free prediction; of equals the earlier one."""
        found = 0
        while gold and gold[0] + tolerance < before:
            g = gold.popleft()
            while free and free[0] < g - tolerance:
                free.popleft()
            near = min((p for p in free if p <= g + tolerance), key=lambda p: (abs(p - g), p), default=None)
            if near is not None:
                free.remove(near)
                found += 1
        return found

    for b in batches:
        matched: dict[str, int] = {}
        for bundle, island, page, g, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (bundle, island):
                if key is not None:
                    matched[key[0]] = matched.get(key[0], 0) + settle(np.inf)
                key = (bundle, island)
                free.clear()
            matched[bundle] = matched.get(bundle, 0) + settle(page)
            if g:
                gold.append(page)
            if p:
                free.append(page)
        yield pa.RecordBatch.from_pydict({"bundle_id": pa.array(matched.keys(), pa.string()), "matched": pa.array(matched.values(), pa.int64())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"bundle_id": pa.array([key[0]], pa.string()), "matched": pa.array([settle(np.inf)], pa.int64())})


def _islands(pages: DataFrame, tolerance: int) -> DataFrame:
    """pages(bundle_id, page_index, g, p) with their island and its counts; boundaries of two islands never match."""
    order = Window.partitionBy("bundle_id").orderBy("page_index")
    opens = F.coalesce(F.col("page_index") - F.lag("page_index").over(order) > tolerance, F.lit(True))
    island = Window.partitionBy("bundle_id", "island")
    numbered = pages.withColumn("opens", opens).withColumn("island", F.sum(F.col("opens").cast("long")).over(order))
    return numbered.withColumns({"n_g": F.sum("g").over(island), "n_p": F.sum("p").over(island)})


def tolerant_scores(gold: DataFrame, predicted: DataFrame, tolerance: int) -> DataFrame:
    """Sets of boundaries(bundle_id, page_index) to matched, n_gold, n_pred, precision, recall and f1 by bundle.

    Gold boundaries in order take the nearest free prediction within the tolerance.  A bundle's boundaries fall into
    islands, further apart than the tolerance: one with at most one boundary of a kind is settled by its counts, the
    rest goes island by island through a fold whose state the tolerance bounds, so that one bundle may hold any number
    of boundaries.  Repeated rows count once, rows without a page not at all; bundles without boundaries have no row.
    """
    sides = gold.select("bundle_id", "page_index", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select("bundle_id", "page_index", F.lit(0).alias("g"), F.lit(1).alias("p"))).where("page_index is not null")
    if tolerance == 0:
        counted = sides.groupBy("bundle_id", "page_index").agg(F.max("g").alias("g"), F.max("p").alias("p")).groupBy("bundle_id").agg(F.sum(F.col("g") * F.col("p")).alias("matched"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    else:
        ship(gold.sparkSession)
        # One shuffle by bundle serves the sets, the islands and their counts.
        pages = _islands(sides.repartition("bundle_id").groupBy("bundle_id", "page_index").agg(F.max("g").alias("g"), F.max("p").alias("p")), tolerance)
        plain = F.least("n_g", "n_p") <= 1
        settled = pages.groupBy("bundle_id").agg(F.sum(F.when(plain & F.col("opens"), F.least("n_g", "n_p")).otherwise(0)).alias("matched"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
        rest = pages.where(~plain).select("bundle_id", "island", "page_index", "g", "p").repartition("bundle_id", "island").sortWithinPartitions("bundle_id", "island", "page_index")
        folded = rest.mapInArrow(lambda batches: _fold(batches, tolerance), "bundle_id string, matched long")
        none = F.lit(0).cast("long")
        counted = settled.unionByName(folded.select("bundle_id", "matched", none.alias("n_gold"), none.alias("n_pred"))).groupBy("bundle_id").agg(*(F.sum(c).alias(c) for c in ("matched", "n_gold", "n_pred")))
    p, r, f = prf(F.col("matched"), F.col("n_pred"), F.col("n_gold"))
    return counted.withColumns({"precision": p, "recall": r, "f1": f, "false_splits": F.col("n_pred") - F.col("matched")})


def gate_failures(scores: DataFrame, floors: Floors, false_ocr: DataFrame | None = None, holdout: DataFrame | Column | None = None) -> DataFrame:
    """One row a failure (bundle_id, failure): low bundles, pages read in vain, a low mean (of the holdout bundles if given), nothing run.

    ``holdout`` is a table of bundle_ids or a condition on ``scores``.  Bundles and their mean come from one pass over ``scores``.
    """
    low = F.col("f1").isNull() | F.isnan("f1") | (F.col("f1") < floors.bundle)
    if isinstance(holdout, DataFrame):
        scores = scores.join(holdout.select("bundle_id", F.lit(True).alias("_own")).distinct(), "bundle_id", "left")
        holdout = F.col("_own")
    own = F.lit(True) if holdout is None else F.coalesce(holdout, F.lit(False))
    rows = scores.select("bundle_id", low.cast("long").alias("low"), own.cast("long").alias("n"), F.when(own, F.col("f1")).alias("f1"))
    # A row that counts as nothing, so that there is a total without any bundle too.
    none = scores.sparkSession.range(1).select(F.lit(None).cast(scores.schema["bundle_id"].dataType).alias("bundle_id"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("f1"))
    both = rows.unionByName(none).rollup("bundle_id").agg(F.grouping("bundle_id").alias("total"), F.sum("low").alias("low"), F.sum("n").alias("n"), F.avg("f1").alias("m"))
    mean = F.when(F.col("n") == 0, "no_bundles").when(F.col("m").isNull() | F.isnan("m") | (F.col("m") < floors.macro), "low_macro")
    why = F.when(F.col("total") == 1, F.array_compact(F.array(mean))).otherwise(F.array_repeat(F.lit("low_f1"), F.col("low").cast("int")))
    out = both.select("bundle_id", F.explode(why).alias("failure"))
    if false_ocr is not None:
        out = out.unionByName(false_ocr.select("bundle_id", F.lit("false_ocr").alias("failure")).distinct())
    return out


def holdout_scorecard(scores: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row: bundles, macro and micro scores of the holdout, and the floor they suggest (two decimals, cut off)."""
    own = scores.join(holdout.select("bundle_id").distinct(), "bundle_id", "left_semi")
    out = own.agg(F.count("*").alias("bundles"), F.avg("f1").alias("macro_f1"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r, f = prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return out.select("bundles", "macro_f1", p.alias("micro_precision"), r.alias("micro_recall"), f.alias("micro_f1"), T.truncate_two_places(F.col("macro_f1")).alias("proposed_floor"))


def ship_checks(before: DataFrame, after: DataFrame, saturated: DataFrame, missed: DataFrame, residual_positives: int = 0, always_open: bool = False) -> DataFrame:
    """One row of the rule for a new scorer: bundle scores (f1, tp, fp, fn) of both arms, over the bundles of two roles.

    ``saturated`` bundles stay as they are, every one of ``missed`` (one at least) rises, and so do the mean and the
    pooled F1 of both; other bundles, such as those that the scorer was trained on, have no say.
    """
    roles = saturated.select("bundle_id", F.lit(True).alias("full")).distinct().unionByName(missed.select("bundle_id", F.lit(False).alias("full")).distinct())
    arm = lambda df, x: df.select("bundle_id", *(F.col(c).alias(f"{c}_{x}") for c in ("f1", "tp", "fp", "fn")))
    rows = arm(before, "a").join(arm(after, "b"), "bundle_id").join(roles, "bundle_id")
    full = F.col("full")
    pooled = lambda x: F.when(F.sum(F.col(f"tp_{x}") + F.col(f"fp_{x}") + F.col(f"fn_{x}")) == 0, 1.0).otherwise(2 * F.sum(f"tp_{x}") / F.sum(2 * F.col(f"tp_{x}") + F.col(f"fp_{x}") + F.col(f"fn_{x}")))
    out = rows.agg(
        F.coalesce(F.bool_and(F.when(full, F.col("f1_a") == F.col("f1_b"))), F.lit(True)).alias("saturated_unchanged"),
        F.coalesce(F.bool_and(F.when(~full, F.col("f1_b") > F.col("f1_a"))), F.lit(False)).alias("every_miss_up"),
        F.coalesce(F.avg("f1_b") > F.avg("f1_a"), F.lit(False)).alias("macro_up"),
        F.coalesce(pooled("b") > pooled("a"), F.lit(False)).alias("micro_up"),
        F.lit(residual_positives > 0 or always_open).alias("residual_open"),
        F.count_if(F.col("f1_b") < F.col("f1_a")).alias("falls"),
    )
    return out.withColumn("ship", F.col("saturated_unchanged") & F.col("every_miss_up") & F.col("macro_up") & F.col("micro_up") & F.col("residual_open"))


def changed_bundles(one: DataFrame, two: DataFrame) -> DataFrame:
    """Bundles whose predicted boundaries(bundle_id, page_index) differ, with how many are only in either."""
    a, b = one.select("bundle_id", "page_index", F.lit(1).alias("a")).distinct(), two.select("bundle_id", "page_index", F.lit(1).alias("b")).distinct()
    differ = a.join(b, ["bundle_id", "page_index"], "full").where("a is null or b is null")
    return differ.groupBy("bundle_id").agg(F.count("a").alias("only_first"), F.count("b").alias("only_second"))


#: How far above a score the threshold that flags it lies (fixed value).
ABOVE = 1e-9


def best_threshold(rows: DataFrame, score: str, ok: str) -> DataFrame:
    """The threshold with the best F1 of finding errors (score below it, ``ok`` false); of equals the one with fewer flags.

    Thresholds lie just above each observed score: a score at ``threshold`` or above is accepted; counts by distinct score.
    """
    counted = rows.groupBy(score).agg(F.count_if(~F.col(ok)).alias("bad"), F.count_if(F.col(ok)).alias("good"))
    run = running(counted, score, ("bad", "good")).withColumns({"tp": F.col("below_bad") + F.col("bad"), "fp": F.col("below_good") + F.col("good")})
    total = counted.agg(F.sum("bad").alias("errors"), F.sum(F.col("bad") + F.col("good")).alias("n"))
    none = rows.sparkSession.createDataFrame([(None, 0, 0)], f"{score} double, tp long, fp long")
    grid = run.select(F.col(score).cast("double").alias(score), "tp", "fp").unionByName(none).join(F.broadcast(total), F.lit(True))  # one row
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("errors")
    f1 = F.when((F.col("tp") > 0), 2 * p * r / (p + r)).otherwise(0.0)
    scored = grid.withColumns({"f1": f1, "flagged": F.col("tp") + F.col("fp")})
    best = scored.agg(F.max_by(F.struct(F.coalesce(F.col(score), F.lit(0.0)).alias("at"), "flagged", "n", "tp", "f1"), F.struct("f1", (-F.col("flagged")).alias("few"))).alias("b"))
    return best.select(F.when(F.col("b.flagged") > 0, F.col("b.at") + ABOVE).otherwise(0.0).alias("threshold"), "b.flagged", "b.n", "b.tp", "b.f1")


def accepted_error(pages: DataFrame, threshold: float) -> DataFrame:
    """pages(cer, probability): the mean error of all scored pages and of those at or above the threshold, and how many are which."""
    known = F.col("probability").isNotNull()
    taken = known & (F.col("probability") >= threshold)
    return pages.agg(F.avg(F.when(known, F.col("cer"))).alias("cer_all"), F.avg(F.when(taken, F.col("cer"))).alias("cer_accepted"), F.count_if(taken).alias("accepted"), F.count_if(known).alias("scored"), F.count_if(~known).alias("unscored"))


def anchor_order(text: Column, anchors: list[str]) -> Column:
    """(hits, pairs, ordered) of anchors in a text: how many occur, and how many pairs of these in the given order."""
    at = F.filter(F.array(*(F.instr(text, a) for a in anchors)), lambda p: p > 0)
    ordered = F.aggregate(F.transform(at, lambda p, i: F.size(F.filter(F.slice(at, i + 2, len(anchors)), lambda q: q > p))), F.lit(0), lambda s, v: s + v)
    n = F.size(at)
    return F.struct(n.alias("hits"), (n * (n - 1) / 2).cast("int").alias("pairs"), ordered.alias("ordered"))


def chosen_bundles(scores: DataFrame, spare: int = 2) -> DataFrame:
    """Bundles by role: miss (F1 below 1), saturated (the first ``spare`` at 1, by id) and train (all others)."""
    full = scores.where("f1 >= 1").select("bundle_id").orderBy("bundle_id").limit(spare).withColumn("first", F.lit(True))
    return scores.join(full, "bundle_id", "left").select("bundle_id", F.when(F.col("f1") < 1, "miss").when(F.col("first"), "saturated").otherwise("train").alias("role"))


def shared_documents(roles: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents(bundle_id, document) that lie in train bundles and in others: has to be empty."""
    by = documents.join(roles, "bundle_id").groupBy("document").agg(F.bool_or(F.col("role") == "train").alias("train"), F.bool_or(F.col("role") != "train").alias("scored"))
    return by.where("train and scored").select("document")


def set_scores(gold: DataFrame, predicted: DataFrame, key: str, item: str) -> DataFrame:
    """Precision, recall and F1 of sets of items by key."""
    g, p = gold.select(key, item, F.lit(1).alias("g")).distinct(), predicted.select(key, item, F.lit(1).alias("p")).distinct()
    counted = g.join(p, [key, item], "full").groupBy(key).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count("g").alias("n_gold"), F.count("p").alias("n_pred"))
    precision, recall, f = prf(F.col("matched"), F.col("n_pred"), F.col("n_gold"))
    return counted.withColumns({"precision": precision, "recall": recall, "f1": f})


def flag_report(scored: DataFrame, threshold: float, lowest: int = 12) -> tuple[DataFrame, DataFrame]:
    """scored(group, item, probability): the flagged share by group, and the ``lowest`` items of all. Unscored items make it fail."""
    checked = scored.withColumn("probability", F.when(F.col("probability").isNull(), F.raise_error(F.lit("an item has no score"))).otherwise(F.col("probability")))
    share = checked.groupBy("group").agg(F.count("*").alias("n"), F.avg((F.col("probability") < threshold).cast("int")).alias("flagged"))
    return share, checked.orderBy("probability", "item").limit(lowest)
