"""Boundary scores, gates, sweeps, ranks and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boundaries(ranges: DataFrame) -> DataFrame:
    """The last page of every document but a bundle's last."""
    w = Window.partitionBy("bundle_id").orderBy("page_start")
    return ranges.withColumn("next", F.lead("page_start").over(w)).where("next is not null").select("bundle_id", F.col("page_end").alias("page_index"))


def marks(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each boundary as tp, fp or fn."""
    g, p = gold.select("bundle_id", "page_index", F.lit(1).alias("g")), predicted.select("bundle_id", "page_index", F.lit(1).alias("p"))
    mark = F.when(F.col("g").isNull(), "fp").when(F.col("p").isNull(), "fn").otherwise("tp")
    return g.join(p, ["bundle_id", "page_index"], "full").select("bundle_id", "page_index", mark.alias("mark"))


def prf(tp: Column, n_pred: Column, n_gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; all 1 if there is nothing to find and nothing found."""
    none = (n_pred == 0) & (n_gold == 0)
    p = F.when(none, 1.0).when(n_pred == 0, 0.0).otherwise(tp / n_pred)
    r = F.when(none, 1.0).when(n_gold == 0, 0.0).otherwise(tp / n_gold)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def boundary_scores(bundles: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row a bundle of ``bundles``: counts and scores."""
    count = lambda m: F.coalesce(F.sum(F.when(F.col("mark") == m, 1)), F.lit(0))
    counted = marks(gold, predicted).groupBy("bundle_id").agg(count("tp").alias("tp"), count("fp").alias("fp"), count("fn").alias("fn"))
    rows = bundles.select("bundle_id").distinct().join(counted, "bundle_id", "left").na.fill(0, ["tp", "fp", "fn"])
    p, r, f = prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return rows.withColumns({"precision": p, "recall": r, "f1": f})


def flagged_scores(pages: DataFrame, gold: str, predicted: str) -> DataFrame:
    """The same from pages that carry both sides' starts as flags: one aggregation, no joins."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g, p = F.col(gold), F.col(predicted)
    rows = pages.groupBy("bundle_id").agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"))
    precision, recall, f = prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return rows.withColumns({"precision": precision, "recall": recall, "f1": f})


def gate(scores: DataFrame, bundle_floor: float, macro_floor: float) -> DataFrame:
    """One row: macro and micro scores, bundles under the floor, and whether the gate is passed. NaN fails."""
    low = F.col("f1").isNull() | F.isnan("f1") | (F.col("f1") < bundle_floor)
    out = scores.agg(F.count("*").alias("bundles"), F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if(low).alias("failed"))
    p, r, f = prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"micro_precision": p, "micro_recall": r, "micro_f1": f}).withColumn("passed", (F.col("bundles") > 0) & (F.col("failed") == 0) & F.coalesce(~F.isnan("macro_f1") & (F.col("macro_f1") >= macro_floor), F.lit(False)))


def running(counted: DataFrame, key: str, values: tuple[str, ...], parts: int = 200) -> DataFrame:
    """``counted`` (one row a key) with below_<value>, the sum over all smaller keys (nulls first).

    Keys are cut at approximate quantiles, so that no task orders them all: sums of the parts before, then within.
    """
    cuts = counted.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000).alias("_cuts"))  # one row
    dealt = counted.join(F.broadcast(cuts), F.lit(True)).withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(key))), F.lit(0))).drop("_cuts")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a part
    sums = dealt.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values))
    earlier = sums.select("_part", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"below_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    return own.join(F.broadcast(earlier), "_part").withColumns({f"below_{v}": F.col(f"below_{v}") + F.col(f"_{v}") for v in values}).drop("_part", *(f"_{v}" for v in values))


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties half: counts by distinct score, so that no task ranks all rows."""
    by_score = rows.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"))
    ranked = running(by_score, score, ("neg",))
    total = ranked.agg(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") * 0.5)).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return total.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def sweep(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold, in one pass: the thresholds a score reaches are a prefix of the list."""
    grid = sorted(thresholds)
    reached = F.explode(F.array_compact(F.array(*(F.when(F.col(score) >= t, F.lit(t)) for t in grid))))
    hits = rows.select(reached.alias("threshold"), label).groupBy("threshold").agg(F.count("*").alias("n_pred"), F.sum(label).alias("tp"))
    gold = rows.agg(F.sum(label).alias("n_gold"))
    every = rows.sparkSession.createDataFrame([(float(t),) for t in grid], "threshold double")
    joined = every.join(hits, "threshold", "left").na.fill(0, ["n_pred", "tp"]).join(F.broadcast(gold), F.lit(True))  # one row
    p, r, f = prf(F.col("tp"), F.col("n_pred"), F.col("n_gold"))
    return joined.withColumns({"precision": p, "recall": r, "f1": f})


def nearest_rank(values: Column, q: float) -> Column:
    """The nearest-rank percentile of an array."""
    ordered = F.sort_array(values)
    return F.try_element_at(ordered, F.greatest(F.ceil(F.lit(q) * F.size(ordered)), F.lit(1)).cast("int"))
