"""Grouped cross-validation of the logistic scorer: the models of all folds, and of all rows, fitted together.

The loss is that of ``model.train`` (standardised features, balanced classes,
ridge on all but the bias), minimised by Newton's method instead of thousands of
gradient steps.  A pass over the rows gives each model's gradient and curvature
as sums over the folds it may see; tasks sum them, so that the driver gets as
many numbers as models have coefficients, however many rows there are.  Two
passes for moments and at most ``steps`` for all models together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestream.operators import metrics
from pagestream.operators.model import FEATURES, Weights
from pagestream.shipping import ship

#: The most a coefficient moves in a step, and the step below which a fit is done.
FARTHEST, DONE = 8.0, 1e-10


def group_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``rows`` with ``fold``: groups in their order are dealt to folds in turn.  The window orders one row a group."""
    place = F.row_number().over(Window.orderBy(group)) - 1
    dealt = rows.select(group).distinct().withColumn("fold", (place % folds).cast("int"))
    return rows.join(dealt.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


@dataclass(frozen=True)
class CrossValidation:
    """``folds[f]`` was fitted without fold f, ``whole`` on all rows."""

    folds: list[Weights]
    whole: Weights
    rows: list[int]
    passes: int

    def score(self, fold: Column | str = "fold") -> Column:
        """The probability of a row by the model that hasn't seen its fold."""
        fold = F.col(fold) if isinstance(fold, str) else fold
        pick = lambda values: F.get(F.array(*(F.lit(float(v)) for v in values)), fold)
        z = pick([w.bias for w in self.folds])
        for j, name in enumerate(self.whole.feature_names):
            z = z + pick([w.weights[j] / w.std[j] for w in self.folds]) * (F.col(name) - pick([w.mean[j] for w in self.folds]))
        return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def _moments(rows: DataFrame, label: str, names: tuple[str, ...], folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, positives, means, deviations) of what each model sees; the last model sees all."""
    sums = rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"), *(F.sum(c).alias(f"s{j}") for j, c in enumerate(names))).collect()
    part = np.zeros((folds, 2 + len(names)))
    for r in sums:
        part[r["fold"]] = [r["n"], r["pos"], *(r[f"s{j}"] for j in range(len(names)))]
    seen = lambda x: np.concatenate([x.sum(0) - x, x.sum(0, keepdims=True)])
    total = seen(part)
    n, pos = total[:, 0], total[:, 1]
    mean = total[:, 2:] / np.maximum(n, 1)[:, None]
    center = mean[-1]  # squares about one center for all, moved to each model's mean below
    squares = rows.groupBy("fold").agg(*(F.sum((F.col(c) - float(m)) ** 2).alias(f"q{j}") for j, (c, m) in enumerate(zip(names, center, strict=True)))).collect()
    own = np.zeros((folds, len(names)))
    for r in squares:
        own[r["fold"]] = [r[f"q{j}"] for j in range(len(names))]
    variance = np.maximum(seen(own) / np.maximum(n, 1)[:, None] - (mean - center) ** 2, 0)
    std = np.where(variance > 1e-18 * np.maximum(1, center**2), np.sqrt(variance), 1.0)
    return n, pos, mean, std


def _sums(names: tuple[str, ...], label: str, coef: np.ndarray, mean: np.ndarray, std: np.ndarray, weight: np.ndarray):
    """Each task's gradients and curvatures of all models, as (slot, value) rows; the last coefficient is the bias."""
    models, k = coef.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, k + k * k))
        for b in batches:
            x = np.stack([b.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(k - 1)], 1)
            y, fold = b.column(k - 1).to_numpy(zero_copy_only=False).astype(int), b.column(k).to_numpy(zero_copy_only=False)
            for m in range(models):
                mine = fold != m
                z = np.append((x[mine] - mean[m]) / std[m], np.ones((int(mine.sum()), 1)), 1)
                p = 1 / (1 + np.exp(-np.clip(z @ coef[m], -500, 500)))
                w = weight[m][y[mine]]
                total[m, :k] += z.T @ ((p - y[mine]) * w)
                total[m, k:] += ((z * (p * (1 - p) * w)[:, None]).T @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

    return work


def cross_validate(rows: DataFrame, label: str = "y", names: tuple[str, ...] = FEATURES, folds: int = 5, l2: float = 1.0, steps: int = 12) -> CrossValidation:
    """rows(``names``, ``label`` 0 or 1, fold 0..folds-1).  A model without rows has weights of zero."""
    ship(rows.sparkSession)
    packed = rows.select(*(F.col(c).cast("double").alias(c) for c in names), F.col(label).cast("int").alias(label), F.col("fold").cast("int").alias("fold")).persist()
    try:
        n, pos, mean, std = _moments(packed, label, names, folds)
        models, k = folds + 1, len(names) + 1
        weight = np.stack([1 / (2 * np.maximum(n - pos, 1)), 1 / (2 * np.maximum(pos, 1))], 1)  # of a row of class 0 and 1, over n
        coef, passes, moving = np.zeros((models, k)), 2, n > 0
        ridge = np.append(np.full(k - 1, 1.0), 0.0) * l2
        while moving.any() and passes - 2 < steps:
            made = packed.mapInArrow(_sums(names, label, coef, mean, std, weight), "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
            flat = np.zeros(models * (k + k * k))
            for r in made:
                flat[r["slot"]] = r["value"]
            flat = flat.reshape(models, -1)
            passes += 1
            for m in np.flatnonzero(moving):
                slope = flat[m, :k] + ridge * coef[m] / n[m]
                curve = flat[m, k:].reshape(k, k) + np.diag(ridge / n[m]) + 1e-12 * np.eye(k)
                step = np.linalg.solve(curve, slope)
                step *= min(1.0, FARTHEST / max(float(np.abs(step).max()), 1e-300))
                coef[m] -= step
                moving[m] = np.abs(step).max() > DONE
        made = [Weights(mean[m].tolist(), std[m].tolist(), coef[m, :-1].tolist(), float(coef[m, -1]), tuple(names)) for m in range(models)]
        return CrossValidation(made[:-1], made[-1], [int(v) for v in n], passes)
    finally:
        packed.unpersist()


def loss(rows: np.ndarray, y: np.ndarray, w: Weights, l2: float = 1.0) -> float:
    """The loss of a fit over rows in memory, for comparison."""
    z = (rows - np.array(w.mean)) / np.array(w.std) @ np.array(w.weights) + w.bias
    pos = max(int(y.sum()), 1)
    each = np.logaddexp(0, np.where(y == 1, -z, z))
    return float((each * np.where(y == 1, 1 / (2 * pos), 1 / (2 * max(len(y) - int(y.sum()), 1)))).sum() + l2 * (np.array(w.weights) ** 2).sum() / (2 * len(y)))


def out_of_fold(rows: DataFrame, fitted: CrossValidation, label: str = "y", false_positives: int | None = None, grid: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.97, 0.99)) -> DataFrame:
    """One row: auroc of the out-of-fold scores, and the threshold of ``grid`` with the best F1 among those with at most ``false_positives``; of equals fewer of them, then the lower."""
    scored = rows.withColumn("p", fitted.score())
    swept = metrics.sweep(scored, "p", label, list(grid)).withColumn("false_positives", F.col("n_pred") - F.col("tp"))
    allowed = F.lit(True) if false_positives is None else F.col("false_positives") <= false_positives
    order = F.when(allowed, F.struct("f1", (-F.col("false_positives")).alias("few"), (-F.col("threshold")).alias("first")))
    best = swept.agg(F.max_by(F.struct("threshold", "f1", "false_positives"), order).alias("b"))
    area = metrics.auroc(scored, "p", label)
    return area.join(F.broadcast(best), F.lit(True)).select("n_pos", "n_neg", "auroc", "b.threshold", "b.f1", "b.false_positives")  # one row each
