"""Boundary features and the logistic scorer."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators.boundary import topic_dots, with_previous
from pagestream.shipping import ship
from pagestream.sources.adapters import size_jump

# --- fixed values: the features' names in their order, and the patterns behind them ---
FEATURES = ("has_num", "num_is_one", "has_total", "prev_has_num", "arxiv_stamp", "title_top", "title_lower", "log_words", "prev_log_words", "head_abstract", "head_intro", "head_affil", "prev_refs", "media_jump", "lang_change", "topic_sim")
ARXIV = r"(?i)arxiv:\s*\d{4}\.\d{4,5}"
AFFILIATION = r"(?i)universit|institut|department|laborator|@|college|school of"
REFERENCES = r"(?im)^\s*(references|bibliography)\b"
HEAD_CHARS, SCHEMA_VERSION = 600, 1
# --- end of fixed values ---
#: Training rows up to which the gradient is taken on the driver; beyond, tasks sum it.
DRIVER_ROWS = 100_000


def features(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """pages(bundle_id, page_index, page_num, page_total, title, text, width, height, rotation) to FEATURES; a bundle's first page has none.

    What texts tell is taken first, so that only short columns meet their neighbours; ``tasks``: see ``topic_dots``.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    head = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS))
    told = {
        "guess": T.detect_language(F.col("text")),
        "arxiv_stamp": flag(F.col("text").rlike(ARXIV)),
        "head_abstract": flag(head.contains("abstract")),
        "head_intro": flag(head.contains("introduction")),
        "head_affil": flag(head.rlike(AFFILIATION)),
        "refs": F.col("text").rlike(REFERENCES),
    }
    rows = with_previous(topic_dots(pages.withColumns(told), tasks), ("page_num", "refs", "guess", "n_words", "norm", "width", "height", "rotation"))
    both = (F.col("n_words") > 0) & (F.col("prev_n_words") > 0)
    made = {
        "has_num": flag(F.col("page_num").isNotNull()),
        "num_is_one": flag(F.col("page_num") == 1),
        "has_total": flag(F.col("page_total").isNotNull()),
        "prev_has_num": flag(F.col("prev_page_num").isNotNull()),
        "title_top": flag(F.col("title") == "top"),
        "title_lower": flag(F.col("title") == "lower"),
        "log_words": F.log1p("n_words"),
        "prev_log_words": F.log1p(F.coalesce("prev_n_words", F.lit(0))),
        "prev_refs": flag(F.col("prev_refs")),
        "media_jump": flag(size_jump()),
        "lang_change": flag(~T.same_language(F.col("prev_guess"), F.col("guess"))),
        "topic_sim": F.when(both, F.when((F.col("norm") > 0) & (F.col("prev_norm") > 0), F.col("dot1") / F.sqrt(F.col("norm").cast("double") * F.col("prev_norm"))).otherwise(0.0)).otherwise(1.0),
    }
    return rows.where("page_index > 0").select("bundle_id", "page_index", *(made.get(f, F.col(f)).alias(f) for f in FEATURES))


@dataclass
class Weights:
    mean: list[float]
    std: list[float]
    weights: list[float]
    bias: float
    feature_names: tuple[str, ...] = FEATURES

    def to_json(self) -> str:
        return json.dumps({"schema_version": SCHEMA_VERSION, "feature_names": list(self.feature_names), "mean": self.mean, "std": self.std, "weights": self.weights, "bias": self.bias})

    @classmethod
    def from_json(cls, raw: str, names: tuple[str, ...] = FEATURES) -> Weights:
        """Strict: version, names, lengths, finite numbers, positive deviations."""
        got = json.loads(raw)
        if not isinstance(got, dict) or got.get("schema_version") != SCHEMA_VERSION or tuple(got.get("feature_names", ())) != names:
            raise ValueError("not a weights file for these features")
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
        for k in ("mean", "std", "weights"):
            if not isinstance(got.get(k), list) or len(got[k]) != len(names) or not all(map(number, got[k])):
                raise ValueError(f"{k} has to hold {len(names)} finite numbers")
        if not number(got.get("bias")) or min(got["std"]) <= 0:
            raise ValueError("the bias has to be finite and deviations positive")
        return cls(got["mean"], got["std"], got["weights"], float(got["bias"]), names)


def probability(w: Weights) -> Column:
    """The logistic score of the feature columns, without overflow."""
    z = F.lit(float(w.bias))
    for name, m, s, c in zip(w.feature_names, w.mean, w.std, w.weights, strict=True):
        z = z + F.lit(float(c)) * (F.col(name) - F.lit(float(m))) / F.lit(float(s))
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def train(rows: DataFrame, label: str = "y", names: tuple[str, ...] = FEATURES, l2: float = 1.0, epochs: int = 3000, rate: float = 0.2) -> Weights:
    """Batch gradient descent on standardised features with balanced classes and a ridge on all but the bias.

    Equal rows are counted together first.  Up to ``DRIVER_ROWS`` of them train
    on the driver; more stay in the tasks, which sum the gradient each epoch.
    """
    x = rows.groupBy(*names, label).agg(F.count("*").cast("double").alias("n")).cache()
    moments = x.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("pos"), *(F.sum(F.col(c) * F.col("n")).alias(f"s_{c}") for c in names)).head()
    k = len(names)
    if not moments["rows"]:
        return Weights([0.0] * k, [1.0] * k, [0.0] * k, 0.0, tuple(names))
    total, pos = moments["n"], moments["pos"] or 0.0
    mean = np.array([moments[f"s_{c}"] / total for c in names])
    squares = x.agg(*(F.sum((F.col(c) - float(m)) ** 2 * F.col("n")).alias(c) for c, m in zip(names, mean, strict=True))).head()
    std = np.array([math.sqrt(squares[c] / total) or 1.0 for c in names])
    weight = {1: total / (2 * (pos or 1)), 0: total / (2 * max(total - pos, 1))}

    def gradient(z: np.ndarray, y: np.ndarray, n: np.ndarray, coef: np.ndarray, bias: float) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(bias + z @ coef, -500, 500)))
        e = (p - y) * np.where(y == 1, weight[1], weight[0]) * n / total
        return np.append(z.T @ e, e.sum())

    coef, bias = np.zeros(k), 0.0
    if moments["rows"] <= DRIVER_ROWS:
        held = x.toPandas()
        z, y, n = (held[list(names)].to_numpy(float) - mean) / std, held[label].to_numpy(), held["n"].to_numpy(float)
        step = lambda: gradient(z, y, n, coef, bias)
    else:
        ship(rows.sparkSession)

        def step() -> np.ndarray:
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                g = np.zeros(k + 1)
                for b in batches:
                    z = (np.stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(k)], 1).astype(float) - mean) / std
                    g += gradient(z, b.column(k).to_numpy(zero_copy_only=False), b.column(k + 1).to_numpy(zero_copy_only=False), coef, bias)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in g], names=[f"g{j}" for j in range(k + 1)])

            parts = x.select(*names, label, "n").mapInArrow(work, ", ".join(f"g{j} double" for j in range(k + 1)))
            return np.array(parts.agg(*(F.sum(f"g{j}") for j in range(k + 1))).head())

    for _ in range(epochs):
        g = step()
        coef, bias = coef - rate * (g[:k] + l2 * coef / total), bias - rate * g[k]
    x.unpersist()
    return Weights(mean.tolist(), std.tolist(), coef.tolist(), float(bias), tuple(names))
