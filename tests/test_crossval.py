"""All folds in one fit against separate fits in memory."""

import numpy as np
import pytest

from pagestream.operators import crossval as V
from pagestream.operators import metrics, model

NAMES = ("a", "b", "c")


def data(n=600, seed=3):
    r = np.random.default_rng(seed)
    x = np.stack([r.normal(5, 2, n), r.integers(0, 3, n).astype(float), np.full(n, 7.0)], 1)  # c never varies
    y = (r.random(n) < 1 / (1 + np.exp(-(0.9 * (x[:, 0] - 6) + 0.5 * x[:, 1] - 1)))).astype(int)
    return x, y, r.integers(0, 11, n)


def plain_fit(x, y, l2=1.0):
    """Newton in memory, many steps."""
    n, mean, std = len(y), x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1.0)
    z = np.append((x - mean) / std, np.ones((n, 1)), 1)
    w = np.where(y == 1, 1 / (2 * max(y.sum(), 1)), 1 / (2 * max(n - y.sum(), 1)))
    ridge, c = np.array([l2 / n] * x.shape[1] + [0.0]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ c))
        c -= np.linalg.solve((z * (p * (1 - p) * w)[:, None]).T @ z + np.diag(ridge + 1e-14), z.T @ ((p - y) * w) + ridge * c)
    return mean, std, c


@pytest.fixture(scope="module")
def fitted(spark):
    x, y, g = data()
    rows = spark.createDataFrame([(*map(float, r), int(t), f"g{k:02d}") for r, t, k in zip(x, y, g, strict=True)], "a double, b double, c double, y int, g string").repartition(4)
    dealt = V.group_folds(rows, "g")
    return x, y, g % 5, dealt, V.cross_validate(dealt, names=NAMES)


def test_equals_separate_fits(fitted):
    x, y, fold, _, got = fitted
    assert got.passes < 15 and got.rows == [*((fold != f).sum() for f in range(5)), len(y)]
    for f, w in enumerate([*got.folds, got.whole]):
        mean, std, c = plain_fit(x[fold != f], y[fold != f])
        assert np.allclose(w.mean, mean) and np.allclose(w.std, std)
        assert np.allclose([*w.weights, w.bias], c, atol=1e-7)


def test_reaches_what_gradient_steps_approach(spark, fitted):
    x, y, _, dealt, got = fitted
    slow = model.train(dealt.select(*NAMES, "y"), names=NAMES)
    assert np.allclose(slow.weights, got.whole.weights, atol=1e-3)
    assert V.loss(x, y, got.whole) <= V.loss(x, y, slow) + 1e-12


def test_groups_stay_in_one_fold_and_scores_are_out_of_fold(fitted):
    x, y, fold, dealt, got = fitted
    assert {(r["g"], r["fold"]) for r in dealt.select("g", "fold").distinct().collect()} == {(f"g{k:02d}", k % 5) for k in range(11)}
    rows = dealt.select("a", "b", "c", "y", "fold", got.score().alias("p")).collect()
    for r in rows[:50]:
        w = got.folds[r["fold"]]
        z = sum(c * (r[n] - m) / s for n, c, m, s in zip(NAMES, w.weights, w.mean, w.std, strict=True)) + w.bias
        assert abs(r["p"] - 1 / (1 + np.exp(-z))) < 1e-12
    out = V.out_of_fold(dealt, got).head()
    p, t = np.array([r["p"] for r in rows]), np.array([r["y"] for r in rows])
    wins = (p[t == 1][:, None] > p[t == 0]).mean() + 0.5 * (p[t == 1][:, None] == p[t == 0]).mean()
    assert abs(out["auroc"] - wins) < 1e-9 and out["n_pos"] == t.sum()
    few = V.out_of_fold(dealt, got, false_positives=5).head()
    assert few["false_positives"] <= 5 and few["threshold"] > out["threshold"]
    assert V.out_of_fold(dealt, got, false_positives=-1).head()["threshold"] is None


def test_one_class_and_no_rows(spark):
    schema = "a double, b double, c double, y int, fold int"
    one = V.cross_validate(spark.createDataFrame([(1.0, float(k), 0.0, 0, k % 2) for k in range(8)], schema), names=NAMES, folds=2)
    assert all(np.isfinite([*w.weights, w.bias]).all() for w in [*one.folds, one.whole])
    none = V.cross_validate(spark.createDataFrame([], schema), names=NAMES, folds=2)
    assert none.whole.weights == [0.0] * 3 and none.rows == [0, 0, 0]
    assert metrics.auroc(spark.createDataFrame([], "p double, y int"), "p", "y").head()["auroc"] is None
    assert V.cross_validate(spark.createDataFrame([], schema).select("*"), names=NAMES, folds=2).passes == 2
