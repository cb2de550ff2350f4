import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagestream.llm import hard_negatives as H
from pagestream.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, every, positives=5, negatives=10, low=30, high=90, scale=256):
    """rows (id, vector, label): as the contract says, with all pairs."""
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {(i, tuple(v), label) for i, v, label in good if i % every == 0}:
        scored = [(-sum(x * y for x, y in zip(a[1], v, strict=False)), i, label) for i, v, label in good]
        near = sorted((s, i) for s, i, label in scored if label == a[2] and i != a[0])[:positives]
        for s, i in near:
            fit = sorted((t, j) for t, j, label in scored if label != a[2] and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(a[0], i, r, j, -s, -t) for r, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def mined(spark, rows, every=4):
    df = spark.createDataFrame([(i, v, label, 0.0) for i, v, label in rows], SCHEMA).repartition(3)
    return result(H.hard_negatives(df, anchors=F.col("vec_id") % every == 0))


def vectors(seed, n, width=6):
    r = random.Random(seed)
    centers = [[r.gauss(0, 0.5) for _ in range(width)] for _ in range(6)]
    return [(k, [x + r.gauss(0, 0.2) for x in r.choice(centers)], r.randrange(4)) for k in range(n)]


@pytest.mark.parametrize(("seed", "block", "rounds"), [(1, 7, (1, 3, None)), (2, 8192, H.ROUNDS), (3, 3, (None,))])
def test_equals_brute_force(spark, monkeypatch, seed, block, rounds):
    monkeypatch.setattr(H, "LIST_ROWS", block)
    monkeypatch.setattr(H, "ROUNDS", rounds)
    rows = vectors(seed, 260)
    hot = rows[5][1]
    rows += [(1000 + k, hot, k % 3) for k in range(120)]  # one vector of a third of all rows: ties everywhere
    want = brute(rows, 20)
    assert len(want) > 300 and mined(spark, rows, 20) == want


def test_nulls_repeats_and_unequal_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(9, 60, 3) + [(None, [1.0, 1.0, 1.0], 1), (200, None, 1), (204, [1.0, None, 0.0], 1), (208, [nan, 1.0, 1.0], 1), (212, [1.0, inf, -inf], 2), (216, [1.0, 1.0, 1.0], None), (220, [], 1), (224, [0.5, 0.5], 2), (228, [0.5, 0.4, 0.3, 9.0], 1)]
    rows += rows[:6] + [(4, [0.9, 0.1, 0.2], 0), (4, [0.9, 0.1, 0.2], 0)]
    want = brute(rows, 4)
    assert want and mined(spark, rows) == want


def test_large_components(spark):
    rows = [(k, [3e5 * (k % 7 - 3), 2e5 * (k % 5), 1e5 + k], k % 3) for k in range(50)]  # products beyond 2**53
    want = brute(rows, 4)
    assert any(abs(x[5]) > 2**53 for x in want) and mined(spark, rows) == want
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(k, [1e30, 1.0], k % 2) for k in range(8)])


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []
    assert mined(spark, [(0, [1.0], 1), (4, [1.0], 1)]) == []


def test_bounds_hold_and_far_lists_are_skipped():
    r = np.random.default_rng(4)
    centers = r.normal(0, 60, (12, 8))
    rows = np.concatenate([np.round(c + r.normal(0, 2, (50, 8))) for c in centers]).astype(np.int64)
    near = H.nearest(rows.astype(float), centers)
    radius = np.array([np.sqrt(((rows[near == k] - centers[k]) ** 2).sum(1)).max() for k in range(12)])
    shape = H.Shape(centers, radius, np.ones(12, np.int64), 8)
    anchors = rows[::60]
    lower, upper = shape.bounds(anchors)
    score = H.products(anchors, rows)
    for k in range(12):
        own = score[:, near == k]
        assert (own <= upper[:, [k]]).all() and (own >= lower[:, [k]]).all()
    kth = np.sort(score, 1)[:, -5]
    frame = pd.DataFrame({"anchor": np.arange(len(anchors)), "slot": 0, "id": 0, "label": 0, "vector": [a.astype("<i8").tobytes() for a in anchors], "low": H.LEAST, "high": H.MOST, "kth": kth})
    visits = pd.concat(H._visit(shape, None, 0)(iter([frame])))
    met = {(a, c) for c, blob in zip(visits["cluster"], visits["anchor"], strict=True) for a in np.frombuffer(blob, "<i8").tolist()}
    needed = {(a, int(near[k])) for a in range(len(anchors)) for k in np.flatnonzero(score[a] >= kth[a])}
    assert needed <= met and len(met) < len(anchors) * 12 / 3


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows], 100)
    assert want and result(op11_hard_negatives(spark, sf)) == want


def sent_to_driver(spark, work):
    """Bytes of task results that reach the driver while ``work`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        listed = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {s.stageId(): s.resultSize() for s in (listed.apply(k) for k in range(listed.size()))}

    before = stages()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_the_sample_does_not_reach_the_driver_once_a_task(spark):
    # 40 tasks of 500 rows each, and a sample of 500: the driver gets no more than a few samples' worth.
    r = np.random.default_rng(4)
    rows = [(k, k % 3, r.integers(-200, 200, 64).astype("<i8").tobytes(), 64) for k in range(20_000)]
    df = spark.createDataFrame(rows, "id long, label long, vector binary, width int").repartition(40).persist()
    df.count()
    assert sent_to_driver(spark, lambda: H.Index(df, 500)) < 3 * 500 * 600
    few = H.sampled(df, 20_000, 500).collect()
    assert len(few) == 500 == len({bytes(x.vector) for x in few})
    df.unpersist()
