"""Look-ahead scenarios: each row is (confidence, number, total); page indexes count up."""

import random

import pytest
from pyspark.sql import functions as F

import pyarrow as pa

from pagestream.operators.lookahead import Fold, SplitConfig, decide
from pagestream.streaming.lookahead import replay

N = None


def table(rows, first=0):
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table({"bundle_id": pa.array(["p"] * len(rows), pa.string()), "page_index": pa.array(range(first, first + len(rows)), pa.int32()), "confidence": pa.array(columns[0], pa.float64()), "page_num": pa.array(columns[1], pa.int32()), "page_total": pa.array(columns[2], pa.int32())})


def run(rows, confirm=None, step=1, **config):
    """Feeds ``step`` rows at a time."""
    fold, out = Fold(SplitConfig(**config), confirm), []
    for k in range(0, len(rows), step):
        out += fold.push(table(rows[k : k + step], k)).to_pylist()
        assert fold.waiting.num_rows <= fold.config.window
    out += fold.push(table([]), True).to_pylist()
    assert [x["page_index"] for x in out] == list(range(len(rows)))
    return [(x["page_index"], x["split"], x["reason"], x["confidence"]) for x in out]


def splits(rows, **config):
    return [x[0] for x in run(rows, **config) if x[1]]


def reason(rows, page):
    return run(rows)[page][2]


CASES = [
    ("insert rejected", [(N, 1, 5), (N, 2, 5), (0.7, N, N), (N, 4, 5)], [], {2: "old_sequence_continues"}),
    ("weak before strong", [(N, N, N), (0.5, N, N), (0.9, N, N), (N, N, N)], [2], {}),
    ("fallback up", [(N, N, N), (0.6, N, N)], [1], {1: "fallback_eager"}),
    ("fallback down", [(N, N, N), (0.5, N, N)], [], {1: "fallback_below"}),
    ("one-page neighbour", [(N, 1, 1), (0.6, 1, 1), (0.9, 1, 3), (N, 2, 3)], [1, 2], {}),
    ("consecutive", [(N, 1, 4), (N, 2, 4), (0.5, N, N), (0.6, 3, 4), (N, 4, 4)], [], {}),
    ("other total", [(N, 1, 1), (0.6, N, N), (N, 2, 5)], [1], {}),
    ("long gap", [(N, 1, N), (N, 2, N), *[(N, N, N)] * 4, (0.45, N, N), (N, N, N), (N, 3, N)], [6], {6: "implied_page_one"}),
    ("blank then resume", [(N, 1, 5), (N, 2, 5), (0.7, N, N), (N, N, N), (N, 3, 5)], [], {2: "old_sequence_continues"}),
    ("unnumbered split", [(N, 2, 2), (0.7, N, N), (0.45, 1, 3), (N, 2, 3), (N, 3, 3)], [1], {2: "continues_sequence"}),
    ("unnumbered misfit", [(N, 1, 1), (0.9, N, N), (0.45, 4, 8), (N, 5, 8), (N, 6, 8)], [1, 2], {2: "lookahead_numbering"}),
]


@pytest.mark.parametrize("name,rows,want,reasons", CASES, ids=[c[0] for c in CASES])
def test_scenarios(name, rows, want, reasons):
    assert splits(rows) == want
    for page, r in reasons.items():
        assert reason(rows, page) == r


@pytest.mark.parametrize("c", [0.4, 0.5, 0.55, 0.6, 0.8, 0.95])
@pytest.mark.parametrize("fallback", [0.55, 0.9])
def test_no_window_is_eager(c, fallback):
    assert splits([(N, N, N), (c, N, N)], window=0, fallback=fallback) == ([1] if c >= fallback else [])


def test_confirmer_settles_only_what_is_open():
    rows = [(N, N, N), (0.5, N, N), (0.9, N, N)]
    for verdict, r in ((True, "confirmed_split"), (False, "confirmed_continue"), (None, "fallback_below")):
        out = run(rows, confirm=lambda before, page, ahead: verdict)
        assert out[1][2] == r and out[2][2] == "high_confidence"


def random_pages(seed, bundles=12):
    r = random.Random(seed)
    return [(f"p{p}", i, r.choice([None, 0.3, 0.45, 0.6, 0.74, 0.9]), r.choice([None, 1, 2, 3, i + 1]), r.choice([None, 3, 5])) for p in range(bundles) for i in range(r.randrange(1, 40))]


def test_batch_equals_state_machine_equals_stream(spark, tmp_path):
    rows = random_pages(3)
    df = spark.createDataFrame(rows, "bundle_id string, page_index int, confidence double, page_num int, page_total int")
    want = []
    for p in sorted({x[0] for x in rows}):
        own = [x[2:] for x in rows if x[0] == p]
        assert run(own) == run(own, step=7) == run(own, step=1000)
    for p in sorted({x[0] for x in rows}):
        want += [(p, i, s, r) for i, s, r, _ in run([x[2:] for x in rows if x[0] == p])]
    key = lambda d: sorted((x.bundle_id, x.page_index, x.split, x.reason) for x in d.collect())
    assert key(decide(df.orderBy(F.rand(1)))) == sorted(want)
    assert key(replay(spark, df, str(tmp_path), cuts=(5, 11))) == sorted(want)


def test_replay_deals_a_range_to_all_tasks_and_shares_states(spark, tmp_path, monkeypatch):
    # 30 bundles in 4 states, null and odd names among them; each of the three ranges is written by several tasks.
    from pagestream.streaming import lookahead as stream

    monkeypatch.setattr(stream, "BUCKET_BUNDLES", 8)
    rows = [(None if b == 7 else f"b{b}", i, [None, 0.5, 0.6, 0.9][(b + i) % 4] if i else None, (i % 4) + 1 if (b * i) % 5 else None, 4 if i % 2 else None) for b in range(30) for i in range(b + 1)]
    df = spark.createDataFrame(rows, stream.PAGE_SCHEMA)
    key = lambda out: sorted((r.bundle_id or "", r.page_index, r.split, r.reason, r.confidence) for r in out.collect())
    got = key(replay(spark, df, str(tmp_path)))
    assert len(list((tmp_path / "pages").glob("*.parquet"))) > 3
    assert got == key(decide(df)) and len(got) == len(rows)


def test_event_log_counts_events_instead_of_sorting_them(spark):
    from pagestream.plans.queries import QUERIES

    plan = QUERIES["event_log"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Lines and orders meet, bundles are dealt once before the look-ahead and once after it; nothing is sorted behind the listing of events.
    assert plan.count("REPARTITION_BY_NUM") == 2 and "Sort " not in plan[: plan.index("Generate")]
