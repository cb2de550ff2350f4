"""Flags, checks, matching, engines and loaders that SQL can't state, or only in part."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagestream import parse
from pagestream.functions import text as T
from pagestream.operators import assemble, boundary, decision, evaluation, recognition, review


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(
    "heading,want",
    [("1.01 Scope", (2, ["1", "01"], "1.01")), ("2024 Budget", None), ("100", None), ("Section 4.2. Fees", (2, ["4", "2"], "4.2")), ("Article IV", (1, None, "Article IV")), ("ARTICLE 4", (1, None, "ARTICLE 4")), ("Article IIII", None), ("Article 0", None), ("1.1\nmore", (2, ["1", "1"], "1.1")), ("1.1x", None), ("7", (1, ["7"], "7"))],
)
def test_numbering(spark, heading, want):
    got = one(spark, T.numbering(F.lit(heading)))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("text,want", [("score .7", 0.7), ("p 1", 1.0), ("confidence 1", None), ("0.3 per cent", None), ("is − 0.2", None), ("The probability is 0.62.", 0.62), ("0.62 or 0.7", None), ("1e-1", None), ("page 3", None), ("50 %", None), ("chance 0", 0.0)])
def test_sentence_probability(spark, text, want):
    assert one(spark, T.sentence_probability(F.lit(text))) == want


@pytest.mark.parametrize("config", [{"api-key": 1}, {"a": [{"APIKEY": 1}]}, {"base_url": "https://u:p@host/v1"}, {"base_url": "https://host/v1?Token=x"}])
def test_secrets_are_refused(config):
    with pytest.raises(ValueError):
        decision.reject_secrets(config)
    decision.reject_secrets({"base_url": "https://host/v1?model=x", "tokens": 5})


def test_rank_repair_moves_levels_and_page_ends(spark):
    rows = [("title", 0, "Doc", 0), ("heading", 1, "1 Scope", 0), ("heading", 1, "Notes", 1), ("heading", 1, "1.1 Parts", 2), ("paragraph", None, "x", 4), ("heading", 2, "2 End", 5)]
    blocks = spark.createDataFrame([("d", p, k, f"b{k}", kind, level, text) for k, (kind, level, text, p) in enumerate(rows)], "bundle_id string, page_index int, reading_order int, block_id string, kind string, heading_level int, text string")
    made = assemble.sections(blocks)
    got = {r.section_id: (r.level, r.parent_ord, r.page_end) for r in assemble.repaired_sections(made).collect()}
    # 1.1 goes from the title's children to 1's, whose end moves on; "2 End" gets its depth but stays below 1.1.
    assert got == {"b0-sec": (0, None, 5), "b1-sec": (1, 1, 5), "b2-sec": (1, 1, 1), "b3-sec": (2, 2, 5), "b5-sec": (1, 4, 5)}
    flags = assemble.repaired(made).collect()
    assert [(f.ref, f.to_id, f.numbering) for f in flags] == [("b3-sec", "b1-sec", "1.1")]


def brute_match(gold, predicted, tolerance):
    used, n = set(), 0
    for g in sorted(gold):
        near = [(abs(p - g), i) for i, p in enumerate(sorted(predicted)) if i not in used and abs(p - g) <= tolerance]
        if near:
            used.add(min(near)[1])
            n += 1
    return n


def test_tolerant_match(spark):
    r = random.Random(4)
    gold = {f"p{k}": r.sample(range(30), r.randrange(0, 8)) for k in range(20)}
    predicted = {k: r.sample(range(30), r.randrange(0, 8)) for k in gold}
    frame = lambda d: spark.createDataFrame([(k, x) for k, v in d.items() for x in v], "bundle_id string, page_index int")
    for tolerance in (0, 1, 3):
        got = {x.bundle_id: (x.matched, x.n_gold, x.n_pred) for x in evaluation.tolerant_scores(frame(gold), frame(predicted), tolerance).collect()}
        assert got == {k: (brute_match(gold[k], predicted[k], tolerance), len(gold[k]), len(predicted[k])) for k in gold if gold[k] or predicted[k]}


def test_tolerant_match_of_dense_islands_and_repeated_rows(spark):
    r = random.Random(8)
    gold = {f"p{k}": r.sample(range(400), r.choice([0, 5, 60, 200])) for k in range(12)} | {"gold only": [3], "long": list(range(0, 60000, 2))}
    predicted = {k: r.sample(range(400), r.choice([0, 5, 60, 200])) for k in gold} | {"predicted only": [4, 9], "gold only": [], "long": list(range(1, 60001, 2))}
    rows = lambda d: [(k, x) for k, v in d.items() for x in v]
    frame = lambda d: spark.createDataFrame(rows(d) + rows(d)[:40] + [("p0", None)], "bundle_id string, page_index int").repartition(3)
    for tolerance in (1, 2, 5):
        got = {x.bundle_id: (x.matched, x.n_gold, x.n_pred) for x in evaluation.tolerant_scores(frame(gold), frame(predicted), tolerance).collect()}
        assert got.pop("long") == (30000, 30000, 30000)
        want = {k: (brute_match(gold.get(k, []), predicted.get(k, []), tolerance), len(gold.get(k, [])), len(predicted.get(k, []))) for k in (gold | predicted).keys() - {"long"}}
        assert got == {k: v for k, v in want.items() if v[1] + v[2]}
    empty = frame({}).where("false")
    assert evaluation.tolerant_scores(empty, empty, 2).collect() == []


def test_header_template_and_dropped_heads(spark):
    rows = []

    def page(bundle, index, *blocks):
        rows.extend((bundle, index, k, kind, text, layout, band, small, size, top) for k, (kind, text, layout, band, small, size, top) in enumerate(blocks))

    head = lambda text, size=8.0, top=20.0: ("header", text, True, "top", True, size, top)
    body = ("paragraph", "text", True, None, False, 11.0, 100.0)
    title = ("title", "Chapter", True, None, False, 20.0, 90.0)
    page("same", 0, head("one"), body)
    page("same", 1, head("two"), body)  # another text, the same template
    page("other", 0, head("one"), body)
    page("other", 1, head("two", size=10.0), body)
    page("dropped", 0, head("one"), body)
    page("dropped", 1, title, body)  # a chapter opener drops its head
    page("insert", 0, head("one"), body)
    page("insert", 1, body)
    blocks = spark.createDataFrame(rows, "bundle_id string, page_index int, reading_order int, kind string, text string, layout boolean, band string, small boolean, size double, top double")
    pages = blocks.select("bundle_id", "page_index", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("rotation")).distinct()
    got = {(x.bundle_id, x.page_index): (x.header_changed, x.title_top) for x in boundary.head_signals(pages, blocks).collect()}
    assert [got[k, 1] for k in ("same", "other", "dropped", "insert")] == [(False, False), (True, False), (False, True), (True, False)]


def test_parse_gives_flags_and_events(spark):
    text = lambda d, k, n: f"Office {d}\nsome body of document {d} page {k}\nPage {k} of {n}"
    pages = [("b", i, text(d, k, n)) for i, (d, k, n) in enumerate([("A", 1, 3), ("A", 2, 3), ("A", 3, 3), ("B", 1, 2), ("B", 2, 2)])]
    out = parse(spark.createDataFrame(pages, "bundle_id string, page_index int, text string"))
    assert [(r.page_start, r.page_end) for r in out.documents.orderBy("doc_index").collect()] == [(0, 2), (3, 4)]
    events = out.events.orderBy("seq").collect()
    assert [e.kind for e in events][:2] == ["page_classified", "block_emitted"] and events[-1].kind == "bundle_closed"
    assert sum(e.kind == "boundary_decided" for e in events) == 5 and sum(e.kind == "boundary_proposed" for e in events) == 1
    assert out.flags.collect() == []


def test_recognition_cache_is_written_by_file_and_resumed(spark, tmp_path):
    record = lambda sha, page, raw: (sha, page, json.dumps({"schema": 1, "pdf_sha256": sha, "page": page, "raw": raw, "engine": "e"}))
    schema = "sha string, page int, record string"
    recognition.write_records(spark.createDataFrame([record("a", 0, "x"), record("b", 0, "x")], schema), str(tmp_path))
    recognition.write_records(spark.createDataFrame([record("b", 0, "y"), record("b", 1, "y")], schema), str(tmp_path))
    stored = spark.read.parquet(str(tmp_path)).select("sha", "page", "record")
    assert sorted((r.sha, r.page, json.loads(r.record)["raw"]) for r in stored.collect()) == [("a", 0, "x"), ("b", 0, "y"), ("b", 1, "y")]
    plan = spark.createDataFrame([("a", 0), ("b", 0), ("b", 2)], "sha string, page int")
    stated = recognition.with_state(plan, stored, "e")
    assert [(r.sha, r.page) for r in recognition.work_plan(stated).collect()] == [("b", 2)]
    assert recognition.work_plan(recognition.with_state(plan, stored, "f")).count() == 3


def test_loaders(spark, tmp_path):
    (tmp_path / "labels.jsonl").write_text('{"file_name": "x.pdf", "sub_documents": [{"start_page": 1, "end_page": 2, "identifier": "T1"}, {"start_page": 3, "end_page": 3, "type": "form"}, {"start_page": 4, "end_page": 4}]}\n')
    got = [tuple(r) for r in recognition.annotations(spark, str(tmp_path / "labels.jsonl")).orderBy("doc_index").collect()]
    assert got == [("x", 0, 0, 1, "T1"), ("x", 1, 2, 2, "form"), ("x", 2, 3, 3, "doc-2")]
    (tmp_path / "catalog.jsonl").write_text('{"split": "a", "doc_name": "d", "page_no": 2, "image": "i2"}\n{"split": "a", "doc_name": "d", "page_no": 1, "image": "i1"}\n')
    assert [[p.image for p in r.pages] for r in recognition.catalog(spark, str(tmp_path / "catalog.jsonl")).collect()] == [["i1", "i2"]]
    (tmp_path / "log.jsonl").write_text('{"k": "a"}\n{"k": "b"}\n{"k": "c')
    assert sorted(r.k for r in recognition.done_keys(spark, str(tmp_path / "log.jsonl"), "k").collect()) == ["a", "b"]
    (tmp_path / "bad.jsonl").write_text('{"k": "a"}\n{"k": \n{"k": "c"}\n')
    with pytest.raises(Exception):
        recognition.done_keys(spark, str(tmp_path / "bad.jsonl"), "k").collect()


def test_small_helpers():
    assert recognition.choose_engine("off", {"mlx"}) is None and recognition.choose_engine("auto", set()) is None and recognition.choose_engine("on", {"paddle", "mlx"}) == "mlx"
    for bad in (("on", set()), ("mlx", set()), ("best", {"mlx"})):
        with pytest.raises(ValueError):
            recognition.choose_engine(*bad)
    assert recognition.first_key_json('{"a": 1, "a": 2}') == {"a": 1}
    assert recognition.first_key_json('```json\n{"a": 1}\n```') == {"a": 1}
    page = {"footer": "f", "title": "T", "header": " None ", "body_text": ["a", None, {"k": 1, "l": "n/a"}], "tables": [], "page_number": 3, "other": "x"}
    assert recognition.json_markdown(page) == "# T\n\na\n\n\n\nk: 1\nl: \n\nf\n\n3"
    assert recognition.json_markdown({"title": "empty"}) == "" and recognition.json_markdown([1]) == ""
    assert recognition.drain(iter("ab" * 100), lambda t: len(t) > 100, 1000) == ("ab" * 64, "loop")
    assert recognition.drain(iter("abc"), lambda t: True, 1000) == ("abc", "eos") and recognition.drain(iter("abc"), lambda t: True, 2) == ("ab", "max_tokens")


def test_flag_report_refuses_unscored_items(spark):
    rows = spark.createDataFrame([("g", f"i{k}", k / 10) for k in range(10)], "group string, item string, probability double")
    share, low = evaluation.flag_report(rows, 0.35, 3)
    assert share.head().flagged == 0.4 and [r.item for r in low.collect()] == ["i0", "i1", "i2"]
    with pytest.raises(Exception):
        evaluation.flag_report(rows.withColumn("probability", F.when(F.col("item") != "i3", F.col("probability"))), 0.35)[0].collect()


def test_references_in_texts_and_cells(spark):
    rows = spark.createDataFrame([(0, "caf&eacute; &#8217;x &amp;lt; <b>y</b>"), (1, "<td>a &amp; b</td><th>\u001e<i>c</i>&nbsp;&lt;d&gt;</th><td></td>\n| e &amp; f | :-: ||"), (2, None), (3, "plain")], "k int, t string")
    out = rows.select("k", recognition.normal(recognition.plain_text(F.col("t"))).alias("p"), recognition.table_cells(F.col("t")).alias("c")).orderBy("k").collect()
    assert out[0]["p"] == "caf\u00e9 \u2019x &lt; y" and out[3]["p"] == "plain" and out[2]["p"] is None
    assert out[1]["c"] == ["a & b", "c <d>", "e &amp; f"] and out[3]["c"] == []


def test_ship_rule_by_roles(spark):
    scores = lambda *rows: spark.createDataFrame(rows, "bundle_id string, f1 double, tp long, fp long, fn long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "bundle_id string")
    before = scores(("full", 1.0, 3, 0, 0), ("miss", 0.5, 1, 1, 1), ("train", 1.0, 2, 0, 0))
    after = scores(("full", 1.0, 3, 0, 0), ("miss", 0.8, 2, 1, 0), ("train", 0.5, 1, 1, 1))
    rule = lambda a, m, **k: evaluation.ship_checks(before, after, a, m, **k).head()
    assert rule(ids("full"), ids("miss"), residual_positives=2)["ship"]  # the training bundle has no say
    assert not rule(ids("full"), ids("miss"))["ship"] and rule(ids("full"), ids("miss"), always_open=True)["ship"]
    assert not rule(ids("full", "train"), ids("miss"), always_open=True)["saturated_unchanged"]
    assert not rule(ids("full"), ids(), always_open=True)["every_miss_up"]


def test_a_page_is_flagged_or_accepted(spark):
    rows = spark.createDataFrame([(0.2, False), (0.4, False), (0.6, True)], "score double, ok boolean")
    t = evaluation.best_threshold(rows, "score", "ok").head()
    assert t["flagged"] == 2 and 0.4 < t["threshold"] < 0.4001
    taken = evaluation.accepted_error(rows.select(F.col("score").alias("probability"), F.lit(0.1).alias("cer")), t["threshold"]).head()
    assert taken["accepted"] + t["flagged"] == 3
    assert evaluation.best_threshold(rows.where("ok"), "score", "ok").head()["threshold"] == 0.0


def scans(df):
    """How often a query's plan reads tables."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_rank_repair_reads_its_tables_once(spark):
    from pagestream.plans.more_queries import QUERIES

    assert scans(QUERIES["rank_repair"](spark, "/root/testdata/sf0.001")) == 2


def test_sections_and_repairs_by_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for d in range(6):
        page = 0
        for k in range(40):
            page += rng.random() < 0.4
            kind = rng.choice(["title", "heading", "heading", "heading", "paragraph", "paragraph", "footer"])
            text = rng.choice(["1 A", "1.1 B", "1.1.1 C", "2 D", "2.1 E", "Notes", "1.2 F"]) if kind != "paragraph" else "x"
            rows.append((f"d{d}", page, k, f"d{d}b{k}", kind, rng.randint(1, 8) if kind == "heading" else None, text))
    blocks = spark.createDataFrame(rows, "bundle_id string, page_index int, reading_order int, block_id string, kind string, heading_level int, text string")
    made = assemble.sections(blocks)
    got = {(r.bundle_id, r.ord): (r.section_id, r.level, r.parent_ord, r.page_start, r.own_end, r.n_blocks, r.page_end) for r in made.collect()}
    want, flags = {}, set()
    for d in sorted({r[0] for r in rows}):
        own = []
        for _, page, _, block, kind, level, text in (r for r in rows if r[0] == d and r[4] != "footer"):
            head = kind in ("title", "heading")
            if head or not own:
                own.append({"id": f"{block}-sec" if head else "anon-1", "level": 0 if kind == "title" else min(level, 6) if head else 1, "start": page, "n": 0, "text": text if head else ""})
            own[-1] |= {"end": page, "n": own[-1]["n"] + 1}
        for k, s in enumerate(own):
            parent = max((j + 1 for j in range(k) if own[j]["level"] < s["level"]), default=None)
            stop = next((j for j in range(k + 1, len(own)) if own[j]["level"] <= s["level"]), len(own))
            want[d, k + 1] = (s["id"], s["level"], parent, s["start"], s["end"], s["n"], own[stop - 1]["end"])
            number = s["text"].split(" ")[0] if s["text"][:1].isdigit() else ""
            up = number.rpartition(".")[0]
            to = max((j + 1 for j in range(k) if up and own[j]["text"].split(" ")[0] == up), default=None)
            if to and s["level"] and to != parent:
                flags.add((d, s["start"], s["id"], own[parent - 1]["id"] if parent else None, own[to - 1]["id"], number))
    assert got == want
    found = assemble.repaired(made).collect()
    assert {tuple(r) for r in found} == flags and len(found) == len(flags) > 20


def test_event_log_of_tables_in_the_order_of_a_stream(spark):
    rng = random.Random(5)
    pages, blocks, want = [], [], []
    for b, n in (("a", 1), ("b", 2), ("c", 9)):
        doc, made = 0, []
        for p in range(n):
            effective, reason = p > 0 and rng.random() < 0.5, rng.choice([None, "x+y"])
            doc += effective
            ids = [f"{b}-p{p}-b{k}" for k in range(rng.randint(0, 3))]
            blocks += [(b, p, k, i) for k, i in enumerate(ids)]
            pages.append((b, p, f"class{p}", 0.5 if reason else None, reason, f"why{p}", effective, doc))
            at = min(p + 2, n - 1)
            made += [(p, 0, 0, "page_classified", p, f"class{p}"), *((p, 1, k, "block_emitted", p, i) for k, i in enumerate(ids))] + ([(p, 2, 0, "boundary_proposed", p, reason)] if reason else [])
            made += [(at, 3, 4 * p, "boundary_decided", p, f"why{p}")] + ([(at, 3, 4 * p + 1, "document_closed", p, f"{b}-doc-{doc - 1}")] if effective else []) + ([(at, 3, 4 * p + 2, "document_opened", p, f"{b}-doc-{doc}")] if effective or p == 0 else [])
        made += [(n - 1, 4, 0, "document_closed", n - 1, f"{b}-doc-{doc}"), (n - 1, 5, 0, "bundle_closed", n - 1, b)]
        want += [(b, k, *e[3:]) for k, e in enumerate(sorted(made))]
    rows = spark.createDataFrame(pages, "bundle_id string, page_index int, page_class string, confidence double, reason string, why string, effective boolean, doc_index int")
    key = ["bundle_id", "page_index"]
    listed = spark.createDataFrame(blocks, "bundle_id string, page_index int, reading_order int, block_id string")
    out = review.event_log(rows.select(*key, "page_class"), listed, rows.select(*key, "confidence", "reason"), rows.select(*key, F.col("why").alias("reason"), "effective", "doc_index"))
    assert [tuple(r) for r in out.orderBy("bundle_id", "seq").collect()] == want


def test_queries_over_order_pages_read_their_tables_once(spark):
    from pagestream.plans import more_queries, queries, study_queries

    sf = "/root/testdata/sf0.001"
    assert scans(more_queries.QUERIES["full_event_log"](spark, sf)) == 2
    assert scans(study_queries.QUERIES["run_comparison"](spark, sf)) == 2
    assert scans(queries.QUERIES["layout_blocks"](spark, sf)) == 1
    # Scores once, and the pages that were read in vain.
    assert scans(more_queries.QUERIES["gate_failures"](spark, sf)) == 4


def test_gate_failures_by_table_and_condition(spark):
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", float("nan")), (None, 0.0), ("d", None)], "bundle_id string, f1 double")
    wrong = spark.createDataFrame([("b",), ("b",), ("z",)], "bundle_id string")
    run = lambda df, holdout=None: sorted((r.bundle_id or "-", r.failure) for r in evaluation.gate_failures(df, evaluation.Floors(0.2, 0.95), wrong, holdout).collect())
    each = [("-", "low_f1"), ("a", "low_f1"), ("b", "false_ocr"), ("c", "low_f1"), ("d", "low_f1"), ("z", "false_ocr")]
    assert run(scores) == sorted([*each, ("-", "low_macro")])
    assert run(scores, F.col("bundle_id") == "b") == run(scores, spark.createDataFrame([("b",)], "bundle_id string")) == sorted([*each, ("-", "low_macro")])
    assert run(scores, F.col("bundle_id") == "x") == sorted([*each, ("-", "no_bundles")])
    assert run(scores.where("false")) == [("-", "no_bundles"), ("b", "false_ocr"), ("z", "false_ocr")]


def test_compared_decisions_equal_compared_runs(spark):
    from pagestream.operators import experiments as X
    from pagestream.operators import metrics

    rng = random.Random(8)
    rows = spark.createDataFrame([(f"b{b}", p, *(rng.random() < 0.3 for _ in range(4))) for b in range(20) for p in range(rng.randint(1, 6))], "bundle_id string, page_index int, g boolean, y boolean, y0 boolean, y1 boolean")
    score, marks = lambda y: metrics.flagged_scores(rows, "g", y), lambda y: rows.where(y).select("bundle_id", "page_index")
    band = lambda f: f("y0").withColumn("band", F.lit(0)).unionByName(f("y1").withColumn("band", F.lit(1)))
    plain = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.select("band", "macro_f1", "false_splits", "baseline_macro_f1", "baseline_false_splits", "changed", "eligible").collect())
    made = X.compare_decisions(rows, F.col("g"), F.col("y"), [F.col("y0"), F.col("y1")])
    assert plain(made) == plain(X.compare_runs(score("y"), band(score), marks("y"), band(marks)))
    best = X.best_eligible(made).head().band
    assert {r.band: r.best for r in X.with_best(made).collect()} == {k: None if best is None else k == best for k in (0, 1)}
