"""The confirmer: budget, retries, replies, configuration, the fold it rides on, the stream and the parse."""

import http.server
import json
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagestream import PipelineConfig, parse
from pagestream.operators import confirm as C
from pagestream.operators.decision import reply_probability
from pagestream.operators.lookahead import SplitConfig
from pagestream.streaming.confirm import PROVIDER, decide_stream

BUSY = {"status": 503, "body": ""}


def says(content):
    return {"status": 200, "body": json.dumps({"choices": [{"message": {"content": content}}]})}


def confirmer(transport=C.recorded, pauses=None, low=0.35, high=0.74, **calls):
    config = C.ConfirmConfig(low, high, calls=C.CallConfig(**{"max_calls": 100} | calls))
    return C.Confirmer(config, transport, (lambda s: None) if pauses is None else pauses.append)


def page(at, *replies, confidence=0.5, message="m"):
    return {"page_index": at, "confidence": confidence, "message": message, "replies": list(replies)}


def test_only_pages_in_the_band_are_asked():
    c, b = confirmer(), C.Budget()
    for p in (page(0, says("0.9")), page(1, says("0.9"), confidence=0.34), page(2, says("0.9"), confidence=0.75), page(3, says("0.9"), confidence=None)):
        assert c.ask(p, b) == (None, None, 0)
    assert c.ask(page(4, says("0.5"), confidence=0.35), b) == (True, "split", 1)
    assert c.ask(page(5, says("0.49"), confidence=0.74), b) == (False, "continue", 1) and b.calls == 2


def test_the_third_strike_closes_the_bundle():
    c, b = confirmer(), C.Budget()
    assert c.ask(page(1, says("no idea")), b) == (None, "strike", 1)
    assert c.ask(page(2, says("1")), b) == (True, "split", 1)
    assert c.ask(page(3, {"status": 200, "body": "not json"}), b) == (None, "strike", 1)
    assert c.ask(page(4, {"status": 200, "body": '{"choices": []}'}), b) == (None, "exhausted", 1)
    assert c.ask(page(5, says("1")), b) == (None, "closed", 0) and b.degraded == [1, 3, 4] and b.calls == 4


def test_retries_pause_and_end():
    pauses = []
    c, b = confirmer(pauses=pauses, max_retries=3), C.Budget()
    assert c.ask(page(1, BUSY, {"status": 429, "body": ""}, {"status": None, "body": None}, says("0.8")), b) == (True, "split", 4)
    assert pauses == [0.5, 1.0, 1.0]
    assert c.ask(page(2, *[BUSY] * 4, says("0.8")), b) == (None, "strike", 4)
    assert len(pauses) == 6  # none after the last attempt
    for status in (400, 401, 500, 301):
        with pytest.raises(C.ConfirmError, match=f"status {status} at page 3"):
            c.ask(page(3, {"status": status, "body": "secret"}), b)


def test_no_calls_unless_some_are_granted():
    with pytest.raises(C.ConfirmError, match="more than 0 calls"):
        confirmer(max_calls=0).ask(page(1, says("1")), C.Budget())
    assert C.CallConfig().max_calls == 0
    c, b = confirmer(max_calls=1, strict=False), C.Budget()
    assert [c.ask(page(k, says("1")), b)[1] for k in (1, 2, 3)] == ["split", "over_budget", "over_budget"] and b.degraded == [2, 3]


REPLIES = ["0.5", " 1 ", "0", "1.2", "-0.1", "nan", "inf", "probability is 0.25", "chance: 1", "1", "I say 3 of 4", "p = .5", "50%", "0.5 %", "score 0.7 percent", "-0.4", "", '"probability 0.3"', '{"probability": 0.4}', '{"probability": "0.4"}', "{}", "[0.3]", "null", "no idea"]


def test_replies_are_read_like_columns(spark):
    rows = spark.createDataFrame([(r,) for r in REPLIES], "reply string").select("reply", reply_probability(F.col("reply")).alias("p")).collect()
    for r in rows:
        if "{" not in r["reply"] and not r["reply"].startswith(("[", '"')):
            assert C.probability_of(r["reply"]) == r["p"], r
    assert C.probability_of('{"probability": 0.4}') == 0.4 and C.probability_of('"probability 0.3"') == 0.3
    assert C.probability_of('{"probability": "0.4"}') is None and C.probability_of("[0.3]") is None


BAD = [
    [], {}, {"decision": []}, {"decision": {"base_url": "http://x"}}, {"decision": {"base_url": " ", "model": "m"}},
    {"low": True}, {"low": "0.1"}, {"high": float("nan")}, {"low": 0.8, "high": 0.7}, {"task": " "},
    {"decision": {"base_url": "http://x", "model": "m", "api_key": "k"}}, {"decision": {"base_url": "http://u:p@x", "model": "m"}},
    {"decision": {"base_url": "http://x", "model": "m", "auth": "basic"}}, {"decision": {"base_url": "http://x", "model": "m", "max_calls": -1}}, {"decision": {"base_url": "http://x", "model": "m", "max_retries": True}},
]


@pytest.mark.parametrize("data", BAD, ids=str)
def test_bad_configurations(data):
    if isinstance(data, dict) and "decision" not in data and data:
        data = data | {"decision": {"base_url": "http://x", "model": "m"}}
    with pytest.raises(ValueError):
        C.ConfirmConfig.load(data)


def test_a_configuration_is_read():
    c = C.ConfirmConfig.load({"low": 0.4, "decision": {"base_url": "https://x/v1", "model": "m", "max_calls": 5, "auth": "none"}})
    assert (c.low, c.high, c.calls.max_calls, c.calls.max_retries, c.calls.auth) == (0.4, 0.74, 5, 2, "none")


def test_http(monkeypatch):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status = {1: 503, 3: 302}.get(len(seen), 200)
            body = says("0.9")["body"].encode()
            self.send_response(status)
            self.send_header("Location", "/elsewhere")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    calls = C.CallConfig(f"http://127.0.0.1:{server.server_port}/v1/", "tiny", max_calls=9, max_chars=3)
    c, b = C.Confirmer(C.ConfirmConfig(calls=calls), C.HttpTransport(calls), lambda s: None), C.Budget()
    monkeypatch.delenv(C.KEY_VARIABLE, raising=False)
    with pytest.raises(C.ConfirmError, match="isn't set"):
        c.ask(page(1), b)
    monkeypatch.setenv(C.KEY_VARIABLE, "k")
    assert c.ask(page(2, message="long text"), b) == (True, "split", 2)
    assert seen[1] == ("/v1/chat/completions", "Bearer k", {"model": "tiny", "temperature": 0, "messages": [{"role": "user", "content": "lon"}]})
    with pytest.raises(C.ConfirmError, match="status 302"):
        c.ask(page(3), b)
    server.shutdown()
    server.server_close()
    assert C.HttpTransport(calls)({"message": "x"}, 0) == (None, "")


def tables(rows, step):
    for k in range(0, len(rows), step):
        yield pa.Table.from_pylist([dict(zip(C.PAGES.names, r, strict=True)) for r in rows[k : k + step]], C.PAGES)


def folded(rows, step, asker):
    fold, out = C.ConfirmFold(SplitConfig(), asker), []
    for t in tables(rows, step):
        out += fold.push(t).to_pylist()
        assert fold.waiting.num_rows <= 2
    out += fold.push(C.PAGES.empty_table(), True).to_pylist()
    return [(r["bundle_id"], r["page_index"], r["split"], r["reason"], r["outcome"], r["attempts"]) for r in out]


def test_each_open_page_is_asked_once_however_rows_arrive():
    asked = []

    def transport(request, attempt):
        asked.append(request["page_index"])
        return 200, says("0.9" if request["page_index"] % 2 else "x")["body"]

    rows = [(b, k, 0.5, None, None, f"{b}{k}", None) for b in ("a", "b") for k in range(8)] + [("c", 0, 0.5, None, None, "", None), ("c", 1, 0.9, 1, 3, "", None), ("c", 2, 0.5, 2, 3, "", None)]
    want = folded(rows, 100, confirmer(transport))
    first = list(asked)
    assert [r[4] for r in want[:8]] == [None, "split", "strike", "split", "strike", "split", "exhausted", "closed"]
    assert want[8:16] == [("b", *r[1:]) for r in want[:8]]  # a new bundle, a new budget
    assert [r[3] for r in want[16:]] == ["fallback_below", "high_confidence", "continues_sequence"] and want[17][4] is None
    for step in (1, 2, 3, 5):
        asked.clear()
        assert folded(rows, step, confirmer(transport)) == want and asked == first


def test_a_long_bundle_in_many_batches(spark):
    rows = spark.range(30_000).select(F.lit("x").alias("bundle_id"), F.col("id").cast("int").alias("page_index"), F.lit(0.5).alias("confidence"), F.lit(None).cast("int").alias("page_num"), F.lit(None).cast("int").alias("page_total"), F.col("id").alias("mark"), F.expr("array(struct(200 AS status, '{\"choices\": [{\"message\": {\"content\": \"1\"}}]}' AS body))").alias("replies"))
    out = C.decide(rows, confirmer(max_calls=29_000, strict=False), keep=("mark",))
    assert {(r["outcome"], r["n"]) for r in out.where("mark = page_index").groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {(None, 1), ("split", 29_000), ("over_budget", 999)}
    assert [tuple(r) for r in C.usage(out).select("calls", "attempts", "strikes", F.size("degraded")).collect()] == [(29_000, 29_000, 0, 999)]
    with pytest.raises(Exception, match="more than 3 calls"):
        C.decide(rows, confirmer(max_calls=3)).count()


def test_an_idle_bundle_ends_and_state_goes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a stream with timers never runs out of batches
    schema = "bundle_id string, page_index int, confidence double, page_num int, page_total int, replies " + C.REPLIES
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    got = []
    for rows in ([("a", 0, 0.5), ("a", 1, 0.5), ("a", 2, 0.9)], [("b", 0, 0.5)], [("a", 0, 0.9)]):
        spark.createDataFrame([(*r, None, None, [says("0.9")]) for r in rows], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        out = decide_stream(source, confirmer(), idle_ms=1)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        got.append(sorted((r["bundle_id"], r["page_index"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    a = [("a", 0, "fallback_below"), ("a", 1, "confirmed_split"), ("a", 2, "high_confidence")]
    assert got[0] == a[:1] and got[1] == a
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got[2] == sorted([*a, ("b", 0, "fallback_below")])  # the new bundle a waits for followers again


def test_parse_asks_and_reports(spark):
    foot = lambda k: f"Page {k}"
    texts = [f"Report of things\n\nalpha beta gamma {k}\n\n{foot(k + 1)}" for k in range(3)] + [f"Other head\n\nquite other words {k}\n\n{foot(k + 1)}" for k in range(3)]
    pages = spark.createDataFrame([("p", k, t) for k, t in enumerate(texts)], "bundle_id string, page_index int, text string")
    plain = parse(pages)
    before = {r["page_index"]: r["confidence"] for r in plain.decisions.collect()}
    seen = pages.withColumn("replies", F.expr("array(struct(200 AS status, '{\"choices\": [{\"message\": {\"content\": \"0.1\"}}]}' AS body))"))
    asked = parse(seen, PipelineConfig(confirmer=confirmer(low=0.0, high=1.0), commit_confidence=1.0, window=1))
    rows = {r["page_index"]: r for r in asked.decisions.collect()}
    assert set(rows) == set(before) and all(r["outcome"] in (None, "continue") for r in rows.values())
    assert all(r["attempts"] == 0 for k, r in rows.items() if r["outcome"] is None)
    assert asked.documents.count() >= 1
    plain.close()
    asked.close()
