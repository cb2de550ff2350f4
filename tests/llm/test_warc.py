import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagestream.llm import warc as W
from pagestream.llm.queries import op7_warc


def brute(rows):
    first, out = {}, []
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        to = first.get(raw, i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    return sorted(out)


def test_stream_normalising():
    r = random.Random(1)
    records = [W.record(k, f"http://a/{k} x\n", bytes(r.randrange(256) for _ in range(r.choice([0, 5, 70000]))), "d", None) for k in range(9)]
    for content in (gzip.compress(b"".join(records)), b"".join(gzip.compress(b"".join(records[k : k + 2])) for k in range(0, 9, 2))):
        made, index = W.normalise_bytes(content)
        assert [zlib.decompress(made[o : o + n], 31) for o, n, _, _ in index] == records
        assert gzip.decompress(made) == b"".join(records)
        assert index[0][0] == 0 and index[-1][0] + index[-1][1] == len(made)
    assert W.normalise_bytes(gzip.compress(b"")) == (b"", [])
    with pytest.raises(W.WarcError):
        W.normalise_bytes(gzip.compress(b"".join(records))[:-9])
    with pytest.raises(W.WarcError):
        W.normalise_bytes(gzip.compress(records[0][:-2]))


def test_round_trip(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab <é>\r\n") for _ in range(n)) for n in (0, 5, 99, 100, 101, 500, 9000)] + [None]
    rows = [(k * 3, r.choice([None, f"http://x/{k}"]), r.choice(texts)) for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    got = W.round_trip(df, archive_bytes=3000).collect()
    assert sorted((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got) == brute(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(x.payload) == html[x.page_id] for x in got if x.record_type == "response")
    assert len({x.archive for x in got}) > 3


def test_edge_cases(spark):
    long = "x" * 200
    rows = [(None, None, long), (4, "u", long), (4, "u", long), (5, "u", None)]
    from pagestream.llm.queries import _warc_columns

    got = sorted((x.page_id is None, x.page_id, x.record_type) for x in _warc_columns(W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect() if x.page_id is not None)
    assert got == [(False, 4, "revisit"), (False, 4, "revisit"), (False, 5, "response")]
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in op7_warc(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(pages)
