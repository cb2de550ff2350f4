import os
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagestream.llm import runtime as R
from pagestream.llm import token_records as T
from pagestream.llm.queries import op13_token_records, word_tokenizer


def plain_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def expected(rows):
    model = Tokenizer.from_file(word_tokenizer())
    model.encode_special_tokens = True
    return {k: [*model.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}


def by_id(rows):
    return {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows}


ROWS = [(5, "Ab cd, ab."), (-3, None), (7, ""), (2, "é ß \x00 <|endoftext|> x\n\ny"), (9, "word " * 3000), (11, "longer " * 400_000)]


def test_crc32c_of_many_ranges():
    r = random.Random(3)
    data = np.frombuffer(r.randbytes(5000), np.uint8)
    start = np.array([0, 1, 10, 63, 64, 100, 2000])
    end = np.array([4, 65, 74, 127, 4999, 5000, 2129])
    assert T.crc32c(data, start, end).tolist() == [plain_crc32c(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert int(T.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0]) == 0xE3069283


def test_frames_have_the_published_layout():
    data, at = T.frames(np.array([4, -1]), np.array([False, True]), np.array([3, 70_000, 1], np.uint32), np.array([0, 2, 3]), 4)
    raw = data[: at[1]].tobytes()
    (size,) = struct.unpack_from("<Q", raw)
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert size == 12 + 8 and len(raw) == 12 + size + 4
    assert struct.unpack_from("<I", raw, 8)[0] == mask(plain_crc32c(raw[:8]))
    assert raw[12:32] == struct.pack("<qBBHII", 4, 0, 4, 0, 3, 70_000)
    assert struct.unpack_from("<I", raw, 32)[0] == mask(plain_crc32c(raw[12:32]))
    doc, null, ids, offsets = T.unframe(data, at, "x")
    assert doc.tolist() == [4, -1] and null.tolist() == [False, True] and ids.tolist() == [3, 70_000, 1] and offsets.tolist() == [0, 2, 3]
    for k in (0, 9, 15, 20, 33):
        bad = data.copy()
        bad[k] ^= 4
        with pytest.raises(ValueError):
            T.unframe(bad, at, "x")


def test_round_trip_in_order_and_shuffled(spark):
    docs = spark.createDataFrame([(a, b, 1) for a, b in ROWS], "doc_id long, text string, start int").repartition(3)
    folder = R.folder(spark, "t")
    files = T.write_records(docs, folder, word_tokenizer())
    want = expected(ROWS)
    rows = sorted(T.read_records(spark, folder).collect(), key=lambda r: (r["file"], r["start"]))
    assert by_id(rows) == want and [r["doc_id"] for r in rows] == sorted(want)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert sum(r["tokens"] for r in files.collect()) == at
    orders = []
    for seed in (1, 2):
        got = T.read_shuffled(spark, folder, seed, 3).collect()
        assert by_id(got) == want and [r["turn"] for r in got] == sorted(r["turn"] for r in got)
        orders.append([r["doc_id"] for r in got])
    assert orders[0] != orders[1] and len(T.read_index(spark, folder).collect()) == len(ROWS)
    name = files.collect()[-1]["name"]
    local = folder.removeprefix("file://")
    with open(f"{local}/{name}.rec", "r+b") as f:
        f.truncate(os.path.getsize(f"{local}/{name}.rec") - 1)
    with pytest.raises(Exception, match="cut"):
        T.read_records(spark, folder).collect()


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "b"), (3, "same"), (3, "same"), (3, "other"), (None, None)] + [(4, "hot")] * 50
    folder = R.folder(spark, "t")
    T.write_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, word_tokenizer())
    got = sorted(T.read_records(spark, folder).collect(), key=lambda r: (r["file"], r["start"]))
    assert [r["doc_id"] for r in got] == [None, None, 3, 3, 3] + [4] * 50
    assert sorted(len(r["ids"]) for r in got[:2]) == [4, 8]
    folder = R.folder(spark, "t")
    T.write_records(spark.createDataFrame([], "doc_id long, text string"), folder, word_tokenizer())
    assert T.read_records(spark, folder).count() == 0 and T.read_index(spark, folder).count() == 0 and T.read_shuffled(spark, folder, 1, 2).count() == 0


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = expected([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: r for r in op13_token_records(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for k in sorted(want):
        raw = np.array(want[k], "<u4").tobytes()
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(want[k]), zlib.crc32(raw))
        at += len(want[k])
    assert len(got) == len(want)
