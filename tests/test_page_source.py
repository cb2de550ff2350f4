"""Page files as a data source: ids, splits, pruning, filters, damage, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagestream.operators import experiments as X
from pagestream.sources import page_source as P


def put(root, name, pages, end="\n"):
    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
    with open(f"{root}/{name}", "w") as f:
        f.write("\n".join(json.dumps(p) for p in pages) + end)


def page(k, text="t", **more):
    return {"index": k, "width": 600.0, "height": 800, "rotation": 0, "text": text, "lines": [{"text": text, "x0": 1, "top": 2.5, "x1": 3, "bottom": 4, "size": 9, "bold": k == 0}], **more}


@pytest.fixture
def folder(tmp_path):
    root = str(tmp_path / "in")
    put(root, "a/x.jsonl", [page(k, f"ax{k} é") for k in range(5)], end="")
    put(root, "b/x.jsonl", [page(k, "b" * (300 * k)) for k in range(40)])
    put(root, "b/y.v2.jsonl", [page(0, extra={"deep": [1]})])
    put(root, "_tmp/z.jsonl", [page(0)])
    put(root, "b/notes.txt", [page(0)])
    put(root, "empty.jsonl", [], end="")
    return root


def test_two_files_of_one_name_stay_apart(spark, folder):
    rows = P.read_pages(spark, folder).collect()
    assert sorted((r["bundle_id"], r["page_index"]) for r in rows) == sorted([("a/x", k) for k in range(5)] + [("b/x", k) for k in range(40)] + [("b/y.v2", 0)])
    one = next(r for r in rows if r["bundle_id"] == "a/x" and r["page_index"] == 0)
    assert (one["text"], one["height"], one["lines"][0]["bold"], one["lines"][0]["top"]) == ("ax0 é", 800.0, True, 2.5)


@pytest.mark.parametrize("size", [1, 7, 100, 1500, 10**6])
def test_splits_read_every_page_once(folder, size, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 64)
    reader = P.PageReader({"path": folder, "split_bytes": str(size), "columns": "page_index,text"})
    parts = reader.partitions()
    got = sorted((r["bundle_id"], r["page_index"], len(r["text"])) for p in parts for b in reader.read(p) for r in b.to_pylist())
    assert got == sorted([("a/x", k, 5) for k in range(5)] + [("b/x", k, 300 * k) for k in range(40)] + [("b/y.v2", 0, 1)])
    assert size > 2000 or len(parts) > 3


def test_unread_fields_arent_parsed(spark, tmp_path):
    put(tmp_path, "p.jsonl", [page(0) | {"lines": "no lines at all"}])
    assert [tuple(r) for r in P.read_pages(spark, str(tmp_path), columns="page_index,text").collect()] == [("p", 0, "t")]
    with pytest.raises(Exception, match="no page"):
        P.read_pages(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no column"):
        P.read_pages(spark, str(tmp_path), columns="page_index,colour").collect()


def test_filters_reach_the_reader(spark, folder):
    pages = P.read_pages(spark, folder, columns="page_index,text")
    some = pages.where((F.col("bundle_id") == "b/x") & (F.col("page_index") >= 38) & (F.length("text") > 0))
    assert sorted(r["page_index"] for r in some.collect()) == [38, 39]
    assert some.rdd.getNumPartitions() == 1
    assert pages.where(F.col("bundle_id").startswith("a/") & (F.col("page_index") < 2)).count() == 2
    assert pages.where(F.col("bundle_id").isin("b/y.v2", "none")).count() == 1 and pages.where("bundle_id = 'none'").count() == 0
    reader = P.PageReader({"path": folder})
    assert list(reader.pushFilters([P.EqualTo(("bundle_id",), "b/x"), P.GreaterThan(("page_index",), 3), P.EqualTo(("text",), "x")])) == [P.EqualTo(("text",), "x")]
    assert {p.bundle for p in reader.partitions()} == {"b/x"}


def test_damage_fails(spark, tmp_path):
    put(tmp_path, "p.jsonl", [page(0)], end='\n{"index": 1, "text"\n')
    with pytest.raises(Exception, match="p.jsonl"):
        P.read_pages(spark, str(tmp_path)).collect()
    with pytest.raises(Exception):
        P.read_pages(spark, str(tmp_path / "nowhere")).collect()


def test_a_stream_gives_the_rows_of_a_batch_and_resumes(spark, folder, tmp_path):
    def run():
        stream = P.stream_pages(spark, folder, columns="page_index,text", files_per_batch="2")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))

    batch = lambda: sorted(map(tuple, P.read_pages(spark, folder, columns="page_index,text").collect()))
    assert run() == batch()
    put(folder, "late/x.jsonl", [page(0, "late")])
    assert run() == batch() and ("late/x", 0, "late") in batch()


def test_page_files_are_read_through_the_source(spark, folder):
    rows = X.page_files(spark, folder).collect()
    assert len(rows) == 46 and {r["bundle_id"] for r in rows} == {"a/x", "b/x", "b/y.v2"}


def test_document_pages_are_numbered_across_ranges_of_ids(spark, tmp_path):
    # 400 documents of one source (and some of none) in many ranges: no window may hold a whole source's texts.
    from pagestream.sources import adapters as S

    ids = [37 * k * 1024 - 100_000 for k in range(400)]
    rows = [(i, f"text {i}", "en", None if k % 9 == 0 else "src") for k, i in enumerate(ids)] + [(None, "no id", "en", "src")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    pages = S.document_pages(spark, str(tmp_path))
    got = {(r.bundle_id, r.doc_id): r.page_index for r in pages.collect()}
    for source in ("src", None):
        own = sorted((i for i, _, _, s in rows if s == source), key=lambda i: (i is not None, i or 0))
        assert [got[source, i] for i in own] == list(range(len(own)))
    assert len(got) == len(rows)
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert not any("row_number()" in line and "windowspecdefinition(source" in line for line in plan.splitlines())
