"""Look-ahead splitting on a stream of pages, with the batch operator's fold per bundle.

A bundle ends with a marker row (``page_index`` null), or after ``idle`` without
rows; its state is dropped then, so that the state store holds open bundles
only: at most the window's pages and the anchor each.  Pages of a bundle have to
arrive in order.  Many bundles may share one state (``buckets``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagestream.operators.lookahead import DECISION_SCHEMA, Fold, SplitConfig
from pagestream.shipping import ship

PAGE_SCHEMA = "bundle_id string, page_index int, confidence double, page_num int, page_total int"
#: Bundles of a replay that share a state.
BUCKET_BUNDLES = 256
_PAGES = pa.schema([("bundle_id", pa.string()), ("page_index", pa.int32()), ("confidence", pa.float64()), ("page_num", pa.int32()), ("page_total", pa.int32())])


def _advance_bucket(config: SplitConfig):
    """The fold of every bundle of a bucket; the snapshot lists the open ones: (bundle, anchor, page before, waiting pages)."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {bundle: (anchor, before, waiting) for bundle, anchor, before, waiting in json.loads(state.get[0])} if state.exists else {}
        table = pa.concat_tables([_PAGES.empty_table(), *(pa.Table.from_pandas(f, _PAGES, preserve_index=False) for f in batches)])
        table = table.sort_by([("bundle_id", "ascending"), ("page_index", "ascending")]).combine_chunks()  # markers come last
        bundles, marks = table.column("bundle_id").to_pylist(), table.column("page_index").is_null().to_pylist()
        edges = [k for k in range(len(bundles)) if not k or bundles[k] != bundles[k - 1]]
        found = []
        for lo, hi in zip(edges, [*edges[1:], len(bundles)], strict=True):
            bundle, ended, n = bundles[lo], marks[hi - 1], sum(marks[lo:hi])
            anchor, before, waiting = held.pop(bundle, (None, None, []))
            fold = Fold(config, None, anchor and tuple(anchor), before and tuple(before), pa.Table.from_pylist(waiting, _PAGES))
            found.append(fold.push(table.slice(lo, hi - lo - n), ended))
            if not ended:
                held[bundle] = (fold.anchor, fold.before, fold.waiting.to_pylist())
        if held:
            state.update((json.dumps([(bundle, *rest) for bundle, rest in held.items()]),))
        elif state.exists:
            state.remove()
        out = pa.concat_tables(found).select(["bundle_id", "page_index", "split", "reason", "confidence"]) if found else None
        if out is not None and out.num_rows:
            yield out.to_pandas()

    return advance


def decide_stream(pages: DataFrame, config: SplitConfig = SplitConfig(), idle_ms: int | None = None, buckets: int | None = None) -> DataFrame:
    """A streaming DataFrame of PAGE_SCHEMA to decisions. ``idle_ms``: a bundle without rows for so long has ended.

    ``buckets``: the open bundles of a bucket share one state, which each batch with rows for it writes anew; one call
    a bucket costs far less than one a bundle where batches hold many short bundles.  Bundles then end by markers only.
    """
    ship(pages.sparkSession)
    if buckets is not None:
        if idle_ms is not None:
            raise ValueError("bundles that share a state end by markers, not by idle_ms")
        dealt = pages.withColumn("bucket", F.pmod(F.xxhash64("bundle_id"), F.lit(buckets)))
        return dealt.groupBy("bucket").applyInPandasWithState(_advance_bucket(config), DECISION_SCHEMA, "snapshot string", "append", GroupStateTimeout.NoTimeout)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(config)
        if state.exists:
            anchor, before, waiting = json.loads(state.get[0])
            fold = Fold(config, None, anchor and tuple(anchor), before and tuple(before), pa.Table.from_pylist(waiting, _PAGES))
        ended = state.hasTimedOut
        frames = [pa.Table.from_pandas(f, _PAGES, preserve_index=False) for f in batches] if not ended else []
        table = pa.concat_tables([_PAGES.empty_table(), *frames])
        marks = table.column("page_index").is_null()
        ended |= bool(marks.to_numpy().any())
        table = table.filter(table.column("page_index").is_valid()).sort_by("page_index")
        out = fold.push(table, ended)
        if ended:
            state.remove()
        else:
            state.update((json.dumps([fold.anchor, fold.before, fold.waiting.to_pylist()]),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out.num_rows:
            yield out.select(["bundle_id", "page_index", "split", "reason", "confidence"]).to_pandas()

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return pages.groupBy("bundle_id").applyInPandasWithState(advance, DECISION_SCHEMA, "snapshot string", "append", timeout)


def replay(spark: SparkSession, pages: DataFrame, where: str, config: SplitConfig = SplitConfig(), cuts: tuple[int, ...] = (7, 20)) -> DataFrame:
    """Feeds ``pages`` in page order through a stream, in a batch for each range of page numbers, and returns all decisions."""
    columns = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
    # The pages are computed once; each range is written by all tasks.
    pages.select(*columns).write.parquet(f"{where}/rows")
    rows = spark.read.parquet(f"{where}/rows")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bundles = rows.select("bundle_id").distinct()
    buckets = max(files, bundles.count() // BUCKET_BUNDLES)
    low = 0
    for cut in (*cuts, None):
        part = rows.where((F.col("page_index") >= low) & ((F.col("page_index") < cut) if cut else F.lit(True)))
        if cut is None:
            ends = bundles.select("bundle_id", *(F.lit(None).cast(t).alias(c) for c, t in (("page_index", "int"), ("confidence", "double"), ("page_num", "int"), ("page_total", "int"))))
            part = part.unionByName(ends)
        part.repartition(files, "bundle_id").write.mode("append").parquet(f"{where}/pages")
        low = cut
    # Files go by age: a trigger that reaches into the next range still has all earlier pages of its bundles.
    stream = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{where}/pages")
    query = decide_stream(stream, config, buckets=buckets).writeStream.format("parquet").option("path", f"{where}/decisions").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(DECISION_SCHEMA).parquet(f"{where}/decisions")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums of events with a watermark; works on batches and streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
