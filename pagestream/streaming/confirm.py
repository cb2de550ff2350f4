"""Look-ahead with a confirmer on a stream: the batch operator's fold, on ``transformWithState``.

State of a bundle: the anchor and the last decided page (a value), the pages
that wait for followers with their request texts (a list, at most the window's),
the budget (a value), the pages without an answer (a list), and a timer that
ends a bundle without rows.  All of it goes with the bundle's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagestream.operators.confirm import OUTCOME_SCHEMA, PAGES, REPLIES, Budget, Confirmer, ConfirmFold, page_columns
from pagestream.operators.lookahead import SplitConfig
from pagestream.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = f"page_index int, confidence double, page_num int, page_total int, message string, replies {REPLIES}"
FOLD = "anchored boolean, page int, number int, total int, decided boolean, last_page int, last_confidence double, last_number int, last_total int"
BUDGET = "calls int, strikes int, closed boolean"
OUT = [f.split()[0] for f in OUTCOME_SCHEMA.split(", ")]


class ConfirmProcessor(StatefulProcessor):
    def __init__(self, split: SplitConfig, confirmer: Confirmer, idle_ms: int | None):
        self.split, self.confirmer, self.idle_ms = split, confirmer, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold, self.budget = handle.getValueState("fold", FOLD), handle.getValueState("budget", BUDGET)
        self.waiting, self.degraded = handle.getListState("waiting", WAITING), handle.getListState("degraded", "page int")

    def _load(self, bundle: str) -> ConfirmFold:
        anchor = before = None
        if self.fold.exists():
            a, page, number, total, d, *last = self.fold.get()
            anchor, before = (page, number, total) if a else None, tuple(last) if d else None
        budget = Budget(*self.budget.get(), [r[0] for r in self.degraded.get()] if self.degraded.exists() else []) if self.budget.exists() else Budget()
        rows = [] if not self.waiting.exists() else [self._page(bundle, r) for r in self.waiting.get()]
        return ConfirmFold(self.split, self.confirmer, anchor, before, pa.Table.from_pylist(rows, PAGES), bundle, budget)

    @staticmethod
    def _page(bundle: str, row: tuple) -> dict:
        *plain, replies = row
        said = None if replies is None else [{"status": r[0], "body": r[1]} for r in replies]
        return dict(zip(PAGES.names, (bundle, *plain, said), strict=True))

    def _store(self, fold: ConfirmFold) -> None:
        none = (None, None, None, None)
        self.fold.update((fold.anchor is not None, *(fold.anchor or none[:3]), fold.before is not None, *(fold.before or none)))
        b = fold.budget
        self.budget.update((b.calls, b.strikes, b.closed))
        for state, rows in ((self.degraded, [(p,) for p in b.degraded]), (self.waiting, [(*(r[c] for c in PAGES.names[1:-1]), None if r["replies"] is None else [(x["status"], x["body"]) for x in r["replies"]]) for r in fold.waiting.to_pylist()])):
            state.put(rows) if rows else state.clear()

    def _end(self) -> None:
        for state in (self.fold, self.budget, self.waiting, self.degraded):
            state.clear()

    def _timers(self, now: int | None) -> None:
        if self.idle_ms is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if now is not None:
            self.handle.registerTimer(now + self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tables = [pa.Table.from_pandas(f[PAGES.names], PAGES, preserve_index=False) for f in rows]
        table = pa.concat_tables([PAGES.empty_table(), *tables])
        ended = table.column("page_index").null_count > 0
        fold = self._load(key[0])
        out = fold.push(table.filter(table.column("page_index").is_valid()).sort_by("page_index"), ended)
        if ended:
            self._end()
        else:
            self._store(fold)
        self._timers(None if ended else timerValues.getCurrentProcessingTimeInMs())
        yield out.select(OUT).to_pandas()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._load(key[0]).push(PAGES.empty_table(), True)
        self._end()
        yield out.select(OUT).to_pandas()

    def close(self) -> None:
        pass


def decide_stream(pages: DataFrame, confirmer: Confirmer, split: SplitConfig = SplitConfig(), idle_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame of pages (see ``operators.confirm.decide``) to decisions with outcomes.

    A bundle's pages have to arrive in order; it ends with a row whose page_index
    is null, or after ``idle_ms`` without rows.  The state store has to be RocksDB:
    set ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER``.  With
    ``idle_ms`` Spark makes batches without rows, so that timers fire; a stream
    that shall end by itself needs ``noDataMicroBatches`` off.
    """
    spark = pages.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    processor = ConfirmProcessor(split, confirmer, idle_ms)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return pages.select(*page_columns(pages)).groupBy("bundle_id").transformWithStateInPandas(processor, OUTCOME_SCHEMA, "Append", mode)


def replay(pages: DataFrame, where: str, confirmer: Confirmer, split: SplitConfig = SplitConfig(), cuts: tuple[int, ...] = (3,)) -> DataFrame:
    """Feeds ``pages`` in ranges of page numbers through a stream that is stopped and resumed between them; all decisions."""
    spark = pages.sparkSession
    rows = pages.select(*page_columns(pages))
    empty = spark.createDataFrame([], rows.schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    low = 0
    for cut in (*cuts, None):
        part = rows.where((F.col("page_index") >= low) & ((F.col("page_index") < cut) if cut else F.lit(True)))
        if cut is None:
            part = part.unionByName(rows.select("bundle_id").distinct().join(empty.drop("bundle_id"), F.lit(False), "left"))
        part.write.mode("append").parquet(f"{where}/pages")
        stream = spark.readStream.schema(rows.schema).parquet(f"{where}/pages")
        sink = decide_stream(stream, confirmer, split).writeStream.format("parquet").option("path", f"{where}/decisions").option("checkpointLocation", f"{where}/checkpoint")
        sink.trigger(availableNow=True).start().awaitTermination()
        low = cut
    return spark.read.schema(OUTCOME_SCHEMA).parquet(f"{where}/decisions")
