"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The model's units are characters: texts are lower-cased, white space becomes
one space, and a document stands between boundary marks.  Each language has a
model of its own, trained on that language's trusted texts; languages without
trusted text take a model over all trusted text.

Counts of the highest order are made in the tasks and summed by key.  The other
orders' counts are distinct left extensions, and each order's probabilities come
from joins of sharded count tables: with the context's totals, and with the
order below on the gram's suffix.  The tables never pass through one task.

For scoring, the tables are cut into shards of at most ``SHARD_ROWS`` rows: a
character's probability needs only grams and contexts with the same character
before it, so a shard is a set of (language, preceding character) classes.
Each shard is broadcast (its rows bound its size) over one pass of the
documents, and the passes' sums of log probabilities add up.

A document is kept if its perplexity is at most its language's quantile of the
trusted documents' perplexities, from log-binned counts.

Edge cases: null and blank texts have no perplexity and are not kept; null
languages count as one without trusted text; without any trusted text nothing
has a perplexity and all texts that aren't blank are kept; repeated rows count
each; null ids count as one id before all others; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import runtime as R

ORDER = 5
SHARD_ROWS = 3_000_000
#: Stands before and after a document; texts hold no line ends once spaces are one.
BOUNDARY = "\n"
#: The model of all languages together.
ANY = "*"
SLICE_CHARS = 1 << 20
#: Trusted ids that are sent to the tasks; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
BIN = 1.01


def _points(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts between boundaries, places of the characters to predict, their text's number)."""
    plain = [" ".join((t or "").lower().split()) for t in texts]
    lead = BOUNDARY * (order - 1)
    whole = "".join(f"{lead}{p}{BOUNDARY}" for p in plain if p)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(p) + 1 if p else 0 for p in plain], np.int64)
    full = sizes + (order - 1) * (sizes > 0)
    begin = np.concatenate([[0], np.cumsum(full)])[:-1] + order - 1
    at = np.repeat(begin, sizes) + A.spread(sizes)
    return points, at, np.repeat(np.arange(len(texts)), sizes)


def _sums(points: np.ndarray) -> np.ndarray:
    return A.prefix(A.mix(points.astype(np.uint64) + np.uint64(1)), 2)


def gram_keys(points: np.ndarray, at: np.ndarray, n: int, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit keys of the ``n`` characters that end at each place; never 0."""
    sums = _sums(points) if sums is None else sums
    return np.maximum(A.ranged(sums, at - n + 1, at + 1, 2), np.uint64(1))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + ORDER
        if size >= SLICE_CHARS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _by_language(b: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray, list]]:
    langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
    groups: dict[str | None, list[int]] = {}
    for k, lang in enumerate(langs):
        groups.setdefault(lang, []).append(k)
    for lang, rows in groups.items():
        for lo, hi in _chunks([texts[k] for k in rows]):
            yield lang, np.array(rows[lo:hi]), [texts[k] for k in rows[lo:hi]]


def _count(order: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            keys, grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            return keys, grams[first], np.bincount(inverse, weights=counts).astype(np.int64)

        def out():
            for lang, parts in held.items():
                _, grams, counts = merged(parts)
                text = np.ascontiguousarray(grams.astype("<u4")).view(f"<U{order}").ravel()
                for lo in range(0, len(text), 50_000):
                    rows = text[lo : lo + 50_000].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.string()), pa.array(counts[lo : lo + 50_000], pa.int64())], names=["lang", "g", "c"])

        for b in batches:
            for lang, _, texts in _by_language(b):
                points, at, _ = _points(texts, order)
                if not len(at):
                    continue
                keys, first, counts = np.unique(gram_keys(points, at, order), return_index=True, return_counts=True)
                parts = held.setdefault(lang or ANY, [])
                parts.append((keys, points[at[first][:, None] + np.arange(1 - order, 1)], counts))
                size += len(keys)
                if len(parts) >= 16:
                    held[lang or ANY] = [merged(parts)]
                    size = sum(len(p[0]) for x in held.values() for p in x)
                if size > 2_000_000:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return work


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: modified Kneser-Ney discounts from the counts of counts; 3/4 of one where these are too few."""
    n = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = [F.when(enough, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")) for k in (1, 2, 3)]
    safe = [F.when((x > 0) & (x < k), x).otherwise(F.lit(0.75)).alias(f"d{k}") for k, x in zip((1, 2, 3), d, strict=True)]
    return counts.groupBy("lang").agg(*n).select("lang", *safe)


def _discount() -> Column:
    return F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))


def train(trusted: DataFrame, languages: DataFrame | None = None, order: int = ORDER) -> DataFrame:
    """(lang, text) to the model's rows: lang, n, g, logp (grams), logw (contexts: what is left for the order below).

    ``languages``: with rows, the model over all languages is made too.
    """
    R.prepare(trusted.sparkSession)
    made = R.map_arrow(trusted.select(F.col("lang").cast("string").alias("lang"), "text"), _count(order), "lang string, g string, c long")
    top = R.stage(made.groupBy("lang", "g").agg(F.sum("c").alias("c")), "grams")
    if languages is not None:
        top = top.where(F.col("lang") != ANY).unionByName(top.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit(ANY).alias("lang"), "g", "c"))
    else:
        top = top.where(F.col("lang") != ANY)
    tables = [R.stage(top, f"order{order}")]
    for n in range(order - 1, 0, -1):  # distinct left extensions
        tables.append(R.stage(tables[-1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")), f"order{n}"))
    tables.reverse()
    size = R.stage(tables[0].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("lower")), "languages")
    # One row a language: joined by a shuffle, a common language's rows would all meet in one task.
    spread = F.broadcast if size.count() <= R.BROADCAST_IDS else lambda t: t
    rows = size.select("lang", F.lit(0).alias("n"), F.lit("").alias("g"), F.log("lower").alias("logp"), F.lit(None).cast("double").alias("logw"))
    below = None
    for n, counts in enumerate(tables, 1):
        c = counts.join(spread(_discounts(counts)), "lang").withColumn("ctx", F.substring("g", 1, n - 1) if n > 1 else F.lit(""))
        context = c.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum(_discount()).alias("left")).withColumn("weight", F.col("left") / F.col("total"))
        rows = rows.unionByName(context.select("lang", F.lit(n - 1).alias("n"), F.col("ctx").alias("g"), F.lit(None).cast("double").alias("logp"), F.log("weight").alias("logw")))
        own = c.join(spread(context) if n == 1 else context, ["lang", "ctx"]).select("lang", "g", ((F.col("c") - _discount()) / F.col("total")).alias("alpha"), "weight", (F.substring("g", 2, n - 1) if n > 1 else F.lit("")).alias("suffix"))
        under = spread(size.select("lang", F.lit("").alias("suffix"), "lower")) if below is None else below.select("lang", F.col("g").alias("suffix"), F.col("p").alias("lower"))
        below = R.stage(own.join(under, ["lang", "suffix"]).select("lang", "g", (F.col("alpha") + F.col("weight") * F.col("lower")).alias("p")), f"p{n}")
        rows = rows.unionByName(below.select("lang", F.lit(n).alias("n"), "g", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logw")))
    return R.stage(rows.groupBy("lang", "n", "g").agg(F.max("logp").alias("logp"), F.max("logw").alias("logw")), "model")


class Table:
    """Keys to (logp, logw) by open addressing; NaN: none.  The slots are made where they are first used, so that only the rows travel."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, logw: np.ndarray):
        self.given, self.slots = keys, None
        self.logp, self.logw = np.append(logp, np.nan).astype(np.float64), np.append(logw, np.nan).astype(np.float64)

    def _fill(self) -> None:
        keys, n = self.given, len(self.given)
        size = 1 << max(4, int(4 * n - 1).bit_length() if n else 4)
        self.mask = np.uint64(size - 1)
        self.slots = np.zeros(size, np.uint64)
        self.row = np.zeros(size, np.int32)
        at, todo = keys & self.mask, np.arange(n)
        while len(todo):
            free = self.slots[at[todo]] == 0
            put = todo[free]
            self.slots[at[put]] = keys[put]
            self.row[at[put]] = put
            won = (self.slots[at[todo]] == keys[todo]) & (self.row[at[todo]] == todo)
            todo = todo[~won]
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
        self.given = keys[:0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; the last row where there is none."""
        if self.slots is None:
            self._fill()
        out = np.full(len(keys), len(self.logp) - 1, np.int64)
        at = keys & self.mask
        here = self.slots[at]
        hit = here == keys
        out[hit] = self.row[at[hit]]
        todo = np.flatnonzero(~hit & (here != 0))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            here = self.slots[at[todo]]
            hit = here == keys[todo]
            out[todo[hit]] = self.row[at[todo[hit]]]
            todo = todo[~hit & (here != 0)]
        return out


def _log_probabilities(points: np.ndarray, at: np.ndarray, table: Table, base: float, order: int) -> np.ndarray:
    """``base``: log of the share of a character never seen."""
    sums = _sums(points)
    total, todo = np.zeros(len(at)), np.arange(len(at))
    for n in range(order, 0, -1):
        row = table.find(gram_keys(points, at[todo], n, sums))
        p = table.logp[row]
        seen = ~np.isnan(p)
        total[todo[seen]] += p[seen]
        todo = todo[~seen]
        if not len(todo):
            return total
        if n > 1:
            w = table.logw[table.find(gram_keys(points, at[todo] - 1, n - 1, sums))]
            total[todo] += np.where(np.isnan(w), 0.0, w)
    total[todo] += base
    return total


def _shards(model: DataFrame) -> list[list[tuple[str, str | None]]]:
    """Sets of (language, preceding character) classes whose rows fit a shard; None: the grams of one character and less, in each."""
    before = F.when(F.col("n") >= 2, F.substring("g", -2, 1))
    # A context speaks for the characters after it: its last character precedes them.
    rows = model.select("lang", F.when(F.col("logp").isNotNull(), before).alias("a"), F.when(F.col("logw").isNotNull() & (F.col("n") >= 1), F.substring("g", -1, 1)).alias("b"))
    sizes = rows.select("lang", F.explode(F.array_distinct(F.array("a", "b"))).alias("v")).where("v is not null").groupBy("lang", "v").count().orderBy("lang", F.desc("count"), "v")
    out, room = [[]], SHARD_ROWS
    for r in sizes.toLocalIterator():  # at most one row a language and character
        if r["count"] > room and out[-1]:
            out, room = [*out, []], SHARD_ROWS
        out[-1].append((r["lang"], r["v"]))
        room -= r["count"]
    return out


def _collected(model: DataFrame, shards: list[list[tuple[str, str]]], k: int) -> dict[str, tuple[Table, float, np.ndarray, bool]]:
    """By language: the shard's table, the unseen share, and the preceding characters it is for; the first shard is for all but those of the others."""
    classes = shards[k]
    if len(shards) > 1:
        wanted = model.sparkSession.createDataFrame(classes, "lang string, v string")
        near = model.where("n >= 1").withColumn("v", F.explode(F.array_distinct(F.array(F.when(F.col("n") >= 2, F.substring("g", -2, 1)), F.substring("g", -1, 1)))))
        model = near.join(F.broadcast(wanted), ["lang", "v"], "left_semi").drop("v").unionByName(model.where("n <= 1")).distinct()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("g").to_pylist()
            points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = np.array([len(g) for g in grams], np.int64)
            end = np.cumsum(n) - 1
            sums = _sums(points)
            key = np.maximum(A.ranged(sums, end - n + 1, end + 1, 2), np.uint64(1))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(n, pa.int32()), pa.array(key.view(np.int64), pa.int64()), b.column("logp"), b.column("logw")], names=["lang", "n", "key", "logp", "logw"])

    table = R.map_arrow(model.select("lang", "g", "logp", "logw"), keys, "lang string, n int, key long, logp double, logw double").toArrow()
    coded = table.column("lang").combine_chunks().dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    n, key, p, w = (table.column(c).to_numpy() for c in ("n", "key", "logp", "logw"))
    p, w = p.astype(np.float64), w.astype(np.float64)
    out = {}
    for c, lang in enumerate(names):
        mine = np.flatnonzero((code == c) & (n > 0))
        empty = np.flatnonzero((code == c) & (n == 0))
        named = classes if k else [c for other in shards[1:] for c in other]
        out[lang] = (Table(key[mine].view(np.uint64), p[mine], w[mine]), float(np.nansum(p[empty]) + np.nansum(w[empty])), np.array([ord(v) for x, v in named if x == lang], np.uint32), k == 0)
    return out


def _score(shard, order: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shard.value
        for b in batches:
            total, count = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for lang, rows, texts in _by_language(b):
                table, base, named, others = tables.get(lang) or tables.get(ANY) or (None, 0.0, None, False)
                points, at, of = _points(texts, order)
                if not len(at):
                    continue
                if table is not None:
                    if len(named) or not others:
                        mine = np.isin(points[at - 1], named) != others
                        at, of = at[mine], of[mine]
                    total[rows] += np.bincount(of, _log_probabilities(points, at, table, base, order), len(rows))
                    count[rows] += np.bincount(of, minlength=len(rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("lang"), pa.array([not (t or "").split() for t in b.column("text").to_pylist()], pa.bool_()), pa.array(total, pa.float64()), pa.array(count, pa.int64())], names=["doc_id", "row", "lang", "blank", "logp", "chars"])

    return work


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id (null: NULL_ID), lang, blank, chars, perplexity."""
    spark = docs.sparkSession
    R.prepare(spark)
    texts = R.keyed(docs, F.col("lang").cast("string").alias("lang"), "text")
    shards = _shards(model)
    # Rows of one id are told apart by their text, whatever order the passes read them in.
    texts = texts.withColumn("row", F.xxhash64("text") if len(shards) > 1 else F.lit(0).cast("long"))
    passes = []
    for k in range(len(shards)):
        held = spark.sparkContext.broadcast(_collected(model, shards, k))
        part = R.map_arrow(texts.select("doc_id", "row", "lang", "text"), _score(held, order), "doc_id long, row long, lang string, blank boolean, logp double, chars long")
        passes.append(R.stage(part, f"scores{k}"))
    whole = passes[0]
    if len(passes) > 1:
        for p in passes[1:]:
            whole = whole.unionByName(p)
        copies = (F.count("*") / len(passes)).cast("int")
        whole = whole.groupBy("doc_id", "row", "lang", "blank").agg((F.sum("logp") / copies).alias("logp"), (F.sum("chars") / copies).cast("long").alias("chars"), copies.alias("copies"))
        whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return whole.select("doc_id", "lang", "blank", "chars", F.when(F.col("chars") > 0, F.exp(-F.col("logp") / F.col("chars"))).alias("perplexity"))


def thresholds(scores: DataFrame, quantile: float) -> DataFrame:
    """lang, limit: the upper edge of the bin that holds the quantile."""
    from pyspark.sql import Window

    bins = scores.where("perplexity is not null").groupBy("lang", F.ceil(F.log("perplexity") / math.log(BIN)).alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("lang")
    ranked = bins.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.where(F.col("upto") >= F.ceil(F.lit(quantile) * F.col("total"))).groupBy("lang").agg(F.pow(F.lit(BIN), F.min("bin")).alias("limit"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, order: int = ORDER) -> DataFrame:
    """doc_id, lang, chars, perplexity, limit, kept; trusted text: documents whose label says quality 1."""
    good = R.stage(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct(), "trusted")
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)  # its size is known: the texts needn't move
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    trusted = known.join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    covered = trusted.select("lang").distinct().where("lang is not null")
    lacking = known.select("lang").distinct().join(covered, "lang", "left_anti").limit(1)
    model = train(trusted, lacking if lacking.head() is not None else None, order)
    scores = perplexities(docs, model, order)
    limits = R.small_side(R.stage(thresholds(scores.join(good, F.col("doc_id") == F.col("_id"), "left_semi"), quantile), "limits"))
    every = thresholds(scores.join(good, F.col("doc_id") == F.col("_id"), "left_semi").withColumn("lang", F.lit(ANY)), quantile).select(F.col("limit").alias("any_limit"))
    out = scores.join(limits.select(F.col("lang").alias("_lang"), "limit"), F.col("lang") == F.col("_lang"), "left").join(F.broadcast(every.limit(1)), F.lit(True), "left")
    out = out.withColumn("limit", F.coalesce("limit", "any_limit"))
    return out.select(R.plain_id(), "lang", "chars", "perplexity", "limit", (~F.col("blank") & F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True))).alias("kept"))
