"""The registered queries of the corpus operators; digest columns are derived here."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as R
from .bwt_dedup import suffix_dedup
from .decontamination import contamination
from .hard_negatives import hard_negatives
from .kneser_ney import quality
from .packing import Limits, digest, packed
from .phrases import phrases
from .quality import quality_verdicts
from .sharding import shard
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .token_records import read_records, write_records
from .toxicity import toxicity
from .warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), F.xxhash64(body).alias("tie"))
    return shard(sized, "doc_id", [1.0] * 16, ties=("text_crc32", "tie")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train_rows=20_000, threshold=0.3)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), quantile=0.999)


def word_tokenizer() -> str:
    """The public tokenizer's file; its place comes from the installed package, or from PAGESTREAM_TOKENIZER."""
    if "PAGESTREAM_TOKENIZER" in os.environ:
        return os.environ["PAGESTREAM_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed(_table(spark, sf_dir, "documents"), word_tokenizer(), Limits(tokens=2048)))


def _warc_columns(records: DataFrame) -> DataFrame:
    # A null page_id stands as its placeholder in a revisit's link: null there means that nothing is referred to.
    return records.select(R.plain_id("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc_columns(round_trip(_table(spark, sf_dir, "pages"), least_bytes=100))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(_table(spark, sf_dir, "documents"), keys=("lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.col("longest").alias("longest_match"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, anchors=F.col("vec_id") % 100 == 0, label=label, positives=5, negatives=10, least_share=30, most_share=90, scale=256)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(_table(spark, sf_dir, "documents"), longest=5, least=100, absorb=100, limit=2000)


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = R.folder(spark, "records")
    write_records(_table(spark, sf_dir, "documents"), folder, word_tokenizer(), end_id=1)
    out = read_records(spark, folder)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_phrases": op12_phrases,
    "op13_token_records": op13_token_records,
}
ORACLES: dict[str, str] = {
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other)::INTEGER AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) <= 10
""",
    "op12_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) AS p FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
longer AS (SELECT lang, unnest([p[1 : m - 1], p[2 : m]]) AS p, a FROM f WHERE m > 2),
over AS (SELECT lang, p, max(a) AS b FROM longer GROUP BY ALL),
kept AS (SELECT f.* FROM f LEFT JOIN over USING (lang, p) WHERE m > 1 AND (b IS NULL OR 100 * b < 100 * a)),
cuts AS (SELECT lang, m, p, a, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : c.m] JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM best)
SELECT * FROM ranked WHERE rank <= 2000
""",
}
