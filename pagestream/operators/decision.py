"""Decision payloads: request messages, reply parsing, few-shot grounding, loop detection, strike budgets, cached recognition."""

from __future__ import annotations

import re
import urllib.parse
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestream.functions import text as T
from pagestream.operators.model import FEATURES
from pagestream.shipping import ship

# --- fixed values ---
LOOP_CHARS, LOOP_RATIO, LOOP_LEVEL = 1500, 0.02, 9
MAX_PROMPT, MAX_STRIKES = 8000, 3
SECRET_FIELD = r"(?i)^(api[_-]?key|authorization|token)$"
SECRET_QUERY = ("api_key", "token", "authorization")
# --- end of fixed values ---


def feature_message() -> Column:
    """name=value lines of the feature columns, six decimals."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{f}="), F.format_string("%.6f", f)) for f in FEATURES))


def reply_probability(reply: Column, sentence_first: bool = True) -> Column:
    """A reply as a probability: a plain number, one in a sentence, or a JSON field; 0..1, else null."""
    plain = T.strip(reply).try_cast("double")
    from_json = F.try_variant_get(F.try_parse_json(reply), "$.probability", "double")
    ladder = (T.sentence_probability(reply), from_json) if sentence_first else (from_json, T.sentence_probability(reply))
    value = F.coalesce(F.when(plain.isNotNull() & ~F.isnan(plain), plain), *ladder)
    return F.when(value.between(0, 1), value)


def loop_ratio(texts: DataFrame, column: str = "text", chars: int = LOOP_CHARS) -> DataFrame:
    """``texts`` with the compression ratio of each text's last ``chars`` characters; null for shorter texts."""
    ship(texts.sparkSession)

    @F.pandas_udf("double")
    def ratio(tail: pd.Series) -> pd.Series:
        def one(t: str | None) -> float | None:
            raw = (t or "").encode()
            return len(zlib.compress(raw, LOOP_LEVEL)) / len(raw) if t and len(t) >= chars else None

        return tail.map(one)

    # Only the tail goes to Python.
    return texts.withColumn("loop_ratio", ratio(F.right(column, F.lit(chars))))


def loop_fired(ratio: Column, limit: float = LOOP_RATIO) -> Column:
    return F.coalesce(ratio < limit, F.lit(False))


def strikes(replies: DataFrame, limit: int = MAX_STRIKES) -> DataFrame:
    """replies(bundle_id, page_index, probability): strike counts unparseable replies so far; from the ``limit``-th on the bundle is exhausted."""
    w = Window.partitionBy("bundle_id").orderBy("page_index")
    counted = replies.withColumn("strike", F.sum(F.when(F.col("probability").isNull(), 1).otherwise(0)).over(w))
    return counted.withColumn("exhausted", F.col("strike") >= limit)


def fewshot_prompts(documents: DataFrame, examples: list[tuple[str, str]], limit: int = MAX_PROMPT) -> DataFrame:
    """documents(bundle_id, doc_index, lines array<struct<block_id, text>>): prompt, or the drop prompt_too_long."""
    shots = "\n\n".join(f"INPUT\n{i}\nOUTPUT\n{o}" for i, o in examples)
    body = F.array_join(F.transform("lines", lambda x: F.concat(x["block_id"], F.lit("\t"), T.fold(x["text"], 400))), "\n")
    prompt = F.concat(F.lit(shots + "\n\nINPUT\n"), body, F.lit("\nOUTPUT\n"))
    return documents.withColumn("prompt", F.when(F.length(prompt) <= limit, prompt)).withColumn("drop", F.when(F.col("prompt").isNull(), "prompt_too_long"))


def grounded_fields(replies: DataFrame) -> DataFrame:
    """replies(bundle_id, doc_index, known array<string>, fields map<string, struct<value, source_block_ids>>): one row a field.

    A field stays if it names at least one block and all are blocks of the document.
    """
    rows = replies.select("bundle_id", "doc_index", "known", F.explode("fields").alias("field", "f"))
    ids = F.coalesce("f.source_block_ids", F.array().cast("array<string>"))
    valid = (F.size(ids) > 0) & F.col("f.value").isNotNull()
    ok = valid & (F.size(F.array_except(ids, "known")) == 0)
    return rows.select("bundle_id", "doc_index", "field", F.when(ok, F.col("f.value")).alias("value"), F.when(~valid, "invalid_schema").when(~ok, "ungrounded").alias("drop"))


def complete(prompts: DataFrame, completion: Callable[[list[str]], list[str]], column: str = "prompt") -> DataFrame:
    """``prompts`` with ``reply`` by an injected batch completion; failures become null replies with an error."""
    ship(prompts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            replies: list[str | None] = [None] * len(texts)
            errors: list[str | None] = [None] * len(texts)
            todo = [k for k, t in enumerate(texts) if t is not None]
            try:
                for k, r in zip(todo, completion([texts[k] for k in todo]), strict=True):
                    replies[k] = r
            except Exception as e:  # one bad batch is reported on its rows, not lost with the job
                for k in todo:
                    errors[k] = f"{type(e).__name__}: {e}"[:200]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "reply", "error"])

    from pyspark.sql import types as S

    schema = S.StructType([*prompts.schema.fields, S.StructField("reply", S.StringType()), S.StructField("error", S.StringType())])
    return prompts.mapInArrow(work, schema)


def reject_secrets(config: object) -> None:
    """Raises if a field of a configuration, at any depth, is named like a secret, or if an address carries one."""
    if isinstance(config, dict):
        for k, v in config.items():
            if re.match(SECRET_FIELD, str(k)):
                raise ValueError(f"secrets don't belong in a configuration: {k}")
            reject_secrets(v)
    elif isinstance(config, list):
        for v in config:
            reject_secrets(v)
    elif isinstance(config, str) and "://" in config:
        url = urllib.parse.urlsplit(config)
        if url.username or url.password:
            raise ValueError("an address in a configuration may not name a user")
        if found := {k.lower() for k, _ in urllib.parse.parse_qsl(url.query, keep_blank_values=True)} & set(SECRET_QUERY):
            raise ValueError(f"an address in a configuration may not carry {sorted(found)[0]}")


def in_band(confidence: Column, low: float, high: float) -> Column:
    """Confidences that a confirmer is asked about, both ends included."""
    return F.coalesce(confidence.between(low, high), F.lit(False))


def with_fallback(pages: DataFrame, engines: list[tuple[str, frozenset[str], Callable[[list[str]], list[str]]]], column: str = "raw") -> DataFrame:
    """pages(page_class, <column>) with ``reply``, ``engine`` and ``error`` by the first engine that answers.

    Engines (name, classes, batch function) that name a page's class are asked in order, or all if none does.  An
    exception passes the batch on; an empty reply is final.
    """
    ship(pages.sparkSession)
    from pyspark.sql import types as S

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kinds = b.column(b.schema.get_field_index(column)).to_pylist(), b.column(b.schema.get_field_index("page_class")).to_pylist()
            replies, used, errors = [None] * len(texts), [None] * len(texts), [None] * len(texts)
            own = {k: [e for e in engines if k in e[1]] or list(engines) for k in set(kinds)}
            for k, candidates in own.items():
                todo = [i for i, x in enumerate(kinds) if x == k]
                for name, _, engine in candidates:
                    try:
                        answers = engine([texts[i] for i in todo])
                    except Exception as e:  # the next engine gets the batch
                        for i in todo:
                            errors[i] = f"{name}: {type(e).__name__}"
                        continue
                    for i, r in zip(todo, answers, strict=True):
                        replies[i], used[i], errors[i] = r, name, None
                    break
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in (replies, used, errors))], names=[*b.schema.names, "reply", "engine", "error"])

    schema = S.StructType([*pages.schema.fields, *(S.StructField(c, S.StringType()) for c in ("reply", "engine", "error"))])
    return pages.mapInArrow(work, schema)
