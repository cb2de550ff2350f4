"""Asking a model about the pages that look-ahead leaves open, with a page store and a budget per bundle.

One state machine serves batches and streams.  For each bundle it holds the
request texts of the pages that may still be asked about (window + 1), the calls
made, the strikes (requests without a readable answer), the pages without an
answer, and whether the bundle is closed.  A bundle starts with an empty budget.

A page is asked about if look-ahead leaves it open, it isn't the bundle's first,
has a confidence in the band, and the bundle isn't closed.  A request is repeated
after timeouts and the statuses of ``RETRY``, with pauses, ``max_retries`` times
at most.  The third strike closes the bundle: its open pages fall back to the
rule without a model.  Once ``max_calls`` requests are made (0: none may be), a
further one fails the run if ``strict``, or else is refused for its page alone.

Every page has an ``outcome``: null (not asked), ``split``, ``continue``,
``strike``, ``exhausted`` (the strike that closed the bundle), ``closed``,
``over_budget``; and ``attempts``, the posts made for it.
"""

from __future__ import annotations

import http.client
import json
import math
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pagestream.functions import text as T
from pagestream.operators.decision import MAX_STRIKES, reject_secrets
from pagestream.operators.lookahead import Fold, Rows, SplitConfig
from pagestream.shipping import ship

# --- fixed values ---
RETRY = (429, 502, 503)
PAUSES = (0.5, 1.0)
LOW, HIGH = 0.35, 0.74
# --- end of fixed values ---

KEY_VARIABLE = "PAGESTREAM_API_KEY"
REPLIES = "array<struct<status int, body string>>"
OUTCOME_SCHEMA = "bundle_id string, page_index int, split boolean, reason string, confidence double, outcome string, attempts int"
#: What a waiting page is stored as.
PAGE_FIELDS = [("bundle_id", pa.string()), ("page_index", pa.int32()), ("confidence", pa.float64()), ("page_num", pa.int32()), ("page_total", pa.int32()), ("message", pa.string()), ("replies", pa.list_(pa.struct([("status", pa.int32()), ("body", pa.string())])))]
PAGES = pa.schema(PAGE_FIELDS)


class ConfirmError(ValueError):
    """A confirmation that may not go on: bad configuration, refused request, budget."""


def _number(data: dict, key: str, default: float) -> float:
    value = data.get(key, default)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ConfirmError(f"{key} has to be a finite number")
    return float(value)


def _whole(data: dict, key: str, default: int) -> int:
    value = data.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ConfirmError(f"{key} has to be a whole number from 0 on")
    return value


def _text(data: dict, key: str, default: str | None = None) -> str:
    value = data.get(key, default)
    if not isinstance(value, str) or not value.strip():
        raise ConfirmError(f"{key} has to be a text")
    return value.strip()


@dataclass(frozen=True)
class CallConfig:
    """How a model is called.  ``max_calls`` is 0 unless it is set: nothing is sent by accident."""

    base_url: str = ""
    model: str = ""
    timeout_s: float = 30.0
    max_retries: int = 2
    max_calls: int = 0
    auth: str = "env"
    max_chars: int = 4000
    strict: bool = True

    @classmethod
    def load(cls, data: object) -> CallConfig:
        if not isinstance(data, dict):
            raise ConfirmError("decision has to be an object")
        reject_secrets(data)
        if data.get("auth", "env") not in ("env", "none"):
            raise ConfirmError(f"unknown auth {data['auth']!r}")
        return cls(_text(data, "base_url"), _text(data, "model"), _number(data, "timeout_s", 30.0), _whole(data, "max_retries", 2), _whole(data, "max_calls", 0), data.get("auth", "env"), _whole(data, "max_chars", 4000), bool(data.get("strict", True)))


@dataclass(frozen=True)
class ConfirmConfig:
    low: float = LOW
    high: float = HIGH
    task: str = "confirm_boundary"
    calls: CallConfig = field(default_factory=CallConfig)

    @classmethod
    def load(cls, data: object) -> ConfirmConfig:
        """From an object as a configuration file holds it; raises ConfirmError."""
        if not isinstance(data, dict):
            raise ConfirmError("the configuration has to be an object")
        low, high = _number(data, "low", LOW), _number(data, "high", HIGH)
        if low > high:
            raise ConfirmError("low may not be above high")
        return cls(low, high, _text(data, "task", "confirm_boundary"), CallConfig.load(data.get("decision")))


# --- transports: (request, attempt) to (status, body); status None: no answer in time ------------------------------


def recorded(request: dict, attempt: int) -> tuple[int | None, str]:
    """The page's own ``replies`` column, one entry an attempt; none left: no answer."""
    replies = request["replies"] or []
    if attempt >= len(replies):
        return None, ""
    return replies[attempt]["status"], replies[attempt]["body"] or ""


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


@dataclass(frozen=True)
class HttpTransport:
    """Chat completions over HTTP; the key comes from the executors' environment, never from the configuration."""

    config: CallConfig

    def __call__(self, request: dict, attempt: int) -> tuple[int | None, str]:
        if not self.config.base_url.startswith(("http://", "https://")):
            raise ConfirmError("only http and https addresses")
        headers = {"Content-Type": "application/json", "Accept": "application/json"}
        if self.config.auth == "env":
            if not os.environ.get(KEY_VARIABLE):
                raise ConfirmError(f"{KEY_VARIABLE} isn't set")
            headers["Authorization"] = f"Bearer {os.environ[KEY_VARIABLE]}"
        body = {"model": self.config.model, "temperature": 0, "messages": [{"role": "user", "content": request["message"]}]}
        post = urllib.request.Request(f"{self.config.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers, method="POST")
        try:
            with urllib.request.build_opener(_Stay()).open(post, timeout=self.config.timeout_s) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""
        except (OSError, http.client.HTTPException):
            return None, ""


# --- replies -------------------------------------------------------------------------------------------------------


def content_of(body: str) -> str | None:
    """The first choice's message of a completion."""
    try:
        found = json.loads(body)["choices"][0]["message"]["content"]
    except (ValueError, TypeError, KeyError, IndexError):
        return None
    return found if isinstance(found, str) else None


def _sentence(text: str) -> float | None:
    """The row form of ``functions.text.sentence_probability``."""
    numbers = list(re.finditer(T.NUMBER, text))
    if len(numbers) != 1:
        return None
    m = numbers[0]
    if re.search(r"[-−]\s*$", text[: m.start()]) or re.search(r"(?i)^\s*(?:%|percent\b|per cent\b)", text[m.end() :]):
        return None
    if "." not in m[0] and not re.search(T.CUE, text):
        return None
    return float(m[0]) if 0 <= float(m[0]) <= 1 else None


def probability_of(content: str) -> float | None:
    """A plain number in 0..1, the number of a sentence, or the ``probability`` of an object."""
    text = content.strip()
    try:
        if 0 <= (plain := float(text)) <= 1:
            return plain
    except ValueError:
        pass
    try:
        found = json.loads(text)
    except ValueError:
        return _sentence(text)
    if isinstance(found, str):
        return _sentence(found)
    p = found.get("probability") if isinstance(found, dict) else None
    return float(p) if isinstance(p, (int, float)) and math.isfinite(p) else None


# --- the state machine ---------------------------------------------------------------------------------------------


@dataclass
class Budget:
    """What a bundle has used up."""

    calls: int = 0
    strikes: int = 0
    closed: bool = False
    degraded: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Confirmer:
    config: ConfirmConfig
    transport: Callable[[dict, int], tuple[int | None, str]] = recorded
    sleep: Callable[[float], None] = time.sleep

    def ask(self, page: dict, budget: Budget) -> tuple[bool | None, str | None, int]:
        """(verdict, outcome, attempts) on an open page (page_index, confidence, message, replies)."""
        at, confidence, calls = page["page_index"], page["confidence"], self.config.calls
        if at == 0 or confidence is None or not self.config.low <= confidence <= self.config.high:
            return None, None, 0
        if budget.closed:
            return None, "closed", 0
        if budget.calls >= calls.max_calls:
            if calls.strict:
                raise ConfirmError(f"more than {calls.max_calls} calls, at page {at}")
            budget.degraded.append(at)
            return None, "over_budget", 0
        budget.calls += 1
        message = (page["message"] or "")[: calls.max_chars]
        body, attempts = None, 0
        while attempts <= calls.max_retries:
            status, got = self.transport({"task": self.config.task, "page_index": at, "message": message, "replies": page["replies"]}, attempts)
            attempts += 1
            if status == 200:
                body = got
                break
            if status is not None and status not in RETRY:
                raise ConfirmError(f"status {status} at page {at}")  # the body may hold what was sent
            if attempts <= calls.max_retries:
                self.sleep(PAUSES[min(attempts, len(PAUSES)) - 1])
        content = content_of(body) if body is not None else None
        p = probability_of(content) if content is not None else None
        if p is not None:
            return p >= 0.5, "split" if p >= 0.5 else "continue", attempts
        budget.strikes += 1
        budget.degraded.append(at)
        budget.closed = budget.strikes >= MAX_STRIKES
        return None, "exhausted" if budget.closed else "strike", attempts


class ConfirmFold(Fold):
    """The look-ahead fold whose open pages are asked about; ``bundle`` and ``budget`` are of the bundle in progress."""

    def __init__(self, split: SplitConfig, confirmer: Confirmer, anchor=None, before=None, waiting=None, bundle: str | None = None, budget: Budget | None = None):
        super().__init__(split, self, anchor, before, waiting)
        self.confirmer, self.bundle, self.budget = confirmer, bundle, budget or Budget()
        self.pages: pa.Table | None = None
        self.said: dict[int, tuple[str | None, int]] = {}

    def ask(self, k: int, rows: Rows) -> bool | None:
        page = self.pages.slice(k, 1).to_pylist()[0]
        if page["bundle_id"] != self.bundle:
            self.bundle, self.budget = page["bundle_id"], Budget()
        verdict, *said = self.confirmer.ask(page, self.budget)
        self.said[k] = tuple(said)
        return verdict

    def push(self, table: pa.Table, ending: bool = False) -> pa.Table:
        self.pages = table if self.waiting is None or not self.waiting.num_rows else pa.concat_tables([self.waiting, table])
        self.said = {}
        out = super().push(table, ending)
        rows = [self.said.get(k, (None, 0)) for k in range(out.num_rows)]
        return out.append_column("outcome", pa.array([r[0] for r in rows], pa.string())).append_column("attempts", pa.array([r[1] for r in rows], pa.int32()))


def page_columns(pages: DataFrame) -> list:
    """The machine's input; ``message`` and ``replies`` are null where ``pages`` hasn't them."""
    have = set(pages.columns)
    extra = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("message", "string"), ("replies", REPLIES))]
    return ["bundle_id", F.col("page_index").cast("int").alias("page_index"), F.col("confidence").cast("double").alias("confidence"), F.col("page_num").cast("int").alias("page_num"), F.col("page_total").cast("int").alias("page_total"), *extra]


def decide(pages: DataFrame, confirmer: Confirmer, split: SplitConfig = SplitConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``lookahead.decide`` with a confirmer: its columns, outcome, attempts and the ``keep`` columns.

    pages also have ``message`` (what is sent) or, for recorded replies, ``replies``.
    """
    ship(pages.sparkSession)
    dealt = pages.select(*page_columns(pages), *(F.col(c).alias(f"kept_{c}") for c in keep))
    schema = S.StructType([*S._parse_datatype_string(OUTCOME_SCHEMA).fields, *(S.StructField(c, dealt.schema[f"kept_{c}"].dataType) for c in keep)])
    order = ["bundle_id", "page_index", "split", "reason", "confidence", "outcome", "attempts", *(f"kept_{c}" for c in keep)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, empty = ConfirmFold(split, confirmer), None
        for b in batches:
            table = pa.Table.from_batches([b])
            empty = table.slice(0, 0)
            yield from fold.push(table).select(order).rename_columns(schema.names).to_batches()
        if empty is not None:
            yield from fold.push(empty, True).select(order).rename_columns(schema.names).to_batches()

    return dealt.repartition("bundle_id").sortWithinPartitions("bundle_id", "page_index").mapInArrow(work, schema)


def usage(decided: DataFrame) -> DataFrame:
    """bundle_id, calls, attempts, strikes, degraded pages: what a bundle's budget ended with."""
    asked = F.col("outcome").isin("split", "continue", "strike", "exhausted")
    struck = F.col("outcome").isin("strike", "exhausted")
    lost = F.when(F.col("outcome").isin("strike", "exhausted", "over_budget"), F.col("page_index"))
    return decided.groupBy("bundle_id").agg(F.count_if(asked).alias("calls"), F.sum("attempts").alias("attempts"), F.count_if(struck).alias("strikes"), F.array_sort(F.collect_list(lost)).alias("degraded"))

