"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: compatibility forms and accents go, look-alike letters of other
scripts become Latin ones, digits and signs that stand for letters become
those inside words, letters that are written alike (i, l, 1) become one, and
runs of three or more of a letter become one.  Lexicon and text are folded
alike.

The lexicon is learned from labelled documents: stems are whole words and word
beginnings of 4 to 8 characters whose documents are toxic far more often than
others; a stem's weight is its smoothed log odds.  A beginning is preferred to
the longer stems it explains.  The model's x is the weight of all matches at
word starts, less those in exception phrases, over the square root of the
length; a one-dimensional logistic fit turns x into a score.

Fitting takes at most ``train_rows`` labelled rows (chosen by hash of the id) in
the tasks, and at most ``lexicon_rows`` stems reach the driver.  Labels,
language, source and id are no inputs of a score.

Edge cases: null and empty texts score as texts without matches; null ids are
never labelled; repeated rows score alike; labels that are null are left out;
without any toxic training document all scores are 0; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ϲ": "c", "δ": "d", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŋ": "n", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
#: Digits and signs written for letters, inside words only.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
#: Phrases in which a stem is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser bracket", "pathetic fallacy")
_DROP = dict.fromkeys([*range(0x0300, 0x0370), *range(0x200B, 0x2010), 0x00AD, 0x2060, 0xFEFF])
_TABLE = _DROP | {ord(k): v for k, v in HOMOGLYPHS.items()}
_ALIKE = {ord("l"): "i"}
_SIGNS = "".join(SUBSTITUTIONS)
_TOKEN = re.compile(rf"[^\W_@$]?[\w{re.escape(_SIGNS)}]*[\w@$]")
_SUBSTITUTE = {ord(k): v for k, v in SUBSTITUTIONS.items()}
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W\d_]+")
MIN_STEM, MAX_STEM = 4, 8


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_TABLE)
    if any(c in text for c in _SIGNS):
        text = _TOKEN.sub(lambda m: m[0].translate(_SUBSTITUTE) if any(c.isalpha() for c in m[0]) else m[0], text)
    return _RUN.sub(r"\1", text.translate(_ALIKE))


@dataclass
class Lexicon:
    """Folded stems with weights (whole: the stem is a whole word), and the logistic fit."""

    stems: list[tuple[str, float, bool]]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -20.0
    slope: float = 0.0
    _made: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for stem, weight, whole in self.stems:
            made.add_word(stem, (len(stem), weight, whole))
        for phrase in self.exceptions:
            p = fold(phrase)
            made.add_word(p, (len(p), None, True))
        made.make_automaton()
        return made

    def measure(self, text: str | None) -> float:
        """Weight of the matches over the square root of the length in hundreds of words."""
        if not text or not self.stems:
            return 0.0
        if self._made is None:
            self._made = self.automaton()
        folded = fold(text)
        hits, spared = [], []
        for end, (size, weight, whole) in self._made.iter(folded):
            at = end - size + 1
            if at and folded[at - 1].isalnum() or whole and end + 1 < len(folded) and folded[end + 1].isalnum():
                continue
            (spared if weight is None else hits).append((at, end + 1, weight))
        if not hits:
            return 0.0
        best: dict[int, float] = {}
        for a, z, w in hits:
            if not any(x <= a and z <= y for x, y, _ in spared):
                best[a] = max(best.get(a, 0.0), w)
        # A word that a text repeats counts twice at most.
        counts = Counter(_WORD.match(folded, a)[0] for a in best)
        weights = {_WORD.match(folded, a)[0]: w for a, w in best.items()}
        return sum(w * min(2, counts[k]) for k, w in weights.items()) / math.sqrt(1 + folded.count(" ") / 100)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + self.slope * self.measure(text)))))


def _stems_of(text: str) -> set[str]:
    """Whole words (marked by a space behind) and word beginnings."""
    out = set()
    for w in set(_WORD.findall(fold(text))):
        if len(w) >= 3:
            out.add(w + " ")
        out.update(w[:k] for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1))
    return out


def stem_counts(rows: DataFrame) -> DataFrame:
    """(text, label) to stem, toxic, other: in how many documents of each kind it stands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(toxic.keys() | other.keys())
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64())], names=["stem", "toxic", "other"])
            toxic.clear()
            other.clear()
            return made

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if label else other).update(_stems_of(text or ""))
                if len(toxic) + len(other) > 400_000:
                    yield out()
        yield out()

    parts = R.map_arrow(rows.select("text", "label"), work, "stem string, toxic long, other long")
    return parts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn(rows: DataFrame, least_documents: int = 6, least_weight: float = 3.0, lexicon_rows: int = 4000) -> Lexicon:
    """A lexicon from (text, label) rows."""
    rows = rows.where("label is not null")
    n = {r.label: r.n for r in rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return Lexicon([])
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    found = stem_counts(rows).where(F.col("toxic") >= least_documents).withColumn("weight", weight).where(F.col("weight") >= least_weight)
    best = found.orderBy(F.col("toxic").desc(), F.col("weight").desc(), "stem").limit(lexicon_rows).collect()
    chosen: dict[str, tuple[int, float]] = {}
    for r in sorted(best, key=lambda r: (len(r.stem.rstrip()), r.stem)):
        # A stem is left out where a shorter beginning stands for at least its documents at no lower odds.
        bare = r.stem.rstrip()
        shorter = [chosen[bare[:k]] for k in range(MIN_STEM, len(bare) + 1) if bare[:k] in chosen]
        if not any(c >= r.toxic and w >= r.weight - 0.5 for c, w in shorter):
            chosen[r.stem] = (r.toxic, r.weight)
    # Of a word and its beginnings with the same documents, the whole word stays.
    for s in [s for s in chosen if s.endswith(" ")]:
        for k in range(MIN_STEM, len(s)):
            if s[:k] in chosen and chosen[s[:k]][0] == chosen[s][0]:
                del chosen[s[:k]]
    lexicon = Lexicon([(s.rstrip(), w, s.endswith(" ")) for s, (_, w) in sorted(chosen.items())])
    _fit(lexicon, rows)
    return lexicon


def _fit(lexicon: Lexicon, rows: DataFrame, steps: int = 40) -> None:
    """Bias and slope by Newton's method with a small ridge, on counts of x in steps of a tenth."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [round(min(lexicon.measure(t), 200.0), 1) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], names=["x", "label"])

    seen = [(r.x, r.label, r.n) for r in R.map_arrow(rows.select("text", F.col("label").cast("int").alias("label")), work, "x double, label int").groupBy("x", "label").agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, _, n in seen)
    a, b = 0.0, 0.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = 0.0, 1e-3 * total * b * 1e-2, 1e-9, 0.0, 1e-5 * total
        for x, y, n in seen:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            ga += n * (p - y)
            gb += n * (p - y) * x
            q = n * max(p * (1 - p), 1e-9)
            haa, hab, hbb = haa + q, hab + q * x, hbb + q * x * x
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-6:
            break
    lexicon.bias, lexicon.slope = a, max(b, 0.0)
    lexicon._made = None


@functools.lru_cache(maxsize=4)
def _held(key: tuple) -> Lexicon:
    stems, exceptions, bias, slope = key
    return Lexicon(list(stems), exceptions, bias, slope)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score."""
    R.prepare(docs.sparkSession)
    key = (tuple(lexicon.stems), lexicon.exceptions, lexicon.bias, lexicon.slope)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _held(key)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return R.map_arrow(R.keyed(docs, "text"), work, "doc_id long, score double").select(R.plain_id(), "score")


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """(text, label) of at most ``train_rows`` labelled documents whose id is not held out."""
    chosen = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    return docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("_id")).select("text", "label").dropDuplicates()  # train_rows bounds the broadcast


def held_out():
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    R.prepare(docs.sparkSession)
    rows = R.stage(training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), train_rows), "toxic-train")
    out = scored(docs, learn(rows))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
