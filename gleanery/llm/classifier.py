"""Quality classifier from weak labels.

Overlapping heuristics each call a document good, bad or neither. Expectation
maximisation over the counts of their vote patterns estimates how often each is right,
without any gold label, and gives every pattern a probability of being good. Those
probabilities are the labels of a linear scorer over hashed words and word shapes, which
then judges every document by its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import required, short_batches
from gleanery.llm.rules import SYMBOLS, counts_of
from gleanery.session import stored

GOOD, BAD, NEITHER = 0, 1, 2

#: (measure, good up to, bad from) in percent; between them a heuristic abstains.
HEURISTICS = (
    ("symbols", 3, 8),
    ("symbol_words", 5, 15),
    ("capitals", 15, 40),
    ("exclaiming", 5, 30),
    ("repeated_windows", 10, 30),
    ("same_as_previous", 3, 15),
    ("few_distinct", 70, 85),
    ("repeated_lines", 25, 50),
)
PATTERNS = 3 ** len(HEURISTICS)

#: Hashed features of the scorer.
WIDTH = 1 << 13
#: The scorer is fitted on at most so many documents per side, those with the smallest
#: hash of their id. The estimates above use every document.
SAMPLE = 2000
EM_ROUNDS = 200
FIT_ROUNDS = 200
RIDGE = 1e-4
#: A document is kept when its score, a probability of being good, is at least this.
LEAST_SCORE = 0.2
REMEMBERED = 100_000

#: What the estimates start from: a heuristic seldom calls a good document bad. It counts
#: as much as this share of all documents and so gives way to what they show.
PRIOR_WEIGHT = 0.1
PRIOR_BAD = 0.01

_ENDS_IN_SYMBOL = re.compile(b"[" + SYMBOLS + rb"](?=\s|\Z)")
_ENDS_IN_CALL = re.compile(rb"!(?=\s|\Z)")


def measures(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """The percentages that the heuristics look at, in their order."""
    n_words, chars, symbols, dup_lines, repeated, n_lines, capitals = counts_of(text)
    same = sum(map(bytes.__eq__, words[1:], words))
    # A short text has mostly distinct words; a long one is judged by a share of its length.
    few = 100 - 100 * len(set(words)) // min(n_words, 200) if n_words >= 20 else 0
    return (
        100 * symbols // max(chars, 1),
        100 * len(_ENDS_IN_SYMBOL.findall(text)) // max(n_words, 1),
        100 * capitals // max(chars, 1),
        100 * len(_ENDS_IN_CALL.findall(text)) // max(n_words, 1),
        100 * repeated // max(n_words, 1),
        100 * same // max(n_words, 1),
        max(few, 0),
        # Two equal lines of three say little.
        100 * dup_lines // max(n_lines, 4),
    )


def pattern_of(found: tuple[int, ...]) -> int:
    """The votes as one number, base three."""
    code = 0
    for value, (_, good, bad) in zip(found, HEURISTICS):
        code = code * 3 + (GOOD if value <= good else BAD if value >= bad else NEITHER)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """One row of votes per pattern."""
    return np.stack([codes // 3 ** (len(HEURISTICS) - 1 - k) % 3 for k in range(len(HEURISTICS))], axis=1)


def estimate(counts: dict[int, int]) -> np.ndarray:
    """Probability of being good for every possible pattern.

    Two hidden classes; given its class a document's votes are independent. Each class
    and heuristic has its own chances of good, bad and neither. The rounds start from
    documents nobody calls bad. Without documents every pattern is even.
    """
    codes = np.arange(PATTERNS)
    votes = votes_of(codes)
    weight = np.zeros(PATTERNS)
    weight[list(counts)] = list(counts.values())
    if not weight.sum():
        return np.full(PATTERNS, 0.5)
    prior = np.array([1 - 2 * PRIOR_BAD, PRIOR_BAD, PRIOR_BAD]) * PRIOR_WEIGHT * weight.sum()
    good = 0.95 * 0.2 ** (votes == BAD).sum(1)
    for _ in range(EM_ROUNDS):
        log = []
        for share, start in ((good, prior + 1), (1 - good, np.ones(3))):
            mass = weight * share
            chances = np.array([[mass[votes[:, k] == v].sum() for v in (GOOD, BAD, NEITHER)] for k in range(votes.shape[1])])
            chances = (chances + start) / (chances + start).sum(1, keepdims=True)
            log.append(np.log(mass.sum() + 1) + sum(np.log(chances[k])[votes[:, k]] for k in range(votes.shape[1])))
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        moved = np.abs(new - good)[weight > 0].max()
        good = new
        if moved < 1e-9:
            break
    return good


def _shape(word: bytes) -> bytes:
    """Kinds of characters in order, runs shortened: ``Word,`` is ``Aa,``."""
    kinds = []
    for b in word:
        kind = (
            b"a" if 97 <= b <= 122 else b"A" if 65 <= b <= 90 else b"0" if 48 <= b <= 57 else b"x" if b >= 128 else bytes([b])
        )
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
    return b"".join(kinds[:8])


class _Places(dict):
    """Two hashed places of a word: of its lower-cased letters and of its shape."""

    def __missing__(self, word: bytes) -> int:
        place = xxhash.xxh3_64_intdigest(b"w" + word.lower()) % WIDTH
        shape = xxhash.xxh3_64_intdigest(b"s" + _shape(word)) % WIDTH
        self[word] = both = place * WIDTH + shape
        return both


@lru_cache(maxsize=None)
def _level(measure: int, value: int) -> int:
    """Hashed place of a measure's level, ten percent wide."""
    return xxhash.xxh3_64_intdigest(b"m%d:%d" % (measure, min(value, 200) // 10)) % WIDTH


def features(words: list[bytes], found: tuple[int, ...], places: _Places) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places and values: words, shapes and measures, each of length one."""
    at = np.array([_level(k, v) for k, v in enumerate(found)], np.int64)
    parts = [(at, np.full(len(at), len(at) ** -0.5))]
    if words:
        if len(places) > REMEMBERED:
            places.clear()
        both = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        for hashed in (both // WIDTH, both % WIDTH):
            seen, times = np.unique(hashed, return_counts=True)
            value = np.log1p(times)
            parts.append((seen, value / np.sqrt((value**2).sum())))
    return np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])


@dataclass(frozen=True)
class Model:
    """Posterior per vote pattern, and the scorer."""

    posterior: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.bias + (self.weights[at] * value).sum()))))


def _read(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[bytes], tuple[int, ...]]]:
    for text in batch.column(column).cast(pa.binary()).to_pylist():
        text = text or b""
        words = text.split()
        yield words, measures(text, words)


def fit_scorer(rows: list[tuple[list[int], list[float], float]]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; both sides weigh the same."""
    label = np.array([r[2] for r in rows])
    if not len(rows) or label.max() < 0.5 or label.min() >= 0.5:
        return np.zeros(WIDTH), 10.0  # one side only: nothing to tell apart
    at = np.concatenate([np.array(r[0], np.int64) for r in rows])
    value = np.concatenate([np.array(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    side = np.where(label >= 0.5, 0.5 / (label >= 0.5).sum(), 0.5 / (label < 0.5).sum())
    weights, bias, seen, seen_bias = np.zeros(WIDTH), 0.0, np.full(WIDTH, 1e-8), 1e-8
    for _ in range(FIT_ROUNDS):
        margin = bias + np.bincount(row, weights[at] * value, len(rows))
        error = side * (1 / (1 + np.exp(-margin)) - label)
        slope = np.bincount(at, error[row] * value, WIDTH) + RIDGE * weights
        seen, seen_bias = seen + slope**2, seen_bias + error.sum() ** 2
        weights, bias = weights - 0.5 * slope / np.sqrt(seen), bias - 0.5 * error.sum() / np.sqrt(seen_bias)
    return weights, float(bias)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Estimate the heuristics on all documents and fit the scorer on a bounded sample.

    The driver gets one count per vote pattern (``PATTERNS`` at most) and the hashed
    features of at most ``2 * SAMPLE`` documents (``WIDTH`` numbers each at most). Of rows
    repeated under one id the sample may hold the one whose text has the smallest hash.
    """
    required(docs, id_col, text_col)
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [pattern_of(found) for _, found in _read(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.int32())], names=["id", "body", "pattern"])

    body = F.xxhash64(F.col(text_col).cast("string"))
    voted = docs.select(id_col, text_col, body).mapInArrow(vote, f"id {kind}, body long, pattern int")
    voted = stored(voted, "votes")
    counts = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior = estimate(counts)
    good = [p for p in counts if posterior[p] >= 0.5]
    chosen = {}
    named = voted.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("body", "pattern")).alias("first"))
    named = stored(named.select("id", "first.pattern"), "named_votes")
    for mine in (F.col("pattern").isin(good), ~F.col("pattern").isin(good)):
        rows = named.filter(mine).select("id", "pattern", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).collect()
        chosen.update({r.id: r.pattern for r in rows})

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for batch in batches:
            found = [features(words, m, places) for words, m in _read(batch, 1)]
            columns = [batch.column(0), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "at", "value"])

    rows = []
    if chosen:
        sample = docs.filter(F.col(id_col).isin(list(chosen))).groupBy(F.col(id_col).alias("id"))
        sample = sample.agg(F.min(F.struct(body.alias("body"), F.col(text_col).alias("text"))).alias("first"))
        rows = sample.select("id", "first.text").mapInArrow(feature, f"id {kind}, at array<long>, value array<double>").collect()
    rows = sorted(rows, key=lambda r: r.id)
    weights, bias = fit_scorer([(r.at, r.value, posterior[chosen[r.id]]) for r in rows])
    return Model(posterior, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_votes_bad, n_votes_good, posterior, score, kept) per row of ``docs``.

    A text without words, null included, has score 0 and is not kept. Repeated rows get
    equal scores. An empty table gives no rows; other columns are ignored.
    """
    required(docs, id_col, text_col)
    short_batches(docs.sparkSession)
    added = [("n_votes_bad", T.IntegerType()), ("n_votes_good", T.IntegerType()), ("posterior", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, t) for n, t in added], T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for batch in batches:
            codes, scores = [], []
            for words, found in _read(batch, 1):
                codes.append(pattern_of(found))
                scores.append(model.score(*features(words, found, places)) if words else 0.0)
            codes, scores = np.array(codes, np.int64), np.array(scores)
            votes = votes_of(codes).reshape(len(codes), len(HEURISTICS))
            columns = [
                batch.column(0),
                pa.array((votes == BAD).sum(1).astype(np.int32)),
                pa.array((votes == GOOD).sum(1).astype(np.int32)),
                pa.array(model.posterior[codes]),
                pa.array(scores),
                pa.array(scores >= LEAST_SCORE),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is high enough, with all their columns."""
    required(docs, text_col)
    short_batches(docs.sparkSession)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for batch in batches:
            good = [bool(w) and model.score(*features(w, m, places)) >= LEAST_SCORE for w, m in _read(batch, column)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
