"""Quality scores of texts by a factorisation machine over hashed words and structure statistics.

A text becomes a sparse vector: hashed words and word shapes (both scaled to unit length), and binned
structure statistics (lengths, character classes, repetition, lines). The machine adds a linear part
and, for every pair of features, the inner product of two short factor vectors. All pairs are scored
in time linear in the features, as half of (square of the sum minus sum of the squares).

The fit uses a sample of at most ``sample_rows`` labelled rows (a bound of the fit, chosen by hash);
scoring covers every text. Neither ids nor labels, languages or sources enter a score.

Defined cases: a null text counts as empty; an empty text is scored from its structure features;
repeated rows get equal scores; labels that are null or of unknown documents are left out; where the
labels hold one class only or none, every score is that class's share (0.5 without labels); labels
that repeat for a document are all used; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.llm.common import batch_of, id_bucket, make_room, utf8

WORDS = 1 << 13  # buckets of hashed words, and as many of shapes
BINS = 12
STATISTICS = 13
SIZE = 2 * WORDS + STATISTICS * BINS
THRESHOLD = 0.3
_CACHE = 400_000  # words whose buckets a task remembers

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SHAPE = bytes(
    65 if b in _UPPER else 97 if b in _LOWER or b in _HIGH else 48 if b in _DIGIT else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray = field(repr=False)
    factors: np.ndarray = field(repr=False)

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        own = self.factors[index] * value[:, None]
        total = own.sum(axis=0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - np.einsum("ij,ij->", own, own)))


class Features:
    """Text bytes to (feature numbers, values); keeps the buckets of common words."""

    def __init__(self) -> None:
        self._known: dict[bytes, tuple[int, int]] = {}

    def _buckets(self, word: bytes) -> tuple[int, int]:
        shape = word.translate(_SHAPE)
        short = _RUN.sub(rb"\1", shape)
        pair = crc32(word.lower()) % WORDS, WORDS + crc32(short) % WORDS
        if len(self._known) < _CACHE and len(word) <= 48:
            self._known[word] = pair
        return pair

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        known, make = self._known, self._buckets
        pairs = [known.get(w) or make(w) for w in counts]
        index, value = [], []
        if pairs:
            buckets = np.array(pairs, dtype=np.int64)
            weight = np.fromiter(counts.values(), np.float64, len(pairs))
            for column in (0, 1):
                found, at = np.unique(buckets[:, column], return_inverse=True)
                x = np.log1p(np.bincount(at, weights=weight))
                index.append(found)
                value.append(x / np.sqrt(x @ x))
        shares = _statistics(text, words, counts)
        bins = np.minimum((np.clip(shares, 0, 1) * BINS).astype(np.int64), BINS - 1)
        index.append(2 * WORDS + np.arange(STATISTICS) * BINS + bins)
        value.append(np.full(STATISTICS, 0.5))
        return np.concatenate(index), np.concatenate(value)


def _statistics(text: bytes, words: list[bytes], counts: Counter) -> np.ndarray:
    """Structure of a text as shares between 0 and 1."""
    n, w = max(len(text), 1), max(len(words), 1)
    lines = text.split(b"\n")
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / n
    again = sum(a == b for a, b in zip(words, words[1:]))
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines)
    return np.array(
        [
            np.log1p(len(text)) / 14,
            len(text) / w / 24,
            share(_UPPER) * 2,
            share(_DIGIT) * 4,
            share(_PUNCT) * 2,
            share(_HIGH) * 2,
            len(counts) / w,
            max(counts.values(), default=0) / w * 2,
            again / w,
            len(set(lines)) / len(lines),
            np.log1p(len(text) / len(lines)) / 12,
            ended / len(lines),
            np.log1p(len(lines)) / 10,
        ]
    )


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("label", pa.int32()), ("index", pa.binary()), ("value", pa.binary())])
    features = Features()
    for batch in batches:
        made = [features(t.as_py()) for t in batch.column("text")]
        yield batch_of(
            {
                "label": batch.column("label"),
                "index": [i.astype("<i4").tobytes() for i, _ in made],
                "value": [v.astype("<f4").tobytes() for _, v in made],
            },
            schema,
        )


def fit_machine(
    documents: DataFrame, labels: DataFrame, *, sample_rows: int = 4000, rank: int = 8, epochs: int = 24, seed: int = 7
) -> Machine:
    """Fit on ``labels`` (doc_id, label) and the texts of ``documents`` (doc_id, text).

    At most ``sample_rows`` labelled rows, the first ones by the hash of their id, are looked at; their
    vectors, each of at most SIZE entries, are what the driver gets.
    """
    chosen = (
        labels.select(F.col("doc_id"), F.col("label").cast("int").alias("label"))
        .filter("doc_id is not null and label is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample_rows)
    )
    texts = documents.select("doc_id", utf8("text").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text")
    got = rows.mapInArrow(_encode, "label int, index binary, value binary").toPandas()
    got = got.sort_values(["label", "index", "value"], kind="stable")
    target = got["label"].to_numpy() > 0
    if len(target) == 0 or target.all() or not target.any():
        share = float(target.mean()) if len(target) else 0.5
        odds = np.clip(share, 1e-6, 1 - 1e-6)
        return Machine(float(np.log(odds / (1 - odds))), np.zeros(SIZE), np.zeros((SIZE, rank)))
    index = [np.frombuffer(b, "<i4").astype(np.int64) for b in got["index"]]
    value = [np.frombuffer(b, "<f4").astype(np.float64) for b in got["value"]]
    return _descend(index, value, target.astype(np.float64), rank, epochs, seed)


def _descend(index: list, value: list, target: np.ndarray, rank: int, epochs: int, seed: int) -> Machine:
    """Logistic loss, both classes weighted alike, adaptive steps over small batches."""
    draw = np.random.default_rng(seed)
    bias, linear, factors = 0.0, np.zeros(SIZE), draw.normal(0, 0.02, (SIZE, rank))
    past_bias, past_linear, past_factors = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6)
    weight = np.where(target > 0, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    for _ in range(epochs):
        order = draw.permutation(len(target))
        for begin in range(0, len(order), 128):
            rows = order[begin : begin + 128]
            i, x = np.concatenate([index[r] for r in rows]), np.concatenate([value[r] for r in rows])
            starts = np.cumsum([0, *(len(index[r]) for r in rows[:-1])])
            row = np.repeat(np.arange(len(rows)), [len(index[r]) for r in rows])
            own = factors[i] * x[:, None]
            total = np.add.reduceat(own, starts, axis=0)
            square = np.add.reduceat((own * own).sum(axis=1), starts)
            raw = bias + np.add.reduceat(linear[i] * x, starts) + 0.5 * ((total * total).sum(axis=1) - square)
            slope = weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - target[rows]) / len(rows)
            g = slope[row] * x
            step_linear = np.bincount(i, g, SIZE) + 1e-5 * linear
            pairwise = g[:, None] * (total[row] - own)
            step_factors = np.stack([np.bincount(i, pairwise[:, f], SIZE) for f in range(rank)], axis=1) + 1e-5 * factors
            past_bias += slope.sum() ** 2
            past_linear += step_linear**2
            past_factors += step_factors**2
            bias -= 0.2 * slope.sum() / np.sqrt(past_bias)
            linear -= 0.2 * step_linear / np.sqrt(past_linear)
            factors -= 0.05 * step_factors / np.sqrt(past_factors)
    return Machine(float(bias), linear, factors)


def score_texts(documents: DataFrame, machine: Machine, *keep: str, score: str = "score") -> DataFrame:
    """The columns ``keep`` of every row of ``documents`` and its score between 0 and 1."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # SIZE weights and factors, a fixed size
    rows = documents.select(*keep) if "text" in keep else documents.select(*keep, "text")
    schema = documents.select(*keep).schema.add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        model, features = shared.value, Features()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            raw = np.array([model.raw(*features(t.as_py() or b"")) for t in texts], dtype=np.float64)
            scores = np.round(1 / (1 + np.exp(-np.clip(raw, -30, 30))), 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], names=[*keep, score])

    return rows.mapInArrow(run, schema)


def quality_scores(documents: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Every document's score; labels of rows whose id falls into bucket 0 of ``folds`` are not learnt."""
    train = labels.filter(id_bucket("doc_id", folds) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = score_texts(documents, fit_machine(documents, train), "doc_id")
    return scored.select(
        "doc_id",
        F.coalesce(id_bucket("doc_id", folds) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``documents`` whose score reaches the threshold, all columns kept."""
    train = labels.filter(id_bucket("doc_id", folds) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = score_texts(documents, fit_machine(documents, train), *documents.columns, score="__score")
    return scored.filter(F.col("__score") >= THRESHOLD).drop("__score")
