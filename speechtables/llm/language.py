"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased and becomes symbols: letters fall into 63 classes (a to z and 37 classes of other
letters), every run of other characters is one boundary. For each language, all 4-grams of all training
texts are counted; the highest order keeps counts, lower orders count distinct left neighbours, and each
order interpolates with the next lower one through its own absolute discount. The model of a language is a
set of sorted arrays: 4-gram keys with their log probabilities, and shorter keys with probabilities and
back-off weights. A text goes to the language with the least cross-entropy per symbol; its score is a
logistic function of the margin to the second best, calibrated on a sample of at most ``calibration_rows``
training texts. ``rejected`` marks scores under ``reject_below``.

Counts cover every training text: tasks count their own texts and send packed arrays, which are summed per
language and key range. A language has at most 64**4 keys, which bounds the model whatever the input; tasks
look a 4-gram up once and keep its row.

Defined cases: null texts and texts without letters are ``und`` with score 0 and are not learned from; rows
without a language or id teach nothing; without any training text every row is ``und``; equal texts get
equal answers, ties go to the language first in order of name; repeated rows count as often as they occur; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.llm.common import id_bucket, slices

SURE = 400  # symbols after which the score grows no more
ORDER = 4
BITS = 6
_RANGES = 8
_FAN, _LEVELS = 128, 3  # tables summed at once, and levels: 128**3 tasks
_SLICE = 4 << 20


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter."""
    points = range(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in points), bool, 0x110000)
    table = np.where(letter, 27 + np.arange(0x110000) % 37, 0).astype(np.uint8)
    table[97:123] = np.arange(1, 27)
    return table


def symbols_of(text: str | None) -> np.ndarray:
    """Symbols of a text with a boundary before and after; empty if it has no letter."""
    found = _symbols()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")]
    found = np.concatenate([found, np.zeros(1, np.uint8)])
    found = found[np.r_[found[:1] > 0, (found[1:] > 0) | (found[:-1] > 0)]]
    return found if len(found) > 1 else found[:0]


def grams_of(symbols: np.ndarray, order: int = ORDER) -> np.ndarray:
    """One key per symbol: the symbol below its context, boundaries before the text."""
    padded = np.concatenate([np.zeros(order - 1, np.int32), symbols.astype(np.int32)])
    n, keys = len(symbols), np.zeros(len(symbols), np.int32)
    for k in range(order):
        keys = (keys << BITS) | padded[k : k + n]
    return keys


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in slices(batches, _SLICE, "text"):
        by_language: dict[str, list[np.ndarray]] = {}
        for language, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            by_language.setdefault(language, []).append(grams_of(symbols_of(text)))
        for language, keys in by_language.items():
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            if language in held:
                old = held[language]
                found, counts = _summed(np.concatenate([old[0], found]), np.concatenate([old[1], counts]))
            held[language] = found, counts
    part = TaskContext.get().partitionId()
    for language, (keys, counts) in held.items():
        edges = np.searchsorted(keys, np.arange(1, _RANGES) * (1 << BITS * ORDER) // _RANGES)
        for number, (k, c) in enumerate(zip(np.split(keys, edges), np.split(counts, edges))):
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language]), pa.array([number], pa.int32()), pa.array([part], pa.int64()), pa.array([k.astype("<i4").tobytes()]), pa.array([c.astype("<i8").tobytes()])],
                    names=["lang", "range", "part", "keys", "counts"],
                )


def _merge(table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(b, "<i4") for b in table["keys"].to_pylist()])
    counts = np.concatenate([np.frombuffer(b, "<i8") for b in table["counts"].to_pylist()])
    keys, counts = _summed(keys, counts)
    return pa.table(
        {
            "lang": pa.array([table["lang"][0].as_py()]),
            "range": pa.array([table["range"][0].as_py()], pa.int32()),
            "part": pa.array([table["part"][0].as_py()], pa.int64()),
            "keys": pa.array([keys.astype("<i4").tobytes()]),
            "counts": pa.array([counts.astype("<i8").tobytes()]),
        }
    )


@dataclass(frozen=True)
class KneserNey:
    """keys[k], logs[k]: grams of k + 1 symbols and their log probabilities; contexts[k], backs[k]: contexts
    of k + 1 symbols and the log weight of the next lower order after them. All keys ascend."""

    keys: tuple
    logs: tuple
    contexts: tuple
    backs: tuple

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        open_rows = np.arange(len(grams))
        for k in range(len(self.keys) - 1, -1, -1):
            wanted = grams[open_rows] & ((1 << BITS * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.keys[k], wanted), len(self.keys[k]) - 1)
            seen = self.keys[k][at] == wanted
            out[open_rows[seen]] += self.logs[k][at[seen]]
            open_rows, wanted = open_rows[~seen], wanted[~seen]
            if k and len(open_rows):
                context = wanted >> BITS
                at = np.minimum(np.searchsorted(self.contexts[k - 1], context), len(self.contexts[k - 1]) - 1)
                known = self.contexts[k - 1][at] == context
                out[open_rows[known]] += self.backs[k - 1][at[known]]
        return out


def fit_model(keys: np.ndarray, counts: np.ndarray) -> KneserNey:
    """The interpolated model of one language from its summed 4-gram counts. The lowest order covers
    every symbol by sharing its discount evenly."""
    levels = [(keys, counts)]
    for k in range(ORDER - 1, 0, -1):  # lower orders: how many symbols precede each gram
        suffix = levels[0][0] & ((1 << BITS * k) - 1)
        levels.insert(0, tuple(np.unique(suffix, return_counts=True)))
    out_keys, out_logs, contexts, backs = [], [], [], []
    lower = None
    for k, (found, count) in enumerate(levels):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context, at = np.unique(found >> BITS, return_inverse=True)
        total = np.bincount(at, count)
        weight = discount * np.bincount(at) / total
        if k == 0:
            full = np.full(1 << BITS, weight[0] / (1 << BITS))
            full[found] += (count - discount) / total[0]
            probability, found = full, np.arange(1 << BITS)
        else:
            short = np.searchsorted(out_keys[-1], found & ((1 << BITS * k) - 1))
            probability = (count - discount) / total[at] + weight[at] * lower[short]
            contexts.append(context)
            backs.append(np.log(weight))
        out_keys.append(found)
        out_logs.append(np.log(probability))
        lower = probability
    return KneserNey(tuple(out_keys), tuple(out_logs), tuple(contexts), tuple(backs))


@dataclass(frozen=True)
class Identifier:
    languages: tuple
    models: tuple
    slope: float = 1.0
    offset: float = 0.0


class _Scorer:
    """Sums of log probabilities of texts; every 4-gram is looked up once per task."""

    def __init__(self, identifier: Identifier) -> None:
        self._models = identifier.models
        self._row = np.full(1 << BITS * ORDER, -1, np.int32)
        self._logs = np.zeros((0, len(self._models)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        grams = [grams_of(symbols_of(t)) for t in texts]
        size = np.array([len(g) for g in grams], np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, np.int32)
        rows = self._row[every]
        fresh = np.unique(every[rows < 0])
        if len(fresh):
            self._row[fresh] = np.arange(len(fresh)) + len(self._logs)
            self._logs = np.concatenate([self._logs, np.stack([m.log_probability(fresh) for m in self._models], axis=1)])
            rows = self._row[every]
        sums = np.zeros((len(texts), len(self._models)))
        some = np.flatnonzero(size)
        if len(some):
            starts = (np.cumsum(size) - size)[some]
            edges = np.r_[starts, len(every)]
            for i, a, b in zip(some.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                sums[i] = self._logs[rows[a:b]].sum(axis=0)
        return sums, size


def _margins(sums: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each text and how much it gains per symbol, long texts counting more: up to ``SURE``
    symbols count, beyond them a text is no surer. The entropy itself is that of the whole text."""
    mean = sums / np.maximum(size, 1)[:, None]
    best = mean.argmax(axis=1)
    top = mean[np.arange(len(mean)), best]
    rest = mean.copy()
    rest[np.arange(len(mean)), best] = -np.inf
    second = rest.max(axis=1) if mean.shape[1] > 1 else top - 1
    return best, (top - second) * np.sqrt(np.minimum(size, SURE))


def fit_identifier(rows: DataFrame, calibration_rows: int = 2000) -> Identifier:
    """Learn from rows (text, lang); rows without a language are left out."""
    rows = rows.select("text", "lang").filter("text is not null and lang is not null")
    schema = "lang string, range int, part bigint, keys binary, counts binary"
    merged = rows.mapInArrow(_count, schema)
    for _ in range(_LEVELS):  # a tree: no group gets more than _FAN tables
        merged = merged.withColumn("part", F.expr(f"part div {_FAN}")).groupBy("lang", "range", "part").applyInArrow(_merge, schema)
    got: dict[str, list] = {}
    for row in merged.toLocalIterator():  # at most 64**4 keys a language
        got.setdefault(row["lang"], []).append((np.frombuffer(row["keys"], "<i4"), np.frombuffer(row["counts"], "<i8")))
    languages = tuple(sorted(got))
    models = []
    for language in languages:
        models.append(fit_model(*_summed(*(np.concatenate(x) for x in zip(*got[language])))))
    plain = Identifier(languages, tuple(models))
    if not languages:
        return plain
    named = rows.withColumn("hash", F.xxhash64("text"))
    chosen = named.select("hash", "lang").distinct().orderBy("hash", "lang").limit(calibration_rows)
    sample = named.join(F.broadcast(chosen), ["hash", "lang"]).select("hash", "lang", "text")
    each = _scored(sample, plain, "hash", "lang").groupBy("hash", "lang").agg(F.min("pred").alias("pred"), F.min("margin").alias("margin"))
    scored = each.orderBy("hash", "lang").toPandas()
    right = (scored["lang"] == scored["pred"]).to_numpy()
    return Identifier(languages, tuple(models), *_calibrated(scored["margin"].to_numpy(), right))


def _calibrated(margin: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small penalty."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])
        w = w + np.linalg.solve(hessian, x.T @ (right - p) - 1e-2 * (w - np.array([1.0, 0.0])))
    return float(max(w[0], 1e-3)), float(w[1])


def _scored(rows: DataFrame, identifier: Identifier, *keep: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(identifier)
    schema = rows.select(*keep).schema.add("pred", "string").add("margin", "double").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = _Scorer(own) if own.languages else None
        for part in slices(batches, _SLICE, "text"):
            texts = part.column("text").to_pylist()
            if scorer is None:
                pred, margin, score = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            else:
                sums, size = scorer(texts)
                best, margin = _margins(sums, size)
                score = 1 / (1 + np.exp(-np.clip(own.slope * margin + own.offset, -30, 30)))
                score = np.round(np.where(size > 0, score, 0.0), 6)
                pred = [own.languages[b] if n else "und" for b, n in zip(best, size)]
            arrays = [*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(margin), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "pred", "margin", "score"])

    return rows.mapInArrow(run, schema)


def languages_of(documents: DataFrame, *, folds: int = 3, held: int = 1, reject_below: float = 0.5, calibration_rows: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row; rows of bucket ``held`` teach nothing."""
    bucket = id_bucket("doc_id", folds)
    identifier = fit_identifier(documents.filter(bucket != held), calibration_rows)
    scored = _scored(documents.select("doc_id", "text"), identifier, "doc_id")
    return scored.select(
        "doc_id",
        F.coalesce(bucket == held, F.lit(False)).alias("held_out"),
        F.col("pred").alias("lang_pred"),
        "score",
        (F.col("score") < reject_below).alias("rejected"),
    )
