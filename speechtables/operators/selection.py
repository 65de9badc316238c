"""Choosing hypotheses, gates on quality, language votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("recording_id",)

# Limits a decoded hypothesis is judged by, confidence a language vote needs.
COMPRESSION_LIMIT = 2.4
LOG_PROB_LIMIT = -1.0
NO_SPEECH_LIMIT = 0.6
CONFIDENT = 0.7


def needs_fallback(
    compression: float | None = COMPRESSION_LIMIT, log_prob: float | None = LOG_PROB_LIMIT, no_speech: float | None = NO_SPEECH_LIMIT
) -> Column:
    """Too repetitive or too improbable, unless it is silence. ``None`` switches a rule off."""
    false = F.lit(False)
    repetitive = false if compression is None else F.col("compression_ratio") > compression
    unlikely = false if log_prob is None else F.col("avg_logprob") < log_prob
    silent = false if no_speech is None else (F.col("no_speech_prob") > no_speech) & unlikely
    return (repetitive | unlikely) & ~silent


def choose_hypothesis(candidates: DataFrame, payload: Sequence[str], keys: Sequence[str] = ("segment_id",), **limits) -> DataFrame:
    """Per segment the first candidate that needs no fallback; if all do, the most probable among
    those that are not repetitive, else among all, reported with the last temperature."""
    compression = limits.get("compression", COMPRESSION_LIMIT)
    row = F.struct("temp_idx", "avg_logprob", "compression_ratio", "no_speech_prob", *payload)
    good = ~needs_fallback(**limits)
    calm = F.lit(False) if compression is None else F.col("compression_ratio") <= compression
    best = F.struct(F.col("avg_logprob"), -F.col("temp_idx"))
    picked = candidates.groupBy(*keys).agg(
        F.min_by(row, F.when(good, F.col("temp_idx"))).alias("__first"),
        F.max_by(row, F.when(calm, best)).alias("__calm"),
        F.max_by(row, best).alias("__any"),
        F.max("temp_idx").alias("__final"),
    )
    chosen = F.coalesce("__first", "__calm", "__any")
    return picked.select(
        *keys,
        F.coalesce("__first.temp_idx", "__final").alias("temp_idx"),
        *[chosen[c].alias(c) for c in ("avg_logprob", "compression_ratio", "no_speech_prob", *payload)],
        F.col("__first").isNull().alias("all_failed"),
    )


def speech_gate(rows: DataFrame, no_speech: float | None = NO_SPEECH_LIMIT, log_prob: float | None = LOG_PROB_LIMIT, low_log_prob: float | None = None) -> DataFrame:
    """Rows kept as speech: not silent (or probable all the same), and not hopelessly improbable."""
    if no_speech is None:
        return rows
    skip = F.col("no_speech_prob") > no_speech
    if log_prob is not None:
        skip = skip & ~(F.col("avg_logprob") > log_prob)
    if low_log_prob:
        skip = skip | (F.col("avg_logprob") < low_log_prob)
    return rows.filter(~skip)


def top_language(probabilities: DataFrame, keys: Sequence[str] = ("recording_id", "seg")) -> DataFrame:
    """Most probable language per segment; ``<|xx|>`` markers are taken off."""
    name = F.expr("substring(token, 3, length(token) - 4)")
    best = F.max_by(F.struct(name.alias("language"), F.col("prob")), F.struct("prob", "token"))
    return probabilities.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.language", "b.prob")


def vote_with_confidence(tops: DataFrame, keys: Sequence[str] = KEYS, confident: float = CONFIDENT) -> DataFrame:
    """A language all segments agree on with confidence, else the most frequent one (ties: higher mean
    probability, then earlier); reported with its mean probability."""
    per_language = tops.groupBy(*keys, "language").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("prob").alias("mean"),
        F.count_if(F.col("prob") > confident).alias("sure"),
        F.min("seg").alias("first"),
    )
    best = F.max_by(F.struct("language", "mean", "n", "sure"), F.struct("n", "mean", -F.col("first")))
    return (
        per_language.groupBy(*keys)
        .agg(best.alias("b"), F.sum("n").alias("segments"))
        .select(*keys, "b.language", F.col("b.mean").alias("confidence"), (F.col("b.sure") == F.col("segments")).alias("unanimous"))
    )


# Fixed value: peak or RMS below which audio counts as quiet.
QUIET = 0.01


def vote_or_silence(tops: DataFrame, levels: DataFrame, keys: Sequence[str] = KEYS, confident: float = CONFIDENT) -> DataFrame:
    """The vote for every recording of ``levels`` (``peak, rms``): ``silence`` where nothing was detected, or
    where the segments do not agree with confidence and the audio is quiet."""
    voted = levels.join(vote_with_confidence(tops, keys, confident), list(keys), "left")
    quiet = (F.col("peak") < QUIET) | (F.col("rms") < QUIET)
    silent = F.col("language").isNull() | (~F.col("unanimous") & quiet)
    return voted.select(
        *keys,
        F.when(silent, "silence").otherwise(F.col("language")).alias("language"),
        F.when(silent, 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def vote_first_sure(tops: DataFrame, threshold: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Language of the first segment above ``threshold``; without one the most frequent language (ties:
    the earlier) with its highest probability."""
    per_language = tops.groupBy(*keys, "language").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("prob").alias("top"),
        F.min("seg").alias("first"),
        F.min_by(F.struct("seg", "prob"), F.when(F.col("prob") > threshold, F.col("seg"))).alias("sure"),
    )
    voted = F.max_by(F.struct("language", F.col("top").alias("prob")), F.struct("n", -F.col("first")))
    sure = F.min_by(F.struct("language", F.col("sure.prob").alias("prob")), F.col("sure.seg"))
    out = per_language.groupBy(*keys).agg(F.coalesce(sure, voted).alias("b"))
    return out.select(*keys, "b.language", "b.prob")
