"""Time formats, unit changes and word anchors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sampling rate, feature frames per second, seconds per timestamp token.
SAMPLE_RATE = 16_000
FRAMES_PER_SECOND = 100
TOKEN_SECONDS = 0.02

FORMATS = ("s", "ms", "hms")


def seconds_to_ms(seconds: Column) -> Column:
    return seconds * 1000


def seconds_to_hms(seconds: Column) -> Column:
    """``HH:MM:SS.mmm`` with milliseconds cut off, hours unbounded."""
    hours = F.floor(seconds / 3600)
    rest = F.pmod(seconds, F.lit(3600.0))
    minutes = F.floor(rest / 60)
    left = F.pmod(rest, F.lit(60.0))
    millis = F.floor((left - F.floor(left)) * 1000)
    return F.format_string("%02d:%02d:%02d.%03d", hours, minutes, F.floor(left), millis)


def convert_timestamp(seconds: Column, target: Column, digits: int = 3) -> Column:
    """Number (for ``s`` and ``ms``) and text (for ``hms``) of a time; anything else is an error."""
    number = F.when(target == "s", F.round(seconds, digits)).when(target == "ms", F.round(seconds_to_ms(seconds), digits))
    known = target.isin(*FORMATS)
    return F.struct(
        number.alias("number"),
        F.when(target == "hms", seconds_to_hms(seconds)).alias("text"),
        F.when(~known | target.isNull(), F.concat(F.lit("Invalid conversion target: "), F.coalesce(target, F.lit("null")))).alias("error"),
    )


def format_timestamp(seconds: Column, always_hours: bool = False, marker: str = ".") -> Column:
    """``[HH:]MM:SS.mmm`` with milliseconds rounded; null for negative times."""
    millis = F.floor(seconds * 1000 + 0.5).cast("bigint")
    hours = F.floor(millis / 3_600_000)
    tail = F.format_string(
        f"%02d:%02d{marker}%03d", F.floor(millis / 60_000) % 60, F.floor(millis / 1000) % 60, millis % 1000
    )
    with_hours = F.concat(F.format_string("%02d:", hours), tail)
    text = with_hours if always_hours else F.when(hours > 0, with_hours).otherwise(tail)
    return F.when(seconds >= 0, text)


def word_anchor(start: Column, end: Column, option: str = "start") -> Column:
    """The point that decides which turn a word belongs to."""
    if option == "end":
        return end
    if option == "mid":
        return (start + end) / 2
    return start


def samples_to_seconds(samples: Column) -> Column:
    return samples / float(SAMPLE_RATE)


def seconds_to_samples(seconds: Column) -> Column:
    return F.floor(seconds * SAMPLE_RATE).cast("bigint")


def seconds_to_frames(seconds: Column, rate: int = FRAMES_PER_SECOND) -> Column:
    """Nearest frame, halves to the even one."""
    return F.bround(seconds * rate).cast("bigint")


def average_log_prob(score: Column, n_tokens: Column, length_penalty: float = 1.0) -> Column:
    """Mean log probability per token (end token included) from a length-normalised score."""
    return score * F.pow(n_tokens.cast("double"), F.lit(length_penalty)) / (n_tokens + 1)


def word_anomaly(probability: Column, duration: Column) -> Column:
    """How odd a word is: improbable, very short or very long."""
    return (
        F.when(probability < 0.15, 1.0).otherwise(0.0)
        + F.when(duration < 0.133, (F.lit(0.133) - duration) * 15).otherwise(0.0)
        + F.when(duration > 2.0, duration - 2.0).otherwise(0.0)
    )
