"""Joins of points and intervals inside a recording, spread over time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def points_in_intervals(
    points: DataFrame,
    at: str,
    intervals: DataFrame,
    start: str,
    end: str,
    keys: Sequence[str],
    width: int,
) -> DataFrame:
    """Inner join on ``start <= at <= end`` (integers). One (key, bucket) holds ``width`` time units.

    Only the interval side is copied, once per bucket it touches, so a long recording is spread
    over many tasks and no row of the point side is duplicated.
    """
    left = points.withColumn(_BUCKET, F.expr(f"`{at}` div {width}"))
    right = intervals.withColumn(
        _BUCKET, F.explode(F.sequence(F.expr(f"`{start}` div {width}"), F.expr(f"`{end}` div {width}")))
    )
    hit = F.col(at).between(F.col(start), F.col(end))
    return left.join(right, [*keys, _BUCKET]).filter(hit).drop(_BUCKET)


def time_block(time: Column | str, width: int) -> Column:
    """Block number of an integer time."""
    time = F.col(time) if isinstance(time, str) else time
    return F.floor(time / F.lit(width)).cast("bigint")
