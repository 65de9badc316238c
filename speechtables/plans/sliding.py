"""Sliding minimum over numbered rows, whatever the width of the window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def least_ahead(rows: DataFrame, keys: Sequence[str], at: str, value: str, first: int, width: int) -> DataFrame:
    """``keys, at, least``: the smallest ``value`` on the rows ``at + first`` to ``at + first + width - 1`` and its place, as
    ``struct(value, at)``; of equal values the first. A null counts as larger than any number.

    ``at`` is dense. Rows are cut into stretches of ``width``; a window covers the end of one stretch and the beginning of
    the next, so it is the lesser of a minimum to its stretch's end and one from its stretch's beginning. Both come from
    windows of at most ``width`` rows and meet in one grouped minimum. Windows that reach beyond the rows give no row;
    places before the first row may appear.
    """
    keys = list(keys)
    stretch = Window.partitionBy(*keys, F.expr(f"`{at}` div {width}")).orderBy(at)
    pair = F.struct(F.coalesce(F.col(value).cast("double"), F.lit(float("inf"))).alias("value"), F.col(at).alias("at"))
    begun = F.min(pair).over(stretch.rowsBetween(Window.unboundedPreceding, 0))
    left = F.min(pair).over(stretch.rowsBetween(0, Window.unboundedFollowing))
    marked = rows.select(*keys, at, left.alias("__left"), begun.alias("__begun"))
    halves = F.array(
        F.struct((F.col(at) - first).alias("at"), F.col("__left").alias("least")),
        F.struct((F.col(at) - first - width + 1).alias("at"), F.col("__begun").alias("least")),
    )
    return (
        marked.select(*keys, F.explode(halves).alias("__half"))
        .groupBy(*keys, F.col("__half.at").alias(at))
        .agg(F.min("__half.least").alias("least"), F.count(F.lit(1)).alias("__n"))
        .filter("__n = 2")
        .drop("__n")
    )
