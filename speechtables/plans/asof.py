"""As-of lookup: the next mark at or after a point, the last mark beyond the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.plans.intervals import time_block
from speechtables.plans.ordered import scan


def next_mark(
    points: DataFrame,
    at: str,
    marks: DataFrame,
    mark_at: str,
    keys: Sequence[str],
    order: Sequence[str],
    width: float,
    strict: bool = False,
    or_last: bool = True,
    name: str = "mark",
) -> DataFrame:
    """Adds ``name``, the struct of the first mark with ``mark_at >= at`` (``>`` when ``strict``).

    Points past every mark get the last one when ``or_last``. Both sides are sorted together in time
    blocks of ``width``; no pair of rows is formed, so neither long recordings nor dense turns
    multiply rows. ``order`` breaks ties among marks.
    """
    payload = F.struct(*[c for c in marks.columns if c not in keys])
    before, after = (1, 0) if strict else (0, 1)
    null_point = F.lit(None).cast(points.schema)
    left = points.select(
        *keys,
        F.col(at).cast("double").alias("__t"),
        F.lit(before).alias("__kind"),
        F.struct(*points.columns).alias("__point"),
    )
    right = marks.select(
        *keys,
        F.col(mark_at).cast("double").alias("__t"),
        F.lit(after).alias("__kind"),
        payload.alias("__mark"),
        *[F.col(c).alias(f"__o_{c}") for c in order],
    ).withColumn("__point", null_point)
    both = left.unionByName(right, allowMissingColumns=True)
    ordering = ["__t", "__kind", *[f"__o_{c}" for c in order]]
    kinds = {"upcoming": {"__next": F.col("__mark")}}
    if or_last:
        kinds["latest"] = {"__last": F.col("__mark")}
    scanned = scan(both, keys, ordering, time_block("__t", width), **kinds)
    found = F.coalesce("__next", "__last") if or_last else F.col("__next")
    return scanned.filter(F.col("__point").isNotNull()).select("__point.*", found.alias(name))
