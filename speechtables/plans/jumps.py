"""Which rows a chain of jumps visits, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.session import cut_lineage


def visited(rows: DataFrame, keys: Sequence[str], seq: str, target: str) -> DataFrame:
    """``keys, seq`` of the rows that are reached from every key's first row.

    ``target`` is the row a row jumps to (a later one, or null at the end). Each round adds the rows one
    jump away and makes every jump twice as long, so a key with n rows takes at most log2(n) + 1 rounds.
    """
    keys = list(keys)
    jumps = cut_lineage(rows.select(*keys, F.col(seq).alias("__at"), F.col(target).alias("__to")))
    seen = cut_lineage(jumps.groupBy(*keys).agg(F.min("__at").alias("__at")))
    jumps = jumps.filter(F.col("__to").isNotNull())
    while True:
        reached = seen.join(jumps, [*keys, "__at"]).select(*keys, F.col("__to").alias("__at"))
        fresh = cut_lineage(reached.join(seen, [*keys, "__at"], "left_anti").distinct())
        if fresh.isEmpty():
            return seen.withColumnRenamed("__at", seq)
        seen = cut_lineage(seen.unionByName(fresh))
        onward = jumps.select(*keys, F.col("__at").alias("__to"), F.col("__to").alias("__then"))
        jumps = cut_lineage(jumps.join(onward, [*keys, "__to"]).select(*keys, "__at", F.col("__then").alias("__to")))
