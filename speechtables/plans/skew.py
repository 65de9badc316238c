"""Lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 64


def spread_lookup(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_on: Column, how: str = "inner", fanout: int = FANOUT
) -> DataFrame:
    """Join a big table with a table of few rows per key.

    The big side is divided over ``fanout`` salts by ``spread_on``, the lookup is copied once per
    salt, so the rows of one key reach ``fanout`` tasks. The copies come from a join with the salts, not
    from an exploded array: an explode leaves the estimated size as it was, and a large table of copies
    would be broadcast as if it were the small one.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_on), F.lit(fanout)))
    copies = lookup.crossJoin(F.broadcast(lookup.sparkSession.range(fanout).toDF("__salt")))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
