"""Generating long numbered sequences without building them in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 14


def explode_count(df: DataFrame, count: Column, name: str) -> DataFrame:
    """One row per number 0 … count-1, made in two steps so that no array exceeds ``PIECE`` items."""
    last = count.cast("bigint") - 1
    pieces = df.withColumn("__last", last).filter(F.col("__last") >= 0)
    pieces = pieces.withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last"), F.lit(PIECE).cast("bigint")))
    )
    numbers = F.sequence(F.col("__from"), F.least(F.col("__last"), F.col("__from") + PIECE - 1))
    return pieces.withColumn(name, F.explode(numbers)).drop("__last", "__from")
