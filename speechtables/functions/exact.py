"""The few scalar functions the JVM lacks, as Arrow-batched functions."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Utf-8 bytes of a text over its zlib-compressed bytes."""
    return text.map(lambda t: None if t is None else len(t.encode()) / len(zlib.compress(t.encode())))


def binary_round(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value, halves to even (built-in ``round`` works on decimals)."""

    @F.pandas_udf(T.DoubleType())
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, digits))

    return rounded(value)
