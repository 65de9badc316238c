"""Helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtables.session import run_folder

#: Rows that lack a doc_id sort behind all others.
NO_ID = (1 << 63) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again.

    The shuffle files of the write are removed with its end; the table replaces them.
    """
    return stored_at(df, run_folder(df.sparkSession, name))


def stored_at(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """The same in a folder of the caller's choice."""
    spark = df.sparkSession
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


_RESIDENT: dict[str, Any] = {}


def resident(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` builds, kept in the worker for its next tasks; a worker keeps one such object at a time."""
    if name not in _RESIDENT:
        make_room()
        _RESIDENT[name] = make()
    return _RESIDENT[name]


def make_room() -> None:
    """Free what tasks of other operators have left in this worker, for steps that keep nothing themselves."""
    if _RESIDENT:
        _RESIDENT.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU library
        if trim is not None:
            trim(0)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id falls into no bucket."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def utf8(column: str) -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], most: int, size_of: str) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice stay near ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(size_of).to_pandas().str.len().fillna(0).to_numpy(np.int64)
        first = np.searchsorted(np.cumsum(lengths), np.arange(0, lengths.sum() + 1, most), "left")
        edges = np.unique(np.concatenate([[0], first, [batch.num_rows]]))
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(int(a), int(b - a))


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from Python lists or arrays in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
