"""Corpus preparation in five stages over ``documents``: quality, near copies, repeated strings, secrets, packing.

Each stage gets what the one before it kept, written as Parquet and read again. Its decisions take effect:
rejected documents go, one document of each group of near copies stays, repeated strings are cut out, secrets
are replaced by a mark, and what is left is packed into training windows.

Defined cases, for every stage: null, empty and blank texts stay (only a text that the cut leaves blank goes); null
ids and repeated rows are rows like any other, and ids need not be unique; ties go to the least (doc_id, row
number), null ids last; an empty table gives an empty table; long texts are taken whole; columns beyond those of
``documents`` may have any name and come through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtables.llm import overlap, packing, quality, secrets, simhash, suffixes
from speechtables.llm.common import read_table, stored
from speechtables.llm.components import components
from speechtables.session import run_folder, ship_package

#: SQL can express neither the classifier nor the connected components.
ORACLE_SQL = None


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _filtering(stage: Stage) -> Stage:
    """Run ``stage`` with the package on the workers and its documents' other columns under names of their own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        inner = [c if c in COLUMNS else f"other_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*inner).toDF(*docs.columns)

    return run


def _resized(docs: DataFrame, text) -> DataFrame:
    """The documents with another text and its length."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out


@_filtering
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


@_filtering
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each class by (doc_id, row number), rows without an id last; ids need not be unique.

    Classes are those of the bit-sliced fingerprints, joined by the links between texts that overlap by words.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "near-copy-rows")
    texts = rows.select(F.col("__row").alias("row"), "text")
    near = simhash.near_duplicate_classes(texts.withColumnRenamed("row", "doc_id"), words=3)
    alike = stored(overlap.overlap_classes(texts), "overlap-classes")
    least = alike.groupBy("root").agg(F.min("row").alias("v"))
    links = near.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    member = components(links.union(alike.join(least, "root").select(F.col("row").alias("u"), "v")))
    placed = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("__row").alias("row"))
    found = rows.select("__row", "doc_id").join(member, F.col("__row") == F.col("node"), "left")
    found = found.withColumn("root", F.coalesce("root", "__row"))
    first = found.groupBy("root").agg(F.min(placed)["row"].alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


@_filtering
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that a smaller document holds; those the cut leaves without a word go."""
    cut = suffixes.repeated_removed(docs)
    spent = (F.col("repeat_n_removed") > 0) & ~F.col("text").rlike(r"\S")
    return _resized(cut.filter(~spent).select(*docs.columns), F.col("text"))


@_filtering
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span that the ledger has for their blob replaced."""
    findings = secrets.scan(docs, run_folder(spark, "ledger"))
    marked = secrets.with_findings(docs, findings, "ledger_blob", "ledger_spans")
    return _resized(marked, secrets.redacted(F.col("text"), F.col("ledger_spans"))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows with their token ids."""
    ship_package(spark)
    return packing.packed(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_each),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
