"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are filed by length into buckets (steps of ``step`` in length), and each bucket is cut into blocks
of about ``block_rows`` vectors, sorted by length. Queries form blocks too. First every query meets
the block of the longest vectors, which gives a lower bound of its k-th score. Then query and vector blocks
meet once each; in a pair, a query's bound divided by its length and the block's greatest length is its
local cosine threshold. Over 1, the block is left out. When it is high, coordinate pruning keeps vectors whose
largest coordinates lie in the interval the threshold allows; otherwise length pruning keeps vectors that
are long enough. What remains is verified with exact integer products, and a group of blocks passes on at most k
rows per query.

Defined cases: a null vector, or one with a null or non-finite component, takes no part; vectors are only
compared with vectors of the same dimension (empty ones score 0); rows with the query's own id are not
its candidates; an id that repeats among queries is asked once, with its least vector; repeated candidate rows
count each; ties go to the smaller id; null ids take no part; sums beyond a long are clipped to its range; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtables.llm.common import stored

_EPS = 1e-9
_MARGIN = 1e-6  # angles near 0 lose digits
_COORDINATES = 4
_HIGH = 0.5  # from this cosine threshold on, coordinates prune better than lengths


def usable(vector: str) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good, F.lit(False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer components as doubles, their number and length."""
    for batch in batches:
        vectors = [np.floor(256.0 * np.array(v, np.float64)) for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"),
                pa.array([len(v) for v in vectors], pa.int32()),
                pa.array([float(np.sqrt((v * v).sum())) for v in vectors], pa.float64()),
                pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary()),
            ],
            names=["vec_id", "dims", "norm", "vector"],
        )


_MEASURED = "vec_id bigint, dims int, norm double, vector binary"
_BLOCK = "block string, dims int, longest double, ids binary, norms binary, bounds binary, vectors binary"


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block, longest vector first."""
    ids, norms = table["vec_id"].to_numpy(), table["norm"].to_numpy()
    bounds = table["bound"].to_numpy()
    order = np.lexsort((ids, -norms))
    vectors = table["vector"].to_pylist()
    return pa.table(
        {
            "block": pa.array([table["block"][0].as_py()], pa.string()),
            "dims": pa.array([table["dims"][0].as_py()], pa.int32()),
            "longest": pa.array([norms[order][0]], pa.float64()),
            "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
            "norms": pa.array([norms[order].astype("<f8").tobytes()], pa.binary()),
            "bounds": pa.array([bounds[order].astype("<f8").tobytes()], pa.binary()),
            "vectors": pa.array([b"".join(vectors[i] for i in order)], pa.binary()),
        }
    )


def _blocks(rows: DataFrame, bucket: Column, block_rows: int) -> DataFrame:
    """Rows (vec_id, dims, norm, vector, bound) packed; a bucket is dealt over as many blocks as it needs."""
    filed = rows.withColumn("bucket", bucket)
    parts = F.ceil(F.count(F.lit(1)) / block_rows).cast("int")
    counts = filed.groupBy("dims", "bucket").agg(parts.alias("parts"))
    share = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    named = filed.join(counts, ["dims", "bucket"]).withColumn("block", F.concat_ws(":", "dims", "bucket", share))
    return named.select("block", "vec_id", "dims", "norm", "bound", "vector").groupBy("block").applyInArrow(_pack, _BLOCK)


class Block:
    def __init__(self, row: dict, prefix: str) -> None:
        self.ids = np.frombuffer(row[prefix + "ids"], "<i8")
        self.norms = np.frombuffer(row[prefix + "norms"], "<f8")
        self.bounds = np.frombuffer(row[prefix + "bounds"], "<f8")
        self.vectors = np.frombuffer(row[prefix + "vectors"], "<f8").reshape(len(self.ids), -1)


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while sums stay below 2**53, else in whole numbers."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if np.abs(rows).max() * max(np.abs(query).max(), 1.0) * rows.shape[1] < 2.0**53:
        return (rows @ query).astype(np.int64)
    whole = [int(x) for x in query]
    sums = [sum(int(a) * b for a, b in zip(row, whole)) for row in rows]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


def survivors(block: Block, unit: np.ndarray, query: np.ndarray, norm: float, bound: float) -> np.ndarray | slice:
    """Rows of ``block`` (``unit``: its vectors at length 1) whose product with ``query`` may reach ``bound``."""
    if norm == 0 or not bound > 0:
        return slice(None)
    local = bound / (norm * block.norms[0]) if block.norms[0] > 0 else np.inf
    if local > 1 + _EPS:
        return slice(0, 0)
    if local < _HIGH:
        return slice(0, int(np.searchsorted(-block.norms, -(bound / norm) * (1 - _EPS), "right")))
    opening = np.arccos(min(local * (1 - _EPS), 1.0))  # the widest angle to the query that can reach the bound
    direction = np.clip(query / norm, -1, 1)
    keep = block.norms >= (bound / norm) * (1 - _EPS)
    for f in np.argsort(-np.abs(direction), kind="stable")[:_COORDINATES]:
        angle = np.arccos(direction[f])
        least, most = np.cos(min(angle + opening, np.pi)), np.cos(max(angle - opening, 0.0))
        keep &= (unit[:, f] >= least - _MARGIN) & (unit[:, f] <= most + _MARGIN)
    return np.flatnonzero(keep)


def _best(queries: Block, block: Block, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best in one block: query ids, vector ids, scores."""
    asked, found, scores = [], [], []
    for i, query in enumerate(queries.vectors):
        rows = survivors(block, unit, query, queries.norms[i], queries.bounds[i])
        ids = block.ids[rows]
        score = _products(block.vectors[rows], query)
        other = ids != queries.ids[i]
        ids, score = ids[other], score[other]
        if len(ids) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[score >= least], score[score >= least]
        best = np.lexsort((ids, -score))[:k]
        asked.append(np.full(len(best), queries.ids[i]))
        found.append(ids[best])
        scores.append(score[best])
    return tuple(np.concatenate(x).astype(np.int64) for x in (asked, found, scores))


def _meet(k: int):
    """The query blocks and vector blocks of a pair of groups: each query's k best in that group of vectors."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        told = [np.zeros((3, 0), np.int64)]
        askers = [Block(row, "") for row in queries.to_pylist()]
        for row in blocks.to_pylist() if askers else []:
            block = Block(row, "")
            unit = block.vectors / np.where(block.norms > 0, block.norms, 1.0)[:, None]
            told.extend(np.stack(_best(each, block, unit, k)) for each in askers)
        asked, found, scores = np.concatenate(told, axis=1)
        order = np.lexsort((found, ~scores, asked))  # ~ turns the order without leaving the range of longs
        asked, found, scores = asked[order], found[order], scores[order]
        first = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.zeros(0, np.int64)
        place = np.arange(len(asked)) - np.repeat(first, np.diff(np.r_[first, len(asked)]))
        arrays = [pa.array(x[place < k]) for x in (asked, found, scores)]
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id bigint, vec_id bigint, score bigint"
#: Bytes of a group of query blocks and of vector blocks, about; most tasks that pairs of groups are dealt to.
_QUERY_BYTES, _VECTOR_BYTES, _TASKS = 16 << 20, 4 << 20, 1024


def _pairs(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Every query block meets every vector block of its dimension, group by group.

    A block is copied once for every group of the other side, and the copies meet by cogroups, which are always
    shuffled: a join would take a table of copies for as small as the blocks that they are copies of, and broadcast it.
    """
    size = F.sum(F.length("vectors") + F.length("ids")).cast("double")
    groups = lambda df, most, name: df.groupBy("dims").agg(F.greatest(F.ceil(size / most), F.lit(1)).cast("int").alias(name))
    both = groups(queries, _QUERY_BYTES, "q_groups").join(groups(blocks, _VECTOR_BYTES, "v_groups"), "dims")
    meetings = both.agg(F.sum(F.col("q_groups").cast("bigint") * F.col("v_groups"))).first()[0] or 0
    tasks = int(min(_TASKS, 2 * meetings + 1))
    keys = ["dims", "q_group", "v_group"]

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        placed = rows.join(F.broadcast(both), "dims").withColumn(f"{own}_group", F.pmod(F.xxhash64("block"), F.col(f"{own}_groups")))
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_groups").cast("bigint") - 1))
        return placed.select(F.col(f"{own}_group").cast("bigint").alias(f"{own}_group"), copies.alias(f"{other}_group"), *rows.columns)

    # a pair of groups is little data and much work: adaptive execution must not put many into one task
    left, right = (dealt(*side).repartition(tasks, *keys).groupBy(*keys) for side in ((queries, "q", "v"), (blocks, "v", "q")))
    return left.cogroup(right).applyInArrow(_meet(k), _FOUND)


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    step: float = 1.1,
    block_rows: int = 2048,
    query_rows: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``embeddings`` (vec_id, embedding)."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("vector"))
    measured = rows.select("vec_id", "vector").mapInArrow(_measure, _MEASURED)
    level = F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(step)))).otherwise(F.lit(-1))
    none = F.lit(float("-inf"))
    blocks = stored(_blocks(measured.withColumn("bound", none), level, block_rows), "topk-vectors")

    asked = rows.filter("asked").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = stored(asked.select("vec_id", "vector").mapInArrow(_measure, _MEASURED), "topk-queries")

    first = blocks.groupBy("dims").agg(F.max_by("block", F.struct("longest", "block")).alias("block")).select("block")
    longest = blocks.join(first, "block", "left_semi")
    plain = stored(_blocks(queries.withColumn("bound", none), F.lit(0), query_rows), "topk-plain")
    opened = _pairs(plain, longest, k)
    bounds = opened.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    known = queries.join(bounds, queries["vec_id"] == bounds["query_id"], "left").withColumn(
        "bound", F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(none)
    )
    bounded = stored(_blocks(known.select("vec_id", "dims", "norm", "vector", "bound"), F.lit(0), query_rows), "topk-asked")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = _pairs(bounded, blocks, k).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
