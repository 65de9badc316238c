"""Near copies by the overlap of their word shingles: candidates by min-hash bands, then exact Jaccard.

Two rows are linked when the sets of their runs of ``words`` words have a Jaccard similarity of at least
``LEAST`` (4/5); ``overlap_classes`` returns the connected components.

Search. Rows with equal sets are one node. ``BANDS`` keys of ``WIDTH`` min-hashes each file a node; two sets of
similarity s share a key with probability 1 - (1 - s^WIDTH)^BANDS, which is 1 - 5e-8 at 0.8. Keys with one member
are dropped, and of keys with the same members one is kept. The members' shingles meet in a task, which counts
the common shingles of all pairs through posting lists and sends each member's least linked member, never pairs.
Keys of many or long members are cut into tiles that meet pairwise in separate groups; no link is lost.

Defined cases: texts of fewer words are one shingle; null, empty and blank texts have the empty set and form
one class; words are what lies between ASCII blanks, with A to Z lowered, as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.llm.common import batch_of, make_room, stored, utf8
from speechtables.llm.components import components

LEAST = (4, 5)
BANDS, WIDTH = 32, 4
TILE = 1024  # members of one side of a tile
_TILE_SHINGLES = 1 << 20
_STEP = 1 << 12  # shingles whose min-hashes are taken at once
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_MULTIPLIER, i + 1, 1 << 64) for i in range(n)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct runs of ``words`` words as sorted 64-bit hashes."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(t) for t in tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    total = np.full(n, width, np.uint64)
    for at, factor in enumerate(_powers(width)):
        total += each[at : at + n] * factor
    return np.unique(_mixed(total))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of shingles."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _STEP):
        np.minimum(least, (found[at : at + _STEP, None] * _FACTORS).min(axis=0), out=least)
    mixed = _mixed(least).reshape(BANDS, WIDTH) * _powers(WIDTH)
    return _mixed(mixed.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_MULTIPLIER)).view(np.int64)


def _sets(documents: DataFrame, words: int) -> DataFrame:
    """(row, fp, n, keys) of every row: the hash of its set, its size and its keys."""
    schema = pa.schema([("row", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            fp, n, keys = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), words)
                fp.append(xxhash.xxh64_intdigest(found.tobytes()))
                n.append(len(found))
                keys.append(band_keys(found) if len(found) else [])
            yield batch_of({"row": batch.column("row"), "fp": np.array(fp, np.uint64).view(np.int64), "n": n, "keys": keys}, schema)

    rows = documents.select("row", utf8("text").alias("text"))
    return rows.mapInArrow(run, "row bigint, fp bigint, n bigint, keys array<bigint>")


def _with_shingles(words: int):
    schema = pa.schema([("fp", pa.int64()), ("found", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words).tobytes() for t in batch.column("text")]
            yield batch_of({"fp": batch.column("fp"), "found": found}, schema)

    return run


def least_linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least number it reaches over pairs of Jaccard similarity ``LEAST`` or more."""
    size = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets))
    owner = np.repeat(label, size)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    posted = owner[np.argsort(term, kind="stable")]
    count = np.bincount(term)
    start = np.cumsum(count) - count
    edge = np.r_[0, np.cumsum(size)]
    over, under = LEAST
    for i in range(len(sets)):
        terms = term[edge[i] : edge[i + 1]]
        terms = terms[count[terms] > 1]
        if not len(terms):
            continue
        many = count[terms]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[terms], many)
        common = np.bincount(posted[at], minlength=len(sets))
        near = np.flatnonzero((common > 0) & (under * common >= over * (size[i] + size - common)))
        old = np.unique(np.r_[label[near], label[i]])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]
    return label


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, fp, found) sorted by key and tile: links (u, v) between nodes."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(fp: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        fp, label = np.array(fp, np.int64), least_linked(sets)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return batch_of({"u": fp[moved], "v": fp[label[moved]]}, schema)

    group, fps, sets = None, [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "tile", "fp")]
        for key, tile, fp, found in zip(*columns, batch.column("found")):
            if (key, tile) != group:
                if len(fps) > 1:
                    yield links(fps, sets)
                group, fps, sets = (key, tile), [], []
            fps.append(fp)
            sets.append(np.frombuffer(found.as_py(), np.uint64))
    if len(fps) > 1:
        yield links(fps, sets)


def _links(documents: DataFrame, nodes: DataFrame, words: int, tile_members: int) -> DataFrame:
    filed = nodes.select("fp", "n", F.explode("keys").alias("key"))
    shared = filed.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("n").alias("held"),
        F.bit_xor("fp").alias("same"),
        F.bit_xor(F.xxhash64("fp")).alias("same_too"),
    )
    shared = shared.filter("members > 1").groupBy("members", "same", "same_too").agg(F.min("key").alias("key"), F.max("held").alias("held"))
    parts = F.ceil(F.greatest(F.col("members") / tile_members, F.col("held") / _TILE_SHINGLES)).cast("int")
    members = stored(filed.join(shared.select("key", parts.alias("parts")), "key").select("key", "fp", "parts"), "overlap-members")
    wanted = nodes.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", "row")
    texts = documents.join(wanted, "row").select("fp", utf8("text").alias("text"))
    found = stored(texts.mapInArrow(_with_shingles(words), "fp bigint, found binary"), "overlap-shingles")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiled = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.least("own", "other") * F.lit(1 << 31).cast("bigint") + F.greatest("own", "other")
    rows = tiled.select("key", tile.alias("tile"), "fp").join(found, "fp")
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_compare, "u bigint, v bigint")


def overlap_classes(documents: DataFrame, words: int = 5, tile_members: int = TILE) -> DataFrame:
    """(row, root) of every row of ``documents`` (row bigint, unique, and text); rows of one class share the root."""
    prints = stored(_sets(documents, words), "overlap-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys")), "overlap-nodes")
    member = components(_links(documents, nodes, words, tile_members))
    return prints.join(member, prints["fp"] == member["node"], "left").select("row", F.coalesce("root", "fp").alias("root"))
