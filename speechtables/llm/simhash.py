"""SimHash fingerprints and near-duplicate classes by bit-sliced comparison.

``fingerprints`` hashes every run of ``words`` words of a text and keeps, per bit, the majority.
``classes`` links fingerprints that differ in at most three bits and returns connected components.

Search. Equal fingerprints are one node. 64 bits are cut into five blocks; two fingerprints within three
bits agree in at least two of them, so each is filed under ten keys (a pair of blocks and its 25 or 26
bits). Keys with one member are dropped before anything is compared. Members of a key are laid out in
lanes of 64 as bit planes (word p holds bit p of 64 members); one pass over the planes updates 64 distances at
once with carry-save counters (two bit words and an overflow word), and lanes blocks in which every
distance has overflowed are left out of the rest. A key sends each member's least reachable member, never
pairs. Keys of more than ``lanes_per_tile`` members are cut into tiles that are compared pairwise in
separate groups, so that no group grows with the data and no link is lost.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any
other; a null doc_id counts for no class name (a class of such rows only is named null); repeated rows and
ids are kept as rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtables.llm.common import batch_of, make_room, stored, utf8
from speechtables.llm.components import components

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, width
RADIUS = 3
TILE = 4096
_STEP = 1 << 14  # shingles whose bits are summed at once
_PAIRS = 1 << 17  # row-lane pairs compared at once
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit majority fingerprint of one text."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    width = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(width + 1) - 1
    starts = ends - width
    if len(tokens) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _STEP):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint bigint) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            found = [simhash(t.as_py(), words, seed) for t in batch.column("text")]
            values = np.array(found, dtype=np.uint64).view(np.int64)
            yield batch_of({"doc_id": batch.column("doc_id"), "fingerprint": values}, schema)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fingerprint bigint")


def _keys() -> Column:
    """The ten keys of a fingerprint: the pair's number above the bits of its two blocks."""
    out = []
    for number, ((a, wa), (b, wb)) in enumerate(combinations(BLOCKS, 2)):
        left = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << wa) - 1))
        right = F.shiftrightunsigned("fp", b).bitwiseAND(F.lit((1 << wb) - 1))
        out.append(F.shiftleft(left, 13).bitwiseOR(right).bitwiseOR(F.lit(number << 27)))
    return F.array(*out)


def bit_planes(values: np.ndarray, word: np.ndarray, lane: np.ndarray, n_words: int) -> np.ndarray:
    """planes[p, w]: bit p of the values filed in word w, one lane each."""
    planes = np.zeros((64, n_words), np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    for p in range(64):
        planes[p, word[first]] = np.bitwise_or.reduceat(((values >> np.uint64(p)) & np.uint64(1)) << lane, first)
    return planes


def near_lanes(planes: np.ndarray, used: np.ndarray, values: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each (value, word) pair, the lanes of that word at most RADIUS = 3 bits away.

    Counters are carry-save: ``ones`` and ``twos`` hold a count up to three, ``over`` what went beyond.
    Pairs whose lanes are all over are dropped after every eighth plane.
    """
    answer = np.zeros(len(values), np.uint64)
    alive = np.arange(len(values))
    ones = np.zeros(len(values), np.uint64)
    twos, over = ones.copy(), ~used[word]
    for p in range(64):
        flip = np.where((values >> np.uint64(p)) & np.uint64(1), _FULL, np.uint64(0))
        differs = planes[p, word] ^ flip
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            stay = over != _FULL
            if not stay.all():
                alive, ones, twos, over, values, word = (x[stay] for x in (alive, ones, twos, over, values, word))
            if not len(alive):
                return answer
    answer[alive] = ~over
    return answer


def link_groups(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by ``group``: the rows linked within their group, and the least row each one reaches."""
    n = len(values)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    place = np.arange(n) - np.repeat(first, size)
    words_of = (size + 63) // 64
    word_base = np.r_[0, np.cumsum(words_of)[:-1]]
    word = np.repeat(word_base, size) + place // 64
    lane = (place % 64).astype(np.uint64)
    planes = bit_planes(values, word, lane, int(words_of.sum()))
    used = np.zeros(planes.shape[1], np.uint64)
    np.bitwise_or.at(used, word, np.uint64(1) << lane)
    first_row = np.zeros(planes.shape[1], np.int64)
    first_row[word[::-1]] = np.arange(n)[::-1]
    span, base = np.repeat(words_of, size), np.repeat(word_base, size)
    rows_kept, words_kept, masks = [], [], []
    edge = np.r_[0, np.cumsum(span)]
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(edge, edge[start] + _PAIRS, "right")) - 1)
        row = np.repeat(np.arange(start, stop), span[start:stop])
        other = np.arange(edge[start], edge[stop]) - np.repeat(edge[start:stop], span[start:stop]) + base[row]
        mask = near_lanes(planes, used, values[row], other)
        mask &= ~np.where(word[row] == other, np.uint64(1) << lane[row], np.uint64(0))
        hit = mask != 0
        rows_kept.append(row[hit])
        words_kept.append(other[hit])
        masks.append(mask[hit])
        start = stop
    row, other, mask = np.concatenate(rows_kept), np.concatenate(words_kept), np.concatenate(masks)
    label = np.arange(n)
    while len(row):
        before = label.copy()
        for bit in range(64):
            on = np.flatnonzero((mask >> np.uint64(bit)) & np.uint64(1))
            if len(on):
                np.minimum.at(label, row[on], label[first_row[other[on]] + bit])
        label = label[label]
        if (label == before).all():
            break
    linked = np.unique(row)
    return linked[label[linked] != linked], label[linked][label[linked] != linked]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, fp) sorted by key and tile: links (u, v) between fingerprints."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(key, tile, fp) -> pa.RecordBatch:
        change = np.r_[False, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]
        row, least = link_groups(np.cumsum(change), fp.view(np.uint64))
        return batch_of({"u": fp[row], "v": fp[least]}, schema)

    held = None
    for batch in batches:
        part = [batch.column(c).to_numpy() for c in ("key", "tile", "fp")]
        held = [np.concatenate(x) for x in zip(held, part)] if held is not None else part
        key, tile, _ = held
        whole = np.flatnonzero((key != key[-1]) | (tile != tile[-1])) if len(key) else []
        if len(whole):
            cut = int(whole[-1]) + 1  # the last group may go on in the next batch
            yield links(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield links(*held)


def near_links(nodes: DataFrame, lanes_per_tile: int = TILE) -> DataFrame:
    """Links (u, v) whose components are those of the fingerprints ``fp`` within three bits."""
    filed = nodes.select("fp", F.explode(_keys()).alias("key"))
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / lanes_per_tile).cast("int")
    members = filed.join(shared, "key").withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiled = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.least("own", "other") * F.lit(1 << 15).cast("bigint") + F.greatest("own", "other")
    rows = tiled.select("key", tile.alias("tile"), "fp")
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_compare, "u bigint, v bigint")


def classes(prints: DataFrame, lanes_per_tile: int = TILE) -> DataFrame:
    """Every row of ``prints`` (doc_id, fingerprint) with the least doc_id it is linked to, itself included."""
    nodes = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep"))
    nodes = stored(nodes, "simhash-nodes")
    member = components(near_links(nodes, lanes_per_tile))
    rooted = nodes.join(member, nodes["fp"] == member["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicate_classes(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``documents``."""
    return classes(stored(fingerprints(documents, words), "simhash-prints"))


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
