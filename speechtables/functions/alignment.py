"""Word-level edit distance of two texts."""

from __future__ import annotations

from itertools import zip_longest
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANE_BYTES, KEPT_BYTES = 1 << 11, 1 << 25  # of the columns of texts worked out together: of one, and of all that are kept
SHARE_ROWS = 1 << 10  # rows whose words are lists at a time


def edit_path(ref: list[str], hyp: list[str]) -> np.ndarray:
    """Cheapest way from ``ref`` to ``hyp``, one number per step: reference position in the upper 32
    bits, hypothesis position in the lower ones, both counted from 1, 0 for a gap.

    Bit-parallel dynamic programming: one column of the table is two integers with a bit per
    reference word (the table grows / shrinks by one at that row). Only every k-th column is kept;
    the ones between are computed again on the way back, so memory grows with the square root of
    the table. Among equally cheap steps back: match or substitution, deletion, insertion.
    """
    n, m = len(ref), len(hyp)
    full = (1 << n) - 1
    places: dict[str, int] = {}
    for at, word in enumerate(ref):
        places[word] = places.get(word, 0) | 1 << at

    def column(up: int, down: int, word: str) -> tuple[int, int, int]:
        same = places.get(word, 0) | down
        zero = (((same & up) + up) ^ up) | same
        right = ((down | ~(zero | up)) << 1) | 1
        return ((up & zero) << 1 | ~(zero | right)) & full, right & zero & full, zero

    stride = isqrt(m) + 1
    kept = [(full, 0)]
    up, down = full, 0
    for at, word in enumerate(hyp, 1):
        up, down, _ = column(up, down, word)
        if at % stride == 0:
            kept.append((up, down))

    steps = []
    i, j = n, m
    low, columns = m + 1, []
    while i and j:
        if j - 1 < low:
            low = (j - 1) // stride * stride
            columns = [(*kept[low // stride], 0)]
            for word in hyp[low : min(low + stride, m)]:
                columns.append(column(*columns[-1][:2], word))
        up, _, same = columns[j - low]
        if ref[i - 1] == hyp[j - 1] or not same >> (i - 1) & 1:
            steps.append(i << 32 | j)
            i, j = i - 1, j - 1
        elif up >> (i - 1) & 1:
            steps.append(i << 32)
            i -= 1
        else:
            steps.append(j)
            j -= 1
    steps.extend(k << 32 for k in range(i, 0, -1))
    steps.extend(range(j, 0, -1))
    return np.array(steps[::-1], dtype=np.int64)


def edit_paths(refs: list[list[int]], hyps: list[list[int]]) -> list[np.ndarray]:
    """``edit_path`` of many texts of word numbers: short ones share the integers of a column, a lane each."""
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(refs)
    group: list[int] = []
    lane = columns = 0
    for at in sorted(range(len(refs)), key=lambda at: (len(refs[at]), len(hyps[at]))):
        wide, long = len(refs[at]) // 8 + 1, max(columns, len(hyps[at]))
        if 2 * wide * len(hyps[at]) > KEPT_BYTES:
            found[at] = edit_path(refs[at], hyps[at])
            continue
        if group and (wide * (len(group) + 1) > LANE_BYTES or 2 * wide * (len(group) + 1) * long > KEPT_BYTES):
            _paths_in_lanes(group, lane, refs, hyps, found)
            group, long = [], len(hyps[at])
        group.append(at)
        lane, columns = wide, long
    if group:
        _paths_in_lanes(group, lane, refs, hyps, found)
    return found


def _paths_in_lanes(group: list[int], lane: int, refs, hyps, found) -> None:
    """The columns of ``edit_path`` for all texts of ``group`` side by side, ``lane`` bytes a text; a lane's highest bit stays
    clear, so that sums do not run over into the next one. All columns are kept."""
    size = lane * len(group)
    full = int.from_bytes((b"\xff" * (lane - 1) + b"\x7f") * len(group), "little")
    first = int.from_bytes((b"\x01" + bytes(lane - 1)) * len(group), "little")
    every = (1 << 8 * size) - 1
    absent, places = bytes(lane), []
    for at in group:
        seen: dict[int, int] = {}
        bit = 1
        for word in refs[at]:
            seen[word] = seen.get(word, 0) | bit
            bit <<= 1
        places.append({word: bits.to_bytes(lane, "little") for word, bits in seen.items()})

    ups, zeros = [b""], [b""]
    up, down = full, 0
    for words in zip_longest(*[hyps[at] for at in group]):
        same = int.from_bytes(b"".join([known.get(word, absent) for known, word in zip(places, words)]), "little") | down
        zero = (((same & up) + up) ^ up) | same
        right = ((down | every ^ (zero | up)) << 1) | first
        up, down = ((up & zero) << 1 | every ^ (zero | right)) & full, right & zero & full
        ups.append(up.to_bytes(size, "little"))
        zeros.append(zero.to_bytes(size, "little"))

    for place, at in enumerate(group):
        ref, hyp, begin = refs[at], hyps[at], place * lane
        i, j, steps = len(ref), len(hyp), []
        while i and j:
            p = i - 1
            if ref[p] == hyp[j - 1] or not zeros[j][begin + (p >> 3)] >> (p & 7) & 1:
                steps.append(i << 32 | j)
                i, j = p, j - 1
            elif ups[j][begin + (p >> 3)] >> (p & 7) & 1:
                steps.append(i << 32)
                i = p
            else:
                steps.append(j)
                j -= 1
        steps.extend(k << 32 for k in range(i, 0, -1))
        steps.extend(range(j, 0, -1))
        found[at] = np.array(steps[::-1], dtype=np.int64)


def _edit_steps(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """``edit_path`` of every row, on numbers in place of the words."""
    n, m = (pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False) for side in (ref, hyp))
    flat = pa.concat_arrays([side.flatten().cast(pa.large_string()) for side in (ref, hyp)])
    words = flat.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], n, m]).cumsum(dtype=np.int64).tolist()
    values, offsets = [], [0]
    for low in range(0, len(n), SHARE_ROWS):
        high = min(low + SHARE_ROWS, len(n))
        refs, hyps = ([words[ends[at] : ends[at + 1]].tolist() for at in range(low + side, high + side)] for side in (0, len(n)))
        paths = edit_paths(refs, hyps)
        values.extend(paths)
        offsets.extend(len(path) for path in paths)
    flat_steps = np.concatenate([np.zeros(0, dtype=np.int64), *values])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets).astype(np.int32)), pa.array(flat_steps))


# Declared nondeterministic so that a plan calls it once a row: no condition on its result is worked out ahead of it.
edit_steps = F.arrow_udf(_edit_steps, T.ArrayType(T.LongType())).asNondeterministic()
