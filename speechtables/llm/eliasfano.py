"""Elias-Fano sequences and a three-level n-gram trie made of them, for the n-grams of one shard.

A sequence keeps the low bits of each value as they are and its high bits as gaps in unary, about two bits for each
value. Levels are bytes that are mapped into memory when they are read; nothing is unpacked but the
numbers of values before each gap.

Values that rise only within a context (its children) are stored above the last value of the context before, so that the
whole level rises; a search is relative to its context's range. The third level does not name a word by its
id but by its place among the words that come before its context.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np

#: Codes are -log10 of a probability in these steps, rounded up: a stored probability is never too high.
STEPS = 1024
_HEAD = struct.Struct("<qqq")


def code_of(p: np.ndarray) -> np.ndarray:
    return np.ceil(-np.log10(p) * STEPS).astype(np.int64).clip(0, 0xFFFF)


def probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-np.asarray(code, np.float64) / STEPS)


def mapped(data: bytes) -> memoryview:
    """``data`` as a memory map."""
    held = mmap.mmap(-1, max(len(data), 1))
    held.write(data)
    return memoryview(held)[: len(data)]


def ef_bytes(values: np.ndarray) -> bytes:
    """A never falling sequence of numbers from 0 up to 2**56."""
    n = len(values)
    values = np.asarray(values, np.uint64)
    top = int(values[-1]) if n else 0
    width = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    gaps = np.zeros(n + (top >> width) + 1, np.uint8)
    gaps[high + np.arange(n)] = 1
    low = b""
    if width:
        bits = np.empty((n, width), np.uint8)
        for k in range(width):
            bits[:, k] = values >> np.uint64(k) & np.uint64(1)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return _HEAD.pack(n, width, len(gaps)) + np.packbits(gaps, bitorder="little").tobytes() + low + bytes(8)


class EliasFano:
    """A mapped sequence."""

    def __init__(self, data: memoryview):
        self.n, self._width, gaps = _HEAD.unpack_from(data)
        at = _HEAD.size + (gaps + 7) // 8
        bits = np.unpackbits(np.frombuffer(data[_HEAD.size : at], np.uint8), bitorder="little", count=gaps)
        ends = np.flatnonzero(bits == 0)
        #: values whose high bits are below h, for every h
        self._before = np.r_[0, ends - np.arange(len(ends))]
        self._low = np.ndarray(len(data) - at - 7, "<u8", data[at:], strides=(1,))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self._width:
            return np.zeros(len(i), np.int64)
        bit = i * self._width
        word = self._low[bit >> 3] >> (bit & 7).astype(np.uint64)
        return (word & np.uint64((1 << self._width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self._before, i, "right") - 1
        return high << self._width | self._lows(i)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the successor of each ``x`` (the least value that is not below it) among those of its high bits
        in [lo, hi), and whether it equals ``x``."""
        high = x >> self._width
        within = high < len(self._before) - 1
        high = np.where(within, high, 0)
        a = np.where(within, np.maximum(self._before[high], lo), hi)
        stop = np.where(within, np.minimum(self._before[high + 1], hi), hi)
        low = x & ((1 << self._width) - 1)
        end = stop.copy()
        open_ = np.flatnonzero(a < end)
        while len(open_):
            middle = (a[open_] + end[open_]) >> 1
            small = self._lows(middle) < low[open_]
            a[open_] = np.where(small, middle + 1, a[open_])
            end[open_] = np.where(small, end[open_], middle)
            open_ = open_[a[open_] < end[open_]]
        there = np.flatnonzero(a < stop)
        equal = np.zeros(len(x), bool)
        equal[there] = self._lows(a[there]) == low[there]
        return a, equal


def _raised(child: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Children of successive contexts (from ``starts`` on), each above the last child of the context before."""
    if not len(child):
        return child
    last = child[np.r_[starts[1:], len(child)] - 1]
    base = np.cumsum(last) - last
    return child + np.repeat(base, np.diff(np.r_[starts, len(child)]))


class Children:
    """A level whose ranges are given by pointers from the level above."""

    def __init__(self, pointers: memoryview, values: memoryview):
        self._pointers, self._values = EliasFano(pointers), EliasFano(values)

    def range_of(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pointers.get(parent), self._pointers.get(parent + 1)

    def find(self, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each child, whether it is there, and where its parent's range starts."""
        lo, hi = self.range_of(parent)
        base = np.zeros(len(lo), np.int64)
        inner = np.flatnonzero(lo > 0)
        base[inner] = self._values.get(lo[inner] - 1)
        place, there = self._values.find(child + base, lo, hi)
        return place, there, lo


def trie_levels(pair: np.ndarray, v: np.ndarray, w: np.ndarray, u: np.ndarray, pair_code: np.ndarray, code: np.ndarray) -> list[bytes]:
    """The levels of trigrams (u, v, w), given by rising distinct pairs (v, w) with ``pair_code``, and for each
    trigram the place of its pair (rising), u (rising within the pair) and ``code``."""
    context = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    number = np.cumsum(np.r_[False, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    own = number[pair]
    narrow = not len(u) or (int(u.max()) < 1 << 32 and len(context) < 1 << 31)
    order = np.argsort(own << 32 | u) if narrow else np.lexsort((u, own))
    fresh = np.r_[True, (np.diff(own[order]) != 0) | (np.diff(u[order]) != 0)] if len(u) else np.zeros(0, bool)
    place = np.empty(len(u), np.int64)
    place[order] = np.cumsum(fresh) - 1
    before_u, before_v = u[order][fresh], own[order][fresh]
    before_at = np.searchsorted(before_v, np.arange(len(context)))
    starts = np.flatnonzero(np.r_[True, np.diff(pair) != 0]) if len(pair) else np.zeros(0, np.int64)
    relative = place - before_at[own] if len(u) else place
    ends = lambda starts, n: np.r_[starts, n]
    return [
        ef_bytes(v[context]),
        ef_bytes(ends(context, len(v))),
        ef_bytes(_raised(w, context)),
        ef_bytes(ends(before_at, len(before_u))),
        ef_bytes(_raised(before_u, before_at)),
        ef_bytes(ends(starts, len(u))),
        ef_bytes(_raised(relative, starts)),
        _planes(pair_code),
        _planes(code),
    ]


def _planes(code: np.ndarray) -> bytes:
    """16-bit codes, all low bytes before all high ones."""
    return np.ascontiguousarray(code, "<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _code_at(planes: memoryview, i: np.ndarray) -> np.ndarray:
    low, high = np.frombuffer(planes, np.uint8).reshape(2, -1)
    return low[i] | high[i].astype(np.int64) << 8


class Trie:
    """Mapped levels: contexts v, their successors w, the words u before them, and the trigrams."""

    def __init__(self, levels: list[bytes]):
        maps = [mapped(level) for level in levels]
        self._contexts = EliasFano(maps[0])
        self._successors = Children(maps[1], maps[2])
        self._before = Children(maps[3], maps[4])
        self._trigrams = Children(maps[5], maps[6])
        self._pair_codes, self._codes = maps[7:]

    def pair_codes(self, i: np.ndarray) -> np.ndarray:
        return _code_at(self._pair_codes, i)

    def codes(self, i: np.ndarray) -> np.ndarray:
        return _code_at(self._codes, i)

    def pairs(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the context v and of the pair (v, w); -1: not there."""
        context, there = self._contexts.find(v, np.zeros(len(v), np.int64), np.full(len(v), self._contexts.n))
        context = np.where(there, context, -1)
        pair, at = np.full(len(v), -1), np.flatnonzero(there)
        place, found, _ = self._successors.find(context[at], w[at])
        pair[at[found]] = place[found]
        return context, pair

    def trigrams(self, context: np.ndarray, pair: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Number of the trigram (u before the pair); -1: not there."""
        out, at = np.full(len(u), -1), np.flatnonzero(pair >= 0)
        place, found, start = self._before.find(context[at], u[at])
        at, relative = at[found], (place - start)[found]
        place, found, _ = self._trigrams.find(pair[at], relative)
        out[at[found]] = place[found]
        return out
