"""Hierarchical packing of documents into training windows of several lengths.

Every document is tokenised, closed by an end id, and cut into whole windows of the longest tier plus a rest.
Rests are routed to the tier they fit. From the longest tier down, each rest opens a window; the gap behind
it is closed with the largest shorter rests that fit, and, where none fits exactly, with the front of a
rest that is cut. All windows are therefore full; only what remains when a block of documents has no
rest left is split into powers of two. Windows of a block are dealt, longest first, into step groups of
equally many tokens.

Packing needs no shuffle: each task packs the blocks (about ``block_tokens`` tokens) of its own input
partition, so memory is bounded and a lost task can be redone on its own. Window numbers carry the
partition's number. Token ids are those of the tokenizer file; words and word pieces are looked up in bounded
caches, which changes no id.

Defined cases: a null or empty text is one end id; an empty table gives no rows; repeated rows are packed
each; a null doc_id stays null; other columns are ignored; special strings in texts are ordinary text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from speechtables.llm.common import resident

TIERS = (256, 512, 1024, 2048)
END_ID = 1
_WORDS, _PIECES = 250_000, 500_000  # cached words and pieces per task
_LONG = 48  # longer words are not cached

# The pre-tokeniser's pattern of word_bpe_49k.json on lower-case Latin-1 text (fixed by that file).
_LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Encoder:
    """Token ids of texts as little-endian 16-bit bytes, equal to the tokenizer's own ids.

    Latin-1 texts (where lower-casing and composition are per character) are looked up word by word;
    all other texts go through the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("the packer stores ids in 16 bits")
        self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self._closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            ids = np.array(self._tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u2")
            ends = np.flatnonzero(self._closes[ids]) + 1
            if len(ends) == len(part):
                raw, start = ids.tobytes(), 0
                for piece, end in zip(part, (ends * 2).tolist()):
                    self._pieces[piece] = raw[start:end]
                    start = end
            else:
                self._pieces.update((piece, self._whole(piece)) for piece in part)

    def __call__(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        unknown: set[str] = set()
        for text in texts:
            if (not text.isascii() and max(text) > "\xff") or _SEPARATORS.search(text):
                split.append(None)
                continue
            words = text.split()
            unknown.update(set(words).difference(self._words))
            split.append(words)
        cut = {word: _LATIN.findall(word.lower()) for word in unknown}
        pieces = {p for parts in cut.values() for p in parts}
        self._learn_pieces([p for p in pieces if p not in self._pieces])
        known = self._pieces
        self._words.update((word, b"".join([known[p] for p in parts])) for word, parts in cut.items())
        lookup = self._words.__getitem__
        out = [self._whole(t) if w is None else b"".join(map(lookup, w)) for t, w in zip(texts, split)]
        for cache, most in ((self._words, _WORDS), (self._pieces, _PIECES)):
            for key in list(cache)[most:] if len(cache) > most else ():
                del cache[key]
        for word in unknown:
            if len(word) > _LONG:
                self._words.pop(word, None)
        for piece in pieces:
            if len(piece) > _LONG:
                known.pop(piece, None)
        return out


def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, until another operator needs the room."""
    return resident(f"packing {path}", lambda: Encoder(path))


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, window, offset) that cover every token once, and the windows'
    lengths, all of them powers of two if the tiers are."""
    longest = tiers[-1]
    pieces, windows = [], []
    pool: dict[int, list[tuple[int, int]]] = {}
    present: list[int] = []  # lengths in the pool, ascending

    def put(length: int, rest: tuple[int, int]) -> None:
        if length not in pool:
            pool[length] = []
            insort(present, length)
        pool[length].append(rest)

    def take(at: int) -> tuple[int, int, int]:
        length = present[at]
        document, start = pool[length].pop()
        if not pool[length]:
            del pool[length], present[at]
        return document, start, length

    def emit(parts: list[tuple[int, int, int]], size: int) -> None:
        offset = 0
        for document, start, length in parts:
            pieces.append((document, start, length, len(windows), offset))
            offset += length
        windows.append(size)

    for document, length in enumerate(lengths):
        whole = length // longest
        for k in range(whole):
            emit([(document, k * longest, longest)], longest)
        if length % longest:
            put(length % longest, (document, whole * longest))
    for below, tier in reversed(list(zip((0, *tiers), tiers))):
        while present and present[-1] > below:
            parts = [take(len(present) - 1)]
            gap = tier - parts[0][2]
            while gap and present:
                at = bisect_right(present, min(gap, below or gap)) - 1
                if at >= 0:
                    parts.append(take(at))
                else:  # nothing fits whole: cut the largest rest of a shorter tier, or else of this one
                    shorter = bisect_left(present, below + 1) - 1
                    document, start, length = take(shorter if shorter >= 0 and present[shorter] > gap else len(present) - 1)
                    used = min(gap, length)
                    if length > used:
                        put(length - used, (document, start + used))
                    parts.append((document, start, used))
                gap -= parts[-1][2]
            if not gap:
                emit(parts, tier)
                continue
            for power in range(tier.bit_length(), -1, -1):  # the block's last tokens
                if (tier - gap) >> power & 1:
                    front, missing = [], 1 << power
                    while missing:
                        document, start, length = parts.pop(0)
                        if length > missing:
                            parts.insert(0, (document, start + missing, length - missing))
                            length = missing
                        front.append((document, start, length))
                        missing -= length
                    emit(front, 1 << power)
    return pieces, windows


def step_groups(windows: list[int], group_tokens: int) -> np.ndarray:
    """A step group for every window: longest first, each group as many tokens as the next."""
    sizes = np.array(windows, np.int64)
    order = np.argsort(-sizes, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    groups = np.empty(len(sizes), np.int64)
    groups[order] = before // group_tokens
    return groups


def packed(
    documents: DataFrame,
    *,
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = 32_768,
    block_tokens: int = 1 << 22,
    ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the
    window's length), step_group, and with ``ids`` the piece's ids as little-endian 32-bit bytes."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        base = TaskContext.get().partitionId() << 40
        window, group = base, base
        held_ids: list = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal window, group, tokens
            lengths = [len(h) // 2 for h in held]
            pieces, windows = pack(lengths, tiers)
            groups = step_groups(windows, group_tokens)
            columns: list[list] = [[] for _ in range(10)]
            for document, start, length, number, offset in pieces:
                body = np.frombuffer(held[document], "<u2")[start : start + length].astype("<u4").tobytes()
                row = (
                    held_ids[document],
                    start,
                    length,
                    zlib.crc32(body),
                    lengths[document],
                    window + number,
                    offset,
                    windows[number],
                    group + int(groups[number]),
                    body if ids else None,
                )
                for column, value in zip(columns, row):
                    column.append(value)
            window += len(windows)
            group += int(groups.max()) + 1 if len(groups) else 0
            held_ids.clear()
            held.clear()
            tokens = 0
            arrays = [pa.array(c, pa.int64()) for c in columns[:9]]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array(columns[9], pa.binary())] if ids else [])], names=[*names, *(["ids"] if ids else [])])

        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, min(512, batch.num_rows - at))
                for number, body in zip(part.column("doc_id").to_pylist(), encoder(part.column("text").to_pylist())):
                    held_ids.append(number)
                    held.append(body + end)
                    tokens += len(body) // 2 + 1
                    if tokens >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"`{n}` bigint" for n in names) + (", ids binary" if ids else "")
    return rows.mapInArrow(run, schema)
