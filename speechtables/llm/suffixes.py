"""Repeated byte strings across documents, by column-wise construction over aligned surroundings.

Every byte covered by a string of ``length`` (50) bytes that also starts in a document with a smaller
doc_id is removed. Texts are compared as UTF-8 bytes; strings never cross documents and are judged on the
input.

How it scales. Documents are packed into chunks of about ``chunk_bytes`` (a longer document is a chunk of
its own), written once as an external table and read sequentially by every later step.

1. *Anchors.* Of every 50-byte window the 16-byte string with the least hash is an anchor (about 6 % of
   all positions). Equal windows have equal anchors at equal distances. Each chunk sends its distinct anchor
   hashes to buckets, which answer which of them occur in two documents or more; all other windows are
   unique and need no more work.
2. *Column-wise rounds.* The surroundings of a shared anchor (34 bytes on either side) become one row of a
   bucket's collection. From the last column to the first, each round inserts one symbol per row: a
   stable distribution of the current suffix order by that symbol, the Burrows-Wheeler symbols of the new
   suffixes, and their common prefixes with their neighbours as one more than a range minimum. Where
   a suffix still has 50 bytes, neighbours with a common prefix of 50 or more hold the same string, and
   all but the least doc_id lose it.
3. *Answers* go back to the chunks as positions and bit masks, are merged into spans and cut out.

Buckets are sized by the total of bytes, so one bucket's columns stay in a task's memory. An anchor that more
than ``wide_from`` chunks share is not kept together: each of its windows is filed by its own hash, so that
a bucket sees a common string once per chunk. Within a chunk, equal surroundings in a later document are
settled at once and not sent.

Defined cases: null texts are empty; texts under 50 bytes stay as they are; a null doc_id counts as larger
than any other; rows with equal doc_id do not remove each other; an empty table gives an empty result;
other columns of the input are carried along unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtables.llm.common import NO_ID, make_room, stored

LENGTH = 50
ANCHOR = 16
SPAN = LENGTH - ANCHOR + 1  # anchors a window can choose from
BEFORE = SPAN - 1  # bytes on either side of an anchor
WIDTH = BEFORE + LENGTH
_TILE = 1 << 18
_KEY = np.uint64((1 << 48) - 1)

_CHUNK = "chunk bigint, owners array<bigint>, lengths array<bigint>, rest binary, body binary"


# ---------------------------------------------------------------- chunks


def chunked(documents: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows packed in the order they are read; ``rest`` holds all columns but the text."""
    others = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        part, number = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            start, size = 0, 0
            for at in range(len(texts) + 1):
                if at == len(texts) or (at > start and size + len(texts[at]) > chunk_bytes):
                    if at > start:
                        yield _pack(batch.slice(start, at - start), texts[start:at], (part << 32) + number, pack)
                        number += 1
                    start, size = at, 0
                if at < len(texts):
                    size += len(texts[at])

    def _pack(rows: pa.RecordBatch, texts: list[bytes], chunk: int, pack) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        kept = rows.select(others)
        with pa.ipc.new_stream(sink, kept.schema) as writer:
            writer.write_batch(kept)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()),
                pa.array([rows.column("doc_id").cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([pack.compress(sink.getvalue().to_pybytes())], pa.binary()),
                pa.array([pack.compress(b"".join(texts))], pa.binary()),
            ],
            names=["chunk", "owners", "lengths", "rest", "body"],
        )

    return documents.mapInArrow(run, _CHUNK)


class Chunk:
    """A chunk's bytes, where its documents end, and who owns them."""

    def __init__(self, row: dict) -> None:
        unpack = zstandard.ZstdDecompressor()
        self.body = np.frombuffer(unpack.decompress(row["body"]), np.uint8)
        self.lengths = np.array(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.owners = np.array([NO_ID if o is None else o for o in row["owners"]], np.int64)
        self.rest = row.get("rest")

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, "right")


# ---------------------------------------------------------------- anchors


def _mixed(body: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes at every position, by doubling."""
    value = body.astype(np.uint64) + np.uint64(1)
    for width in (1, 2, 4, 8):
        value = value[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width * 0x1F3) + value[width:]
        value ^= value >> np.uint64(31)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    return value


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 48-bit hashes of all anchors; ties within a window are all anchors."""
    positions, hashes = [], []
    for at in range(0, max(len(chunk.body) - LENGTH + 1, 0), _TILE):
        part = chunk.body[at : at + _TILE + LENGTH - 1]
        value = _mixed(part)
        least = _sliding(value, SPAN, np.minimum)
        edge = np.zeros(SPAN - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum) == value)
        positions.append(chosen + at)
        hashes.append(value[chosen] & _KEY)
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    position, value = np.concatenate(positions), np.concatenate(hashes)
    position, first = np.unique(position, return_index=True)
    value = value[first]
    whole = chunk.document(position) == chunk.document(position + ANCHOR - 1)
    return position[whole], value[whole]


def _distinct(chunk: Chunk, position: np.ndarray, value: np.ndarray, buckets: int):
    """Distinct hashes in the order of their buckets, whether two documents of the chunk have them, and
    where each anchor's hash stands."""
    keys, at = np.unique(value, return_inverse=True)
    document = chunk.document(position)
    low, high = np.full(len(keys), NO_ID), np.full(len(keys), -1)
    np.minimum.at(low, at, document)
    np.maximum.at(high, at, document)
    order = np.argsort(keys % np.uint64(buckets), kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], (low != high)[order], place[at]


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_values):
        first = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(sorted_values)]):
            yield int(sorted_values[a]), int(a), int(b)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                keys, several, _ = _distinct(chunk, *anchors(chunk), buckets)
                out = []
                for bucket, a, b in _runs(keys % np.uint64(buckets)):
                    six = keys[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    out.append((bucket, row["chunk"], six.tobytes(), np.packbits(several[a:b]).tobytes()))
                if out:
                    columns = list(zip(*out))
                    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    names = ["bucket", "chunk", "hashes", "several"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _answer(wide_from: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = [len(r["hashes"]) // 6 for r in rows]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :6] = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint8).reshape(-1, 6)
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8))[:n] for r, n in zip(rows, sizes)])
        _, at, count = np.unique(keys.view("<u8").ravel(), return_inverse=True, return_counts=True)
        flagged = np.bincount(at, several, len(count)) > 0
        shared = ((count > 1) | flagged)[at]
        wide = (count > wide_from)[at]
        edges = np.cumsum([0, *sizes])
        bits = lambda x: [np.packbits(x[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.table(
            {
                "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                "shared": pa.array(bits(shared), pa.binary()),
                "wide": pa.array(bits(wide), pa.binary()),
            }
        )

    return run


# ---------------------------------------------------------------- collections


def _surroundings(chunk: Chunk, at: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each position on; bytes outside the chunk are 0."""
    padded = np.concatenate([np.zeros(WIDTH, np.uint8), chunk.body, np.zeros(WIDTH, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[at + WIDTH]


_SENT = pa.schema(
    [
        ("bucket", pa.int32()),
        ("chunk", pa.int64()),
        ("width", pa.int32()),
        ("start", pa.binary()),
        ("owner", pa.binary()),
        ("low", pa.binary()),
        ("high", pa.binary()),
        ("rows", pa.binary()),
    ]
)
_SENT_SQL = "bucket int, chunk bigint, width int, start binary, owner binary, low binary, high binary, rows binary"


def _send(buckets: int):
    """Rows of the collections, by bucket; rows without content are windows settled inside the chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            chunk = Chunk(row)
            position, value = anchors(chunk)
            keys, _, place = _distinct(chunk, position, value, buckets)
            bounds = {b: (x, y) for b, x, y in _runs(keys % np.uint64(buckets))}
            shared, wide = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
            for answer in right.to_pylist():
                x, y = bounds[answer["bucket"]]
                for flags, name in ((shared, "shared"), (wide, "wide")):
                    flags[x:y] = np.unpackbits(np.frombuffer(answer[name], np.uint8))[: y - x] > 0
            mine, far = (shared & ~wide)[place], (shared & wide)[place]
            number = row["chunk"]
            out += _file(chunk, number, position[mine] - BEFORE, value[mine] % np.uint64(buckets), WIDTH, buckets)
            starts = np.unique((position[far][:, None] - np.arange(SPAN)[None, :]).ravel())
            starts = starts[starts >= 0]
            starts = starts[chunk.ends[chunk.document(starts)] >= starts + LENGTH] if len(starts) else starts
            if len(starts):
                content = _surroundings(chunk, starts, LENGTH)
                hashed = content[:, :48].copy().view("<u8") @ (np.arange(6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
                hashed ^= hashed >> np.uint64(29)
                out += _file(chunk, number, starts, np.uint64(buckets) + hashed % np.uint64(buckets), LENGTH, buckets)
        columns = list(zip(*out)) if out else [[] for _ in _SENT]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)

    return run


def _file(
    chunk: Chunk, number: int, start: np.ndarray, bucket: np.ndarray, width: int, buckets: int
) -> Iterator[tuple]:
    """Group the rows starting at ``start`` by bucket; rows of later documents that equal one of an earlier
    document are settled here."""
    if not len(start):
        return
    document = chunk.document(start + (BEFORE if width == WIDTH else 0))
    low = np.maximum(chunk.starts[document] - start, 0)
    high = np.minimum(chunk.ends[document] - LENGTH - start, width - LENGTH)
    real = low <= high
    start, bucket, document, low, high = (x[real] for x in (start, bucket, document, low, high))
    if not len(start):
        return
    content = np.zeros((len(start), width + 2), np.uint8)
    content[:, :width] = _surroundings(chunk, start, width)
    content[:, width], content[:, width + 1] = low, high
    outside = np.arange(width)[None, :]
    content[:, :width][(outside < low[:, None]) | (outside >= (high + LENGTH)[:, None])] = 0
    owner = chunk.owners[document]
    _, same = np.unique(content.view(np.dtype((np.void, width + 2))).ravel(), return_inverse=True)
    least = np.full(same.max() + 1, NO_ID)
    np.minimum.at(least, same, owner)
    later = owner > least[same]
    if later.any():
        bits = _all_windows(low[later], high[later])
        yield number % buckets, number, width, start[later].astype("<i8").tobytes(), bits.astype("<u8").tobytes(), b"", b"", b""
    pack = zstandard.ZstdCompressor(level=1)
    send = np.flatnonzero(~later)
    send = send[np.argsort(bucket[send], kind="stable")]
    for b, x, y in _runs(bucket[send]):
        rows = send[x:y]
        yield (
            b,
            number,
            width,
            start[rows].astype("<i8").tobytes(),
            owner[rows].astype("<i8").tobytes(),
            low[rows].astype(np.uint8).tobytes(),
            high[rows].astype(np.uint8).tobytes(),
            pack.compress(content[rows, :width].tobytes()),
        )


def _all_windows(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return ((one << (high + 1).astype(np.uint64)) - one) & ~((one << low.astype(np.uint64)) - one)


def column_rounds(columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Columns of equally long rows (width x rows), last to first: each round inserts the suffixes that
    start in column ``j`` and gives (j, their order, their Burrows-Wheeler symbols, common prefixes with the
    suffix before, counted up to 255). The first column's symbols wrap round to the last column."""
    width, n = columns.shape
    order, common = np.arange(n), np.zeros(n, np.uint8)
    for j in range(width - 1, -1, -1):
        symbol = columns[j][order]
        moved = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[moved]
        after = np.zeros(n, np.uint8)
        same = np.flatnonzero(sorted_symbol[1:] == sorted_symbol[:-1]) + 1
        if len(same):
            between = _range_minimum(common, moved[same - 1] + 1, moved[same])
            after[same] = np.minimum(between, 254) + 1
        order, common = order[moved], after
        yield j, order, columns[j - 1][order], common


def _range_minimum(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum over values[first..last], both included."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table, k = values, 0
    top = int(level.max())
    while True:
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[first[here]], table[last[here] - (1 << k) + 1])
        if k == top:
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


_MASKS = "chunk bigint, start binary, mask binary"


def _settle(table: pa.Table) -> pa.Table:
    """One bucket's collection: which windows of which rows belong to a smaller document elsewhere."""
    every = table.to_pylist()
    rows = [r for r in every if r["rows"]]
    done = [(r["chunk"], r["start"], r["owner"]) for r in every if not r["rows"]]
    return _mask_table(done + (_lost_windows(rows) if rows else []))


def _mask_table(answers: list[tuple]) -> pa.Table:
    columns = list(zip(*answers)) if answers else ([], [], [])
    types = (pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("chunk", "start", "mask"), columns, types)})


def _lost_windows(rows: list[dict]) -> list[tuple]:
    """(chunk, starts, masks) of the windows of equally wide rows that a smaller document holds too."""
    unpack = zstandard.ZstdDecompressor()
    width = rows[0]["width"]
    start = np.concatenate([np.frombuffer(r["start"], "<i8") for r in rows])
    owner = np.concatenate([np.frombuffer(r["owner"], "<i8") for r in rows])
    low = np.concatenate([np.frombuffer(r["low"], np.uint8) for r in rows])
    high = np.concatenate([np.frombuffer(r["high"], np.uint8) for r in rows])
    body = b"".join(unpack.decompress(r["rows"]) for r in rows)
    columns = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(-1, width).T)
    mask = np.zeros(len(start), np.uint64)
    for j, order, _, common in column_rounds(columns):
        if j > width - LENGTH:
            continue
        valid = (low[order] <= j) & (j <= high[order])
        owners = np.where(valid, owner[order], NO_ID)
        first = np.flatnonzero(common < LENGTH)
        least = np.minimum.reduceat(owners, first)
        least = np.repeat(least, np.diff(np.r_[first, len(order)]))
        lost = order[valid & (owners > least)]
        mask[lost] |= np.uint64(1) << np.uint64(j)
    edges = np.cumsum([0, *(len(r["start"]) // 8 for r in rows)])
    answers = []
    for r, a, b in zip(rows, edges[:-1], edges[1:]):
        hit = np.flatnonzero(mask[a:b]) + a
        if len(hit):
            answers.append((r["chunk"], start[hit].astype("<i8").tobytes(), mask[hit].astype("<u8").tobytes()))
    return answers


# ---------------------------------------------------------------- results


def _lost_spans(chunk: Chunk, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of removed bytes within the documents of a chunk."""
    starts = []
    for a in answers:
        at, mask = np.frombuffer(a["start"], "<i8"), np.frombuffer(a["mask"], "<u8")
        for bit in range(SPAN):
            starts.append(at[((mask >> np.uint64(bit)) & np.uint64(1)) > 0] + bit)
    start = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    if not len(start):
        return start, start
    document = chunk.document(start)
    fresh = np.r_[True, (start[1:] > start[:-1] + LENGTH) | (document[1:] != document[:-1])]
    begin = start[fresh]
    end = start[np.r_[np.flatnonzero(fresh)[1:] - 1, len(start) - 1]] + LENGTH
    return begin, end


def repeated_removed(
    documents: DataFrame,
    *,
    chunk_bytes: int = 1 << 20,
    bucket_bytes: int = 4 << 20,
    wide_from: int = 4096,
    text: bool = True,
) -> DataFrame:
    """Every row of ``documents`` with its columns, ``text`` replaced by what is left, and ``n_bytes``,
    ``n_removed``, ``n_spans``, ``kept_sha256`` (prefixed ``repeat_``).

    ``text=False`` leaves out the text. A span that cuts a character leaves partial bytes; they are dropped
    from ``text`` and counted in ``kept_sha256``.
    """
    chunks = stored(chunked(documents, chunk_bytes), "repeat-chunks")
    total = chunks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(32, -(-total // bucket_bytes))
    asked = chunks.mapInArrow(_ask(buckets), "bucket int, chunk bigint, hashes binary, several binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer(wide_from), "chunk bigint, bucket int, shared binary, wide binary")
    sent = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_send(buckets), _SENT_SQL)
    answers = stored(sent.groupBy("bucket").applyInArrow(_settle, _MASKS), "repeat-answers")

    others = [f for f in documents.schema.fields if f.name != "text"]
    fields = [*others, *([T.StructField("text", T.StringType())] if text else [])]
    facts = ["repeat_n_bytes", "repeat_n_removed", "repeat_n_spans"]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in facts), T.StructField("repeat_kept_sha256", T.StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = Chunk(row)
        begin, end = _lost_spans(chunk, right.to_pylist())
        body = chunk.body.tobytes()
        n_bytes, n_removed, n_spans, digests, texts = [], [], [], [], []
        first = np.searchsorted(begin, chunk.starts, "left")
        last = np.searchsorted(begin, chunk.ends, "left")
        for d, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist())):
            pieces, at, gone = [], a, 0
            for s in range(first[d], last[d]) if b > a else ():
                pieces.append(body[at : begin[s]])
                at = int(end[s])
                gone += at - int(begin[s])
            pieces.append(body[at:b])
            kept = b"".join(pieces)
            n_bytes.append(b - a)
            n_removed.append(gone)
            n_spans.append(len(pieces) - 1)
            digests.append(hashlib.sha256(kept).hexdigest())
            if text:
                texts.append(kept.decode("utf-8", "ignore"))
        unpack = zstandard.ZstdDecompressor()
        rest = pa.ipc.open_stream(unpack.decompress(chunk.rest)).read_all()
        out = {f.name: rest.column(f.name) for f in others}
        if text:
            out["text"] = pa.array(texts, pa.string())
        out |= dict(zip(facts, (pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))))
        out["repeat_kept_sha256"] = pa.array(digests, pa.string())
        return pa.table(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
