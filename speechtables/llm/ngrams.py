"""Language-model scores from a trigram trie in Elias-Fano form, counted over a whole corpus.

Model: P(w) = (c(w) + 1) / (N + V + 1), P(w|v) = (c(vw) + a P(w)) / (c(v) + a), P(w|uv) = (c(uvw) + b P(w|v)) /
(c(uv) + b), with ``strengths`` (a, b); it sums to one over all words and one unknown word. Texts start after two start
marks and end with one end mark. P(w|v), P(w|uv) and the weights b / (c(uv) + b) of unseen trigrams are rounded
down to steps of 1/1024 in log10, so a score is a whole number of steps.

Plan. Texts are cut into chunks of about ``CHUNK`` tokens; everything a task does to a chunk is array work on the numbers
of its distinct words. A chunk asks for three things, each time one block of rising values for each shard:

1. its distinct words, by hash: the shard answers corpus counts and ids, small ids for frequent words;
2. its distinct word pairs, by id: the shard answers corpus counts;
3. its distinct trigrams (u, v, w): the shard of (v, w) sums their counts, builds the trie levels from the training
   trigrams and answers every distinct trigram's code by successor search in the mapped levels.

Shards go by hashes of words, of pairs, and of (v, w), and get one row of each value and chunk, so frequent words
and contexts are spread. The number of shards follows the number of tokens; a task holds one shard or one chunk. The
answers are written as tables and each of the larger tables is removed when the next one has replaced it.

Words are told apart by 64 bits of their hash: of 10**9 distinct words two would be mixed up with a probability of
0.03.

Defined cases: null and empty texts are one end mark; words are what lies between ASCII blanks, with A to Z lowered;
a null doc_id is in training (its remainder is not the held-out one); repeated rows and ids are counted and scored
each; a corpus without training rows gives uniform scores; an empty table gives no rows; long texts are cut into
pieces of ``PIECE`` words that keep their two words of context; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.llm.common import id_bucket, slices, stored_at, utf8
from speechtables.llm.eliasfano import STEPS, Trie, code_of, probability, trie_levels
from speechtables.session import run_folder

CHUNK, PIECE = 1 << 20, 1 << 18
SHARD = 1 << 20  # trigrams of a shard, about
START, END = b"\t", b"\n"  # no words
_BITS = np.uint64(21)  # of a word's number in a chunk
_SLICE, _LETTERS = 1 << 22, 1 << 22
_ROWS = "chunk bigint, shard int, data array<binary>"
_ARROW = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("data", pa.list_(pa.binary()))])

# the arrays of a chunk in order: pieces, tokens, distinct words, distinct pairs
_PIECES = ("row", "doc", "no_doc", "held", "size", "known", "base")
_KIND = {"no_doc": "u1", "held": "u1", "base": "<f8", "hash": "<u8"}


def pack(values: np.ndarray, kind: str = "<i8") -> bytes:
    """Numbers by byte planes, compressed, after their width in bytes; longs without a high half are stored as 32 bits."""
    values = np.ascontiguousarray(values, kind)
    if kind == "<i8" and len(values) and values.view("<u8").max() < 1 << 32:
        values = values.astype("<u4")
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return bytes([values.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind: str = "<i8") -> np.ndarray:
    width = data[0]
    planes = zstandard.ZstdDecompressor().decompress(memoryview(data)[1:])
    stored_as = kind if width == np.dtype(kind).itemsize else f"<u{width}"
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(stored_as).ravel().astype(kind, copy=False)


def _rows(rows: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _in_batches(rows: Iterator[tuple[int, int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= 64:
            yield _rows(held)
            held = []
    if held:
        yield _rows(held)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by and by, in lists of at most ``PIECE``."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > _LETTERS:
            blank = re.compile(rb"[ \t-\r]").search(text, at + _LETTERS)
            stop = blank.start() if blank else len(text)
        words = text[at:stop].lower().split()
        for i in range(0, len(words), PIECE):
            yield words[i : i + PIECE]
        at = stop


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text by pieces, the end mark in the last one."""
    held: list[bytes] = []
    for words in words_of(text):
        if held:
            yield held
        held = words
    yield [*held, END]


class _Chunk:
    """Pieces of texts, each after its two words of context."""

    def __init__(self, number: int):
        self.number = number
        self.tokens: list[bytes] = []
        self.pieces: list[tuple] = []

    def add(self, row: int, doc_id, held: bool, before: list[bytes], words: list[bytes]) -> None:
        self.tokens += before + words
        self.pieces.append((row, doc_id or 0, doc_id is None, held, len(words) + 2))

    def row(self) -> tuple[int, int, list[bytes]]:
        code, words = pd.factorize(np.array(self.tokens, object))
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(w) for w in words), np.uint64, len(words))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        columns = [*zip(*self.pieces), np.zeros(len(self.pieces)), np.zeros(len(self.pieces))]
        data = [pack(np.array(c), _KIND.get(name, "<i8")) for name, c in zip(_PIECES, columns)]
        return self.number, -1, [*data, pack(rank[code], "<u4"), pack(np.diff(hashes[order], prepend=np.uint64(0)), "<u8")]


def _chunks(documents: DataFrame, modulus: int, held_out: int, chunk_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 36
        chunk = _Chunk(number)
        for batch in slices(batches, _SLICE, "text"):
            for doc_id, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
                before = [START, START]
                for words in pieces_of(text):
                    chunk.add(row, doc_id, held, before, words)
                    before = [*before, *words[-2:]][-2:]
                    if len(chunk.tokens) >= chunk_tokens:
                        yield _rows([chunk.row()])
                        number += 1
                        chunk = _Chunk(number)
                row += 1
        if chunk.pieces:
            yield _rows([chunk.row()])

    held = F.coalesce(id_bucket("doc_id", modulus) == held_out, F.lit(False)).alias("held")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, utf8("text").alias("text"))
    return rows.mapInArrow(run, _ROWS)


class _Tables:
    """Tables below the shared folder, removed when a later one has replaced them."""

    def __init__(self, spark):
        self._spark, self._paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        self._paths[name] = run_folder(self._spark, f"ngram-{name}")
        return stored_at(df, self._paths[name], "zstd")

    def remove(self, *names: str) -> None:
        for name in names:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


class _Read:
    """The arrays of a stored chunk."""

    def __init__(self, number: int, data: list[bytes]):
        self.number, self.data = number, data
        self.piece = {name: unpack(d, _KIND.get(name, "<i8")) for name, d in zip(_PIECES, data)}
        self.code = unpack(data[len(_PIECES)], "<u4").astype(np.int64)
        size = self.piece["size"]
        self.start = np.cumsum(size) - size
        #: tokens to be scored: all but the two words before each piece
        self.scored = np.ones(len(self.code), bool)
        self.scored[self.start] = self.scored[self.start + 1] = False
        self.train = self.scored & np.repeat(self.piece["held"] == 0, size)

    def extra(self, i: int, kind: str = "<i8") -> np.ndarray:
        return unpack(self.data[len(_PIECES) + 1 + i], kind)

    def _counted(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and how many of them are at training tokens: sorted with that mark as the lowest bit."""
        key = np.sort(key << np.uint64(1) | self.train[at].astype(np.uint64))
        mark, key = (key & np.uint64(1)).astype(np.int64), key >> np.uint64(1)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(mark, first)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct neighbours (v << 21 | w), the words before a piece included, and their training counts."""
        tail = np.ones(len(self.code), bool)
        tail[self.start] = False
        at = np.flatnonzero(tail)
        return self._counted(self.code[at - 1].astype(np.uint64) << _BITS | self.code[at].astype(np.uint64), at)

    def trigram_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(v << 42 | w << 21 | u) of every scored token, and the token's place."""
        at = np.flatnonzero(self.scored)
        v, w, u = (self.code[at - k].astype(np.uint64) for k in (1, 0, 2))
        return v << np.uint64(42) | w << _BITS | u, at

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and their training counts."""
        return self._counted(*self.trigram_keys())


_LOW = np.uint64((1 << 21) - 1)


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each shard, in their order."""
    shard = (keys % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)  # 16 bits are sorted by digits
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        yield k, order[edge[k] : edge[k + 1]]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two ids."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _asked(chunks: DataFrame, ask: Callable[[_Read], Iterator[tuple[int, list[bytes]]]], answer: Callable[[int, list], Iterator]) -> DataFrame:
    """One block for each chunk and shard by ``ask``; ``answer(shard, [(chunk, block)])`` yields rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, data in _read(batches):
            yield from _in_batches((chunk, shard, block) for shard, block in ask(_Read(chunk, data)))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for chunk, shard, block in _read(batches):
            if shard != current:
                if held:
                    yield from _in_batches(answer(current, held))
                current, held = shard, []
            held.append((chunk, block))
        if held:
            yield from _in_batches(answer(current, held))

    dealt = chunks.mapInArrow(blocks, _ROWS).repartition("shard").sortWithinPartitions("shard", "chunk")
    return dealt.mapInArrow(answers, _ROWS)


def _told(chunks: DataFrame, answers: DataFrame, finish: Callable[[_Read, list[tuple[int, list[bytes]]]], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """Every chunk with its answers, by rising shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []
        for number, shard, data in _read(batches):
            if shard < 0:
                if chunk is not None:
                    yield from finish(chunk, held)
                chunk, held = _Read(number, data), []
            else:
                held.append((shard, data))
        if chunk is not None:
            yield from finish(chunk, held)

    both = chunks.union(answers.filter("chunk >= 0")).repartition("chunk").sortWithinPartitions("chunk", "shard")
    return both.mapInArrow(run, out)


def _answered(keys: np.ndarray, shards: int, held: list[tuple[int, list[bytes]]], column: int) -> np.ndarray:
    """The answers to all keys, in their order."""
    out = np.zeros(len(keys), np.int64)
    for (shard, at), (told, data) in zip(_dealt(keys, shards), held, strict=True):
        assert shard == told
        out[at] = unpack(data[column])
    return out


def _join(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (first of each, by a then b) and the number of every pair's."""
    if not len(a) or (int(a.max()) < 1 << 31 and int(b.max()) < 1 << 32):
        distinct, number = np.unique(a << 32 | b, return_inverse=True)
        return distinct >> 32, distinct & 0xFFFFFFFF, number
    order = np.lexsort((b, a))
    fresh = np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return a[order][fresh], b[order][fresh], number


def _falling(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def scored(
    documents: DataFrame,
    modulus: int = 7,
    held_out: int = 2,
    strengths: tuple[float, float] = (3000.0, 10.0),
    chunk_tokens: int = CHUNK,
    shard_rows: int = SHARD,
) -> tuple[DataFrame, DataFrame]:
    """Every row of ``documents`` (doc_id, text) with its scores, and the trie levels by shard."""
    spark = documents.sparkSession
    tables = _Tables(spark)
    wide, narrow = strengths
    start_hash, end_hash = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (START, END))
    chunks = tables.write("chunks", _chunks(documents, modulus, held_out, chunk_tokens))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, data in _read(batches):
            read = _Read(chunk, data)
            ends = np.flatnonzero(np.cumsum(read.extra(0, "<u8"), dtype=np.uint64) == end_hash)
            texts = np.isin(read.code[read.train], ends).sum()
            yield pa.RecordBatch.from_pydict({"tokens": [int(read.scored.sum())], "train": [int(read.train.sum())], "texts": [int(texts)]})

    counted = chunks.mapInArrow(sizes, "tokens bigint, train bigint, texts bigint").agg(F.sum("tokens"), F.sum("train"), F.sum("texts"))
    tokens, train, texts = (x or 0 for x in counted.first())
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // shard_rows))

    # 1. words
    def ask_words(read: _Read) -> Iterator[tuple[int, list[bytes]]]:
        hashes = np.cumsum(read.extra(0, "<u8"), dtype=np.uint64)
        counts = np.bincount(read.code, read.train, len(hashes)).astype(np.int64)
        for shard, at in _dealt(hashes, shards):
            yield shard, [pack(np.diff(hashes[at], prepend=np.uint64(0)), "<u8"), pack(counts[at])]

    def answer_words(shard: int, held: list) -> Iterator[tuple[int, int, list[bytes]]]:
        hashes = [np.cumsum(unpack(block[0], "<u8"), dtype=np.uint64) for _, block in held]
        distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(which, np.concatenate([unpack(block[1]) for _, block in held])).astype(np.int64)
        ids = np.empty(len(distinct), np.int64)
        ids[np.argsort(-counts, kind="stable")] = np.arange(len(distinct)) * shards + shard
        yield -1, shard, [pack(np.array([np.count_nonzero(counts)]))]
        at = 0
        for (chunk, _), own in zip(held, hashes):
            mine = which[at : at + len(own)]
            at += len(own)
            yield chunk, shard, [pack(ids[mine]), pack(counts[mine])]

    words = tables.write("words", _asked(chunks, ask_words, answer_words))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _read(batches):
            yield pa.RecordBatch.from_pydict({"words": [int(unpack(data[0])[0])]})

    distinct_words = words.filter("chunk < 0").mapInArrow(known, "words bigint").agg(F.sum("words")).first()[0] or 0
    total = train + distinct_words + 1

    def name_words(read: _Read, held: list) -> Iterator[pa.RecordBatch]:
        hashes = np.cumsum(read.extra(0, "<u8"), dtype=np.uint64)
        ids, counts = (_answered(hashes, shards, held, k) for k in (0, 1))
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        per_word = np.log10((counts + 1) / total)
        before = lambda x: np.add.reduceat(np.where(read.scored, x[read.code], 0), read.start)
        context = np.where(hashes == start_hash, texts, counts)  # every training text starts once
        context = np.where(hashes == end_hash, 0, context)
        data = list(read.data[: len(_PIECES)])
        data[_PIECES.index("known")] = pack(before((counts > 0).astype(np.int64)))
        data[_PIECES.index("base")] = pack(before(per_word), "<f8")
        rest = [pack(_falling(ids[order])), pack(counts[order]), pack(context[order]), pack((hashes == start_hash)[order], "u1")]
        yield _rows([(read.number, -1, [*data, pack(rank[read.code], "<u4"), *rest])])

    named = tables.write("named", _told(chunks, words, name_words, _ROWS))
    tables.remove("chunks", "words")

    # 2. pairs
    def pair_keys(read: _Read) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.cumsum(read.extra(0))
        pairs, counts = read.pairs()
        v, w = ids[(pairs >> _BITS).astype(np.int64)], ids[(pairs & _LOW).astype(np.int64)]
        return pairs, counts, v, w

    def ask_pairs(read: _Read) -> Iterator[tuple[int, list[bytes]]]:
        _, counts, v, w = pair_keys(read)
        for shard, at in _dealt(_mixed(v, w), shards):
            yield shard, [pack(_falling(v[at])), pack(w[at]), pack(counts[at])]

    def answer_pairs(shard: int, held: list) -> Iterator[tuple[int, int, list[bytes]]]:
        v = [np.cumsum(unpack(block[0])) for _, block in held]
        w, counts = (np.concatenate([unpack(block[k]) for _, block in held]) for k in (1, 2))
        which = _join(np.concatenate(v), w)[2]
        counts = np.bincount(which, counts).astype(np.int64)[which]
        edge = np.cumsum([0, *map(len, v)])
        for i, (chunk, _) in enumerate(held):
            yield chunk, shard, [pack(counts[edge[i] : edge[i + 1]])]

    pairs = tables.write("pairs", _asked(named, ask_pairs, answer_pairs))

    def count_pairs(read: _Read, held: list) -> Iterator[pa.RecordBatch]:
        keys, _, v, w = pair_keys(read)
        counts = _answered(_mixed(v, w), shards, held, 0)
        start, context = np.flatnonzero(read.extra(3, "u1")), read.extra(2)
        if len(start):
            both = keys == (np.uint64(start[0]) << _BITS | np.uint64(start[0]))
            counts = np.where(both, context[start[0]], counts)
        yield _rows([(read.number, -1, [*read.data, pack(counts)])])

    counted = tables.write("counted", _told(named, pairs, count_pairs, _ROWS))
    tables.remove("named", "pairs")

    # 3. trigrams
    def words_in(trigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return trigrams >> np.uint64(42), trigrams >> _BITS & _LOW, trigrams & _LOW

    def ask_trigrams(read: _Read) -> Iterator[tuple[int, list[bytes]]]:
        trigrams, n = read.trigrams()
        (v, w, u), ids = words_in(trigrams), np.cumsum(read.extra(0))
        counts, context = read.extra(1), read.extra(2)
        pairs, _ = read.pairs()
        pair_counts = read.extra(4)
        own = trigrams >> _BITS
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        vw = pair_counts[np.searchsorted(pairs, own[first])]
        a, b = v[first].astype(np.int64), w[first].astype(np.int64)
        two = code_of((vw + wide * (counts[b] + 1) / total) / (context[a] + wide))
        two = np.repeat(two, np.diff(np.r_[first, len(own)]))
        uv = pair_counts[np.searchsorted(pairs, u << _BITS | v)]
        v, w, u = (ids[x.astype(np.int64)] for x in (v, w, u))
        for shard, at in _dealt(_mixed(v, w), shards):
            yield shard, [pack(_falling(v[at])), *(pack(x[at]) for x in (w, u, n, uv, two))]

    def answer_trigrams(shard: int, held: list) -> Iterator[tuple[int, int, list[bytes]]]:
        v = [np.cumsum(unpack(block[0])) for _, block in held]
        edge = np.cumsum([0, *map(len, v)])
        column = lambda k: np.concatenate([unpack(block[k]) for _, block in held])
        first, second, pair_of = _join(np.concatenate(v), column(1))
        pair, u, which = _join(pair_of, column(2))
        two, uv = np.empty(len(first), np.int64), np.empty(len(u), np.int64)
        two[pair_of], uv[which] = column(5), column(4)
        n = np.bincount(which, column(3)).astype(np.int64)
        there = n > 0
        fresh = np.r_[True, np.diff(pair[there]) != 0][: there.sum()]
        kept, own = pair[there][fresh], np.cumsum(fresh) - 1
        three = code_of((n + narrow * probability(two[pair])) / (uv + narrow))
        levels = trie_levels(own, first[kept], second[kept], u[there], two[kept], three[there])
        yield -1, shard, levels
        trie = Trie(levels)
        context, at = trie.pairs(first, second)
        found = trie.trigrams(context[pair], at[pair], u)
        codes = code_of(narrow / (uv + narrow)) + two[pair]
        codes[found >= 0] = trie.codes(found[found >= 0])
        codes = codes[which]
        for i, (chunk, _) in enumerate(held):
            yield chunk, shard, [pack(codes[edge[i] : edge[i + 1]])]

    trie = tables.write("trie", _asked(counted, ask_trigrams, answer_trigrams))

    def sum_up(read: _Read, held: list) -> Iterator[pa.RecordBatch]:
        trigrams, which = np.unique(read.trigram_keys()[0], return_inverse=True)
        (v, w, _), ids = words_in(trigrams), np.cumsum(read.extra(0))
        keys = _mixed(ids[v.astype(np.int64)], ids[w.astype(np.int64)])
        steps = np.zeros(len(read.code), np.int64)
        steps[read.scored] = _answered(keys, shards, held, 0)[which]
        piece = read.piece
        none = piece["no_doc"].astype(bool)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(piece["row"]),
                pa.array(piece["doc"], mask=none),
                pa.array(piece["held"].astype(bool)),
                pa.array(piece["size"] - 2),
                pa.array(piece["known"]),
                pa.array(piece["base"]),
                pa.array(np.add.reduceat(steps, read.start)),
            ],
            names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "steps"],
        )

    needed = counted.select("chunk", "shard", F.slice("data", 1, len(_PIECES) + 2).alias("data"))
    out = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, steps bigint"
    pieces = _told(needed, trie, sum_up, out)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "steps")]
    by_row = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    result = by_row.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train).cast("bigint").alias("train_tokens"),
        "base_score",
        (-F.col("steps") / F.lit(float(STEPS))).alias("score"),
    )
    return result, trie.filter("chunk < 0").select("shard", F.col("data").alias("levels"))
