"""Alignment of two tokenizers' tokens of one text, and corpus counts of the id pairs that overlap.

A text, with a blank put before it, is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B),
each over the whole text. Tokens become byte lengths. An anchor is a byte where both encodings end a token and
both next tokens start with a blank; anchors cut the two id sequences into windows, about one for each word. A window
is looked up by its two id tuples, so the work inside it (shared ends, groups, overlapping pairs) is done once for
each distinct window of a task; the memo is bounded and changes no result.

Two passes over Spark tables give the corpus counts. The first writes, for every document, its digests and its
pairs with their number of links, and for every chunk of documents its distinct pairs with the number of documents
that hold them. These are summed over the corpus, compared with the highest count of their A id, and sent back to the
chunks. The second pass sums them over each document's links.

Texts are encoded whole, as both encoders ask for. A chunk closes at ``chunk_tokens`` tokens, so a task holds a
chunk or one longer text, and a memo.

Defined cases: texts that are null or empty, or whose joined bytes differ from the text with its blank, have no
tokens, zeros and an empty column of groups; repeated rows and ids count as documents of their own; null ids
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.llm.common import batch_of, slices, stored

MEMO = 1 << 18
_SLICE = 1 << 21


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes as themselves, the rest
    counted up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in plain}
    letter.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letter


class ByteTokens:
    """A: ids of a byte-level BPE vocabulary file, special tokens read as text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letter, special = _letters(), {t["content"] for t in model.get("added_tokens", ()) if t.get("special")}
        own = {token: i for token, i in model["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(model["model"]["vocab"].values()) + 1)
        for token, i in own.items():
            self.bytes[i] = bytes(letter[c] for c in token)
        # merges are listed by rank, so a merged token's id follows its rank: the ids serve as ranks
        ranks = {self.bytes[i]: i for i in own.values()}
        self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    """B: ids of a piece model, which puts the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def encoders(byte_path: str | None = None, piece_path: str | None = None) -> tuple[ByteTokens, PieceTokens]:
    byte_path = byte_path or public_tokenizers.path("byte_bpe_50k.json")
    return ByteTokens(byte_path), PieceTokens(piece_path or public_tokenizers.path("piece_bpe_32k.model"))


class Windows:
    """Memo of aligned windows by their two id tuples (packed as bytes); windows are numbered in the order they are met.

    ``numbers`` looks windows up, ``align`` then aligns all new ones at once: put one after another they are one text,
    in which no group or link crosses from one window into the next.
    """

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self._a, self._b = a.bytes, b.bytes
        self._a_sizes, self._b_sizes = (np.array([len(t) for t in x], np.int64) for x in (a.bytes, b.bytes))
        self._a_blank, self._b_blank = (np.array([t[:1] == b" " for t in x]) for x in (a.bytes, b.bytes))
        self.clear()

    def clear(self) -> None:
        self.memo: dict[tuple, int] = {}
        self.texts: list[str] = []
        self._new: list[tuple] = []
        self._n_groups = self._links = np.zeros(0, np.int64)
        self._edges = np.zeros(1, np.int64)

    def numbers(self, text: str, a: list[int], b: list[int]) -> list[int]:
        """The windows of one text, in order; none if the tokens do not join to it."""
        spelled = b" " + text.encode()
        if not text or b"".join(map(self._a.__getitem__, a)) != spelled or b"".join(map(self._b.__getitem__, b)) != spelled:
            return []
        i, j = np.array(a, np.int64), np.array(b, np.int64)
        starts_a = np.flatnonzero(self._a_blank[i[1:]]) + 1
        starts_b = np.flatnonzero(self._b_blank[j[1:]]) + 1
        at_a, at_b = np.cumsum(self._a_sizes[i])[starts_a - 1], np.cumsum(self._b_sizes[j])[starts_b - 1]
        place = np.searchsorted(at_b, at_a)
        place[place == len(at_b)] = 0
        met = np.flatnonzero(at_b[place] == at_a) if len(at_b) else np.zeros(0, np.int64)
        a_cuts, b_cuts = (4 * starts_a[met]).tolist(), (4 * starts_b[place[met]]).tolist()
        memo, out = self.memo, []
        left, right = i.astype("<i4").tobytes(), j.astype("<i4").tobytes()
        lo_a = lo_b = 0
        for hi_a, hi_b in zip([*a_cuts, len(left)], [*b_cuts, len(right)]):
            key = (left[lo_a:hi_a], right[lo_b:hi_b])
            lo_a, lo_b = hi_a, hi_b
            at = memo.get(key)
            if at is None:
                at = memo[key] = len(memo)
                self._new.append(key)
            out.append(at)
        return out

    def align(self) -> None:
        if not self._new:
            return
        left, right = zip(*self._new)
        self._new = []
        a, b = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (left, right))
        a_ends, b_ends = np.cumsum(self._a_sizes[a]), np.cumsum(self._b_sizes[b])
        closing = a_ends[np.cumsum([len(x) // 4 for x in left]) - 1]
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cuts, b_cuts = (np.searchsorted(ends, shared) + 1 for ends in (a_ends, b_ends))
        a_names, b_names = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(a_cuts.tolist(), b_cuts.tolist()):
            groups.append(f"{','.join(a_names[i:x])}|{','.join(b_names[j:y])}")
            i, j = x, y
        last = np.searchsorted(shared, closing, "right")
        i = 0
        for x in last.tolist():
            self.texts.append(";".join(groups[i:x]))
            i = x
        ends = np.union1d(a_ends, b_ends)  # each stretch between two ends is the overlap of one pair
        links = a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]
        edges = np.searchsorted(ends, closing, "right") + self._edges[-1]
        self._n_groups = np.concatenate([self._n_groups, np.diff(last, prepend=0)])
        self._links, self._edges = np.concatenate([self._links, links]), np.concatenate([self._edges, edges])

    def groups(self, windows: list[int]) -> tuple[int, str]:
        """Number and text of the groups of successive windows."""
        return int(self._n_groups[windows].sum()), ";".join(map(self.texts.__getitem__, windows))

    def links(self, windows: list[int]) -> np.ndarray:
        """All links of the windows, a * 2**32 + b."""
        start = self._edges[windows]
        size = self._edges[np.array(windows) + 1] - start
        return self._links[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]


_CHUNKS = (
    "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs binary, counts binary"
)
_CHUNKS_ARROW = pa.schema(
    [
        ("chunk", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("pairs", pa.binary()),
        ("counts", pa.binary()),
    ]
)


class _Chunk:
    """Documents whose pairs are numbered together; a row of each, and a last one (n_a null) with the chunk's pairs."""

    def __init__(self, number: int):
        self.number, self.tokens = number, 0
        self.rows: list[tuple] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id, a: int, b: int, groups: int, digest: str, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.rows.append((self.number, doc_id, a, b, groups, int(counts.sum()), digest))
        self.found.append((pairs, counts))
        self.tokens += a + b

    def batch(self) -> pa.RecordBatch:
        sizes = [len(p) for p, _ in self.found]
        distinct, local, held = np.unique(np.concatenate([p for p, _ in self.found]), return_inverse=True, return_counts=True)
        edge = np.r_[0, np.cumsum(sizes)]
        rows = [
            (*row, local[edge[i] : edge[i + 1]].astype("<u4").tobytes(), counts.astype("<u4").tobytes())
            for i, (row, (_, counts)) in enumerate(zip(self.rows, self.found))
        ]
        rows.append((self.number, *[None] * 6, distinct.astype("<i8").tobytes(), held.astype("<i8").tobytes()))
        return batch_of(dict(zip(_CHUNKS_ARROW.names, zip(*rows))), _CHUNKS_ARROW)


def aligned_chunks(documents: DataFrame, byte_path: str | None, piece_path: str | None, chunk_tokens: int, memo: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoders(byte_path, piece_path)
        windows = Windows(a, b)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in slices(batches, _SLICE, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if len(windows.memo) >= memo:
                windows.clear()
            ids = list(zip(a.encode(texts), b.encode(texts)))
            numbers = [windows.numbers(text, *both) for text, both in zip(texts, ids)]
            windows.align()
            for doc_id, (i, j), found in zip(batch.column("doc_id").to_pylist(), ids, numbers):
                if found:
                    n_groups, groups = windows.groups(found)
                    digest = hashlib.sha256(groups.encode()).hexdigest()
                    chunk.add(doc_id, len(i), len(j), n_groups, digest, *np.unique(windows.links(found), return_counts=True))
                else:
                    chunk.add(doc_id, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
                if chunk.tokens >= chunk_tokens or len(chunk.rows) >= 1 << 14:
                    yield chunk.batch()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.rows:
            yield chunk.batch()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, _CHUNKS)


def _chunk_pairs(chunks: DataFrame) -> DataFrame:
    """(chunk, place, a, b, documents) of every distinct pair of a chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("documents", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, held in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "counts"))):
                pairs, held = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<i8")
                for at in range(0, len(pairs), 1 << 16):
                    part = pairs[at : at + (1 << 16)]
                    yield batch_of(
                        {
                            "chunk": np.full(len(part), chunk),
                            "place": np.arange(at, at + len(part), dtype=np.int32),
                            "a": (part >> 32).astype(np.int32),
                            "b": (part & 0xFFFFFFFF).astype(np.int32),
                            "documents": held[at : at + len(part)],
                        },
                        schema,
                    )

    own = chunks.filter("n_a is null").select("chunk", "pairs", "counts")
    return own.mapInArrow(run, "chunk bigint, place int, a int, b int, documents bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many documents of the corpus hold a pair linked, and whether no other pair of its
    A id has more."""
    total = pairs.groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    highest = total.groupBy("a").agg(F.max("documents").alias("highest"))
    return total.join(highest, "a").select("a", "b", "documents", (F.col("documents") == F.col("highest")).alias("best"))


_RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)
_RESULT_ARROW = pa.schema([(f.split()[0], pa.string() if "string" in f else pa.int64()) for f in _RESULT.split(", ")])


def alignments(
    documents: DataFrame,
    byte_path: str | None = None,
    piece_path: str | None = None,
    chunk_tokens: int = 1 << 21,
    memo: int = MEMO,
) -> tuple[DataFrame, DataFrame]:
    """The digests of every row of ``documents`` (doc_id, text), and the corpus table of ``pair_counts``."""
    chunks = stored(aligned_chunks(documents, byte_path, piece_path, chunk_tokens, memo), "aligned-chunks")
    pairs = _chunk_pairs(chunks)
    counts = stored(pair_counts(pairs), "aligned-pairs")
    held = pairs.select("chunk", "place", "a", "b").join(counts, ["a", "b"])
    empty = lambda kind: F.lit(None).cast(kind)
    own = [c for c in _CHUNKS_ARROW.names if c != "chunk"]
    sides = held.select(
        "chunk", "place", F.col("documents"), "best", *[empty(_CHUNKS.split(", ")[_CHUNKS_ARROW.names.index(c)].split()[1]).alias(c) for c in own]
    ).union(
        chunks.filter("n_a is not null").select(
            "chunk", F.lit((1 << 31) - 1).alias("place"), empty("bigint").alias("documents"), empty("boolean").alias("best"), *own
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counted, best, ready = None, [], [], False
        for batch in batches:
            out = []
            number = batch.column("chunk").to_numpy()
            is_pair = np.asarray(batch.column("documents").is_valid())
            edges = np.r_[0, np.flatnonzero((np.diff(number) != 0) | np.diff(is_pair)) + 1, batch.num_rows]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if lo == hi:
                    continue
                if number[lo] != current:
                    current, counted, best, ready = number[lo], [], [], False
                part = batch.slice(lo, hi - lo)
                if is_pair[lo]:
                    counted.append(part.column("documents").to_numpy(zero_copy_only=False))
                    best.append(part.column("best").to_numpy(zero_copy_only=False).astype(bool))
                    continue
                if not ready:
                    counted, best, ready = np.concatenate([*counted, np.zeros(0, np.int64)]), np.concatenate([*best, np.zeros(0, bool)]), True
                for row in part.select(own).to_pylist():
                    at, links = np.frombuffer(row["pairs"], "<u4"), np.frombuffer(row["counts"], "<u4").astype(np.int64)
                    sums = int(links[best[at]].sum()), int(counted[at] @ links)
                    out.append((row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["groups_sha256"]))
            if out:
                yield batch_of(dict(zip(_RESULT_ARROW.names, zip(*out))), _RESULT_ARROW)

    dealt = sides.repartition("chunk").sortWithinPartitions("chunk", "place")
    return dealt.mapInArrow(run, _RESULT), counts
