"""Byte-level BPE by ranked merges over distinct words, and decoding.

``encoded`` splits every text into words (matches of the splitting pattern), folds each distinct word of a task
once (bytes, then the pair of least rank again and again) and keeps common words in a bounded cache, which
changes no id. ``decoded`` maps ids to the tokens' bytes with higher-order functions and concatenates them.

``encoded_by_functions`` is the same encoder in higher-order functions only: every token id is one symbol, a
character of the planes above U+FFFF; a word starts as the symbols of its bytes; each step of a fold looks up
all neighbouring pairs in a literal rank map (cut into small maps by hash, as a map is searched from its
front), takes the least and merges its occurrences from left to right. The ``most`` most frequent words of
all texts are folded once and become a second literal map, other words are folded where they stand. It gives the
same ids but costs about 0.1 ms a fold, too much for whole tables; see the README.

Merging all occurrences of the least pair at once equals merging them one by one: a merge can only
give pairs of higher rank, because every token's own parts rank below it.

Defined cases: a null or empty text has no tokens and decodes to no bytes; repeated rows and ids are computed
each; null ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = 0x10000  # the symbol of id 0
MAPS = 1 << 14
_LONG = 48  # longer words are never common


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merges of lower rank make of a token; two parts for every token that merging can reach."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[best] + parts[best + 1], own) >= own:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


@dataclass(frozen=True)
class Vocabulary:
    """pairs: two symbols to the merged symbol followed by those two; whole: words that are tokens no merge
    reaches; pieces: every id's bytes in hexadecimal."""

    bytes_as_symbols: str
    pairs: dict[str, str]
    whole: dict[str, str]
    pieces: list[str]


def vocabulary(path: str | None = None) -> Vocabulary:
    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    symbol = {token: chr(BASE + rank) for token, rank in ranks.items()}
    pairs, whole = {}, {}
    for token in ranks:
        if len(token) > 1:
            parts = parts_of(token, ranks)
            if len(parts) == 2:
                pair = symbol[parts[0]] + symbol[parts[1]]
                pairs[pair] = symbol[token] + pair
            else:
                whole["".join(symbol[token[i : i + 1]] for i in range(len(token)))] = symbol[token]
    by_rank = {rank: token for token, rank in ranks.items()}
    pieces = [by_rank[i].hex() if i in by_rank else "" for i in range(max(by_rank) + 1)]
    return Vocabulary("".join(symbol[bytes([b])] for b in range(256)), pairs, whole, pieces)


def _bucket(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(MAPS)).cast("int")


def _literal_maps(entries: dict[str, str]) -> Column:
    """A literal array of small maps, folded from one text when the query is planned."""
    from zlib import crc32

    maps: list[dict[str, str]] = [{} for _ in range(MAPS)]
    for key, value in entries.items():
        maps[crc32(key.encode()) % MAPS][key] = value
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False, separators=(",", ":"))), "array<map<string,string>>")


def _looked_up(maps: Column, key: Column) -> Column:
    return F.element_at(maps, _bucket(key) + 1)[key]


def symbols_of(word: Column, vocabulary: Vocabulary) -> Column:
    """The merged symbols of one word."""
    latin = "".join(map(chr, range(256)))
    start = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), latin, vocabulary.bytes_as_symbols)
    ranks = _literal_maps(vocabulary.pairs)

    def merge(state: Column, _) -> Column:
        symbols = F.split(state["word"], "")
        pairs = F.zip_with(symbols, F.slice(symbols, F.lit(2), F.greatest(F.size(symbols) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        best = F.array_min(F.transform(pairs, lambda pair: _looked_up(ranks, pair)))
        merged = F.replace(state["word"], F.substring(best, 2, 2), F.substring(best, 1, 1))
        again = F.struct(F.coalesce(merged, state["word"]).alias("word"), best.isNotNull().alias("open"))
        return F.when(state["open"], again).otherwise(state)

    steps = F.sequence(F.lit(1), F.octet_length(word))
    first = F.struct(start.alias("word"), F.lit(True).alias("open"))
    folded = F.aggregate(steps, first, merge, lambda state: state["word"])
    return F.coalesce(_looked_up(_literal_maps(vocabulary.whole), start), folded) if vocabulary.whole else folded


def words_of(text: Column, pattern: str | None = None) -> Column:
    """Matches of the pattern; ``(?U)`` gives blanks their Unicode meaning."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + (pattern or public_tokenizers.PATTERN)), F.lit(0))


def common_words(documents: DataFrame, vocabulary: Vocabulary, most: int, pattern: str | None = None) -> dict[str, str]:
    """The ``most`` most frequent words of all texts and their symbols."""
    every = documents.select(F.explode(words_of(F.col("text"), pattern)).alias("word"))
    counts = every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.octet_length("word") <= _LONG) & (F.col("n") > 1))
    top = counts.orderBy(F.col("n").desc(), "word").limit(most)
    return {r["word"]: r["symbols"] for r in top.select("word", symbols_of(F.col("word"), vocabulary).alias("symbols")).collect()}


def encoded_by_functions(documents: DataFrame, vocabulary: Vocabulary, *, most: int = 1 << 16, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``documents`` (doc_id, text)."""
    known = _literal_maps(common_words(documents, vocabulary, most, pattern))
    of_word = lambda word: F.coalesce(_looked_up(known, word), symbols_of(word, vocabulary))
    symbols = F.array_join(F.transform(words_of(F.col("text"), pattern), of_word), "")
    split = F.filter(F.split(symbols, ""), lambda s: s != "")
    return documents.select("doc_id", F.transform(split, lambda s: F.ascii(s) - BASE).alias("ids"))


# ---------------------------------------------------------------- words folded in tasks

_CACHE = 400_000
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
# public_tokenizers.PATTERN for Latin-1 texts, with its classes spelled out
_LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word. Pairs wait in a heap by rank and place, so long words stay cheap."""
    if word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    waiting = [(ranks[pair], i, pair) for i in range(len(parts) - 1) if (pair := word[i : i + 2]) in ranks]
    heapify(waiting)
    while waiting:
        _, i, pair = heappop(waiting)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != pair:
            continue  # one of the two was merged meanwhile
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
            if (right := pair + parts[after[j]]) in ranks:
                heappush(waiting, (ranks[right], i, right))
        if before[i] >= 0 and (left := parts[before[i]] + pair) in ranks:
            heappush(waiting, (ranks[left], before[i], left))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Ids of texts; common words are kept as ready 32-bit ids."""

    def __init__(self, path: str) -> None:
        self._ranks = read_ranks(path)
        self._known: dict[str, bytes] = {}
        self._any = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def _learn(self, word: str) -> bytes:
        ids = np.array(fold(word.encode(), self._ranks), "<i4").tobytes()
        if len(self._known) < _CACHE and len(word) <= _LONG:
            self._known[word] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        latin = text.isascii() or max(text) <= "\xff"
        words = (_LATIN if latin else self._any).findall(text)
        known, learn = self._known, self._learn
        return np.frombuffer(b"".join([known.get(w) or learn(w) for w in words]), "<i4")


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``documents`` (doc_id, text)."""
    ranks = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = documents.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, min(256, batch.num_rows - at))
                found = [encode(t.as_py()) for t in part.column("text")]
                edges = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of token ids."""
    pieces = F.from_json(F.lit(json.dumps(vocabulary.pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))
