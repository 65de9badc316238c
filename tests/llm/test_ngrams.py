import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from speechtables.llm import ngrams
from speechtables.llm.eliasfano import EliasFano, Trie, code_of, ef_bytes, mapped, trie_levels
from tests.llm.helpers import documents, odd_texts

READ = "/root/testdata/sf0.001/documents.parquet"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b"\n"]


def code(p):
    return int(code_of(np.array([p]))[0])


def plain(rows, strengths=(3000.0, 10.0)):
    """The model of the module by dictionaries of n-grams, its scores in steps."""
    wide, narrow = strengths
    held = [i is not None and crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for (_, text), out in zip(rows, held):
        if not out:
            before = [b"\t", b"\t"]
            for w in words_of(text):
                one[w] += 1
                two[before[1], w] += 1
                three[before[0], before[1], w] += 1
                before = [before[1], w]
    n, v = sum(one.values()), len(one)
    context_one, context_two = Counter(), Counter()
    for (a, _), k in two.items():
        context_one[a] += k
    for (a, b, _), k in three.items():
        context_two[a, b] += k
    found = []
    for (i, text), out in zip(rows, held):
        words, before, steps, base = words_of(text), [b"\t", b"\t"], 0, 0.0
        for w in words:
            a, b = before
            p1 = (one[w] + 1) / (n + v + 1)
            p2 = code((two[b, w] + wide * p1) / (context_one[b] + wide))
            if three[a, b, w]:
                steps += code((three[a, b, w] + narrow * 10 ** (-p2 / 1024)) / (context_two[a, b] + narrow))
            else:
                steps += code(narrow / (context_two[a, b] + narrow)) + p2
            base += math.log10(p1)
            before = [b, w]
        found.append((i if i is not None else -1, out, len(words), sum(one[w] > 0 for w in words), n, base, -steps / 1024))
    return sorted(found)


def rows(found):
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in found.collect())


def same(found, expected):
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-12) and a[6] == b[6]


def test_sequences():
    draw = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [7], [1 << 40], sorted(draw.integers(0, 50, 400)), sorted(draw.integers(0, 1 << 45, 500)), [3] * 100 + [1 << 33]):
        values = np.array(values, np.int64)
        read = EliasFano(mapped(ef_bytes(values)))
        assert read.get(np.arange(len(values))).tolist() == values.tolist()
        x = np.r_[values, values + 1, draw.integers(0, 60, 50), 1 << 50]
        for lo, hi in ((0, len(values)), (len(values) // 3, len(values) // 2)):
            place, there = read.find(x, np.full(len(x), lo), np.full(len(x), hi))
            assert there.tolist() == [bool(np.isin(v, values[lo:hi])) for v in x]
            assert all(values[p] == v and lo <= p < hi for p, v, t in zip(place, x, there) if t)


def test_trie_finds_every_trigram_and_no_other():
    draw = np.random.default_rng(2)
    grams = np.unique(draw.integers(0, 9, (300, 3)) * [1, 1000, 1 << 33], axis=0)
    pairs, own = np.unique(grams[:, :2], axis=0, return_inverse=True)
    u = grams[:, 2]
    trie = Trie(trie_levels(own.ravel(), pairs[:, 0], pairs[:, 1], u, np.arange(len(pairs)), np.arange(len(grams))))
    context, pair = trie.pairs(np.r_[pairs[:, 0], 10, pairs[0, 0]], np.r_[pairs[:, 1], 0, 77])
    assert pair.tolist() == [*range(len(pairs)), -1, -1] and context[-2] == -1 and context[-1] == 0
    assert trie.pair_codes(pair[:-2]).tolist() == list(range(len(pairs)))
    assert trie.trigrams(context[own.ravel()], pair[own.ravel()], u).tolist() == list(range(len(grams)))
    known = set(map(tuple, grams.tolist()))
    ask = draw.integers(0, 9, (500, 3)) * [1, 1000, 1 << 33]
    context, pair = trie.pairs(ask[:, 0], ask[:, 1])
    assert (trie.trigrams(context, pair, ask[:, 2]) >= 0).tolist() == [tuple(r) in known for r in ask.tolist()]
    empty = Trie(trie_levels(*[np.zeros(0, np.int64)] * 6))
    assert trie.codes(np.array([3, 299 % len(grams)])).tolist() == [3, 299 % len(grams)]
    assert empty.pairs(np.array([0, 3]), np.array([0, 1]))[1].tolist() == [-1, -1]


def test_against_dictionaries(spark, monkeypatch):
    texts = [*odd_texts(), "a b a b a b", "A B a b", "one\x0btwo\x1fthree", *["the same words again and again"] * 5]
    ids = [None, *range(1, len(texts) - 1), 4]
    given = list(zip(ids, texts))
    frame = documents(spark, texts, extra="chunk", ids=ids).withColumnRenamed("n_chars", "row").repartition(3)
    same(rows(ngrams.scored(frame)[0]), plain(given))
    same(rows(ngrams.scored(frame, chunk_tokens=60, shard_rows=40, strengths=(5.0, 1.0))[0]), plain(given, (5.0, 1.0)))


def test_long_texts_are_cut_with_their_context(monkeypatch):
    monkeypatch.setattr(ngrams, "PIECE", 5)
    monkeypatch.setattr(ngrams, "_LETTERS", 16)
    text = " ".join(f"w{i % 7}" for i in range(61)) + "   " + "x" * 90 + " y"
    found = list(ngrams.pieces_of(text.encode()))
    assert len(found) > 10 and all(0 < len(p) <= 6 for p in found)
    assert [w for p in found for w in p] == words_of(text)
    assert [w for p in ngrams.pieces_of(b"a b c d e") for w in p] == [*b"a b c d e".split(), b"\n"]
    assert list(ngrams.pieces_of(b" \t ")) == [[b"\n"]]


def test_pieces_score_as_one_text(spark):
    words = [f"w{i * i % 11}" for i in range(40)]
    whole, cut = ngrams._Chunk(0), ngrams._Chunk(1)
    whole.add(0, 1, False, [b"\t", b"\t"], [w.encode() for w in words])
    cut.add(0, 1, False, [b"\t", b"\t"], [w.encode() for w in words[:15]])
    cut.add(0, 1, False, [w.encode() for w in words[13:15]], [w.encode() for w in words[15:]])
    a, b = (ngrams._Read(0, c.row()[2]) for c in (whole, cut))
    assert a.train.sum() == b.train.sum() == 40
    assert all(x.tolist() == y.tolist() for x, y in zip(a.trigrams(), b.trigrams()))
    assert a.trigrams()[1].sum() == 40


def test_documents_table(spark):
    table = spark.read.parquet(READ)
    given = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    found, levels = ngrams.scored(table, chunk_tokens=3000)
    expected = plain(given)
    same(rows(found), expected)
    held = [r for r in expected if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert all(len(r["levels"]) == 9 for r in levels.collect())


def test_no_rows_and_no_training_rows(spark):
    assert rows(ngrams.scored(documents(spark, []))[0]) == []
    held = [i for i in range(60) if crc32(str(i).encode()) % 7 == 2][:3]
    given = [(i, t) for i, t in zip(held, ["a b", None, ""])]
    same(rows(ngrams.scored(documents(spark, [t for _, t in given], ids=held))[0]), plain(given))


def test_longs_without_a_high_half_are_stored_as_32_bits():
    draw = np.random.default_rng(3)
    for top, width in ((1 << 20, 4), (1 << 32, 4), (1 << 40, 8)):
        values = np.r_[draw.integers(0, top, 500), top - 1]
        data = ngrams.pack(values)
        assert data[0] == width and ngrams.unpack(data).dtype == np.int64 and (ngrams.unpack(data) == values).all()
    for kind, values in (("<i8", [-1, 5]), ("<i8", []), ("<f8", [0.5, -2]), ("u1", [1, 0]), ("<u8", [1, 1 << 63]), ("<u4", [7])):
        assert ngrams.unpack(ngrams.pack(np.array(values, kind), kind), kind).tolist() == values


def test_keys_are_dealt_in_order_to_many_shards():
    keys = np.random.default_rng(4).integers(0, 1 << 63, 3000, np.uint64)
    for shards in (7, 1 << 16, (1 << 16) + 1):
        for shard, places in ngrams._dealt(keys, shards):
            assert places.tolist() == np.flatnonzero(keys % np.uint64(shards) == shard).tolist()
