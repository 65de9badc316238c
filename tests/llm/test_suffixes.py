import random

import numpy as np
import pytest

from speechtables.llm import suffixes
from tests.llm.helpers import documents, odd_texts, prose, sha


def plain(texts: dict[int, bytes]) -> dict:
    first: dict[bytes, int] = {}
    for i, b in texts.items():
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def texts_with_repeats() -> list:
    draw = random.Random(9)
    line, passage = prose(draw, 16), prose(draw, 60)
    base = prose(draw, 200)
    texts = [*odd_texts(), base, base, base[:400] + "é" + base[400:], line * 3, "x" * 49, "x" * 50, "x" * 60]
    for _ in range(25):
        texts.append("\n".join(draw.choice([line, passage, prose(draw, 12), "a" * 70, "ab" * 40]) for _ in range(4)))
    return texts


@pytest.mark.parametrize("chunk_bytes,wide_from", [(1 << 20, 4096), (600, 4096), (600, 1)])
def test_against_loops(spark, chunk_bytes, wide_from):
    texts = texts_with_repeats()
    frame = documents(spark, texts, "n_removed").repartition(3)
    rows = suffixes.repeated_removed(frame, chunk_bytes=chunk_bytes, bucket_bytes=2000, wide_from=wide_from).collect()
    expected = plain({i: (t or "").encode() for i, t in enumerate(texts)})
    facts = ["repeat_n_bytes", "repeat_n_removed", "repeat_n_spans", "repeat_kept_sha256"]
    assert {r["doc_id"]: tuple(r[f] for f in facts) for r in rows} == expected
    for r in rows:
        assert (r["lang"], r["n_removed"]) == ("en", "x")
        if not r["repeat_n_removed"]:
            assert r["text"] == (texts[r["doc_id"]] or "")


def test_empty_table_null_and_equal_ids(spark):
    assert suffixes.repeated_removed(documents(spark, [])).count() == 0
    text = prose(random.Random(1), 30)
    rows = suffixes.repeated_removed(documents(spark, [text, text, text], ids=[3, 3, None])).collect()
    assert sorted((str(r["doc_id"]), r["repeat_n_removed"]) for r in rows) == [("3", 0), ("3", 0), ("None", len(text))]


def test_rounds_give_order_symbols_and_prefixes():
    draw = np.random.default_rng(4)
    rows = draw.integers(97, 100, (40, 12), dtype=np.uint8)
    for j, order, symbols, common in suffixes.column_rounds(np.ascontiguousarray(rows.T)):
        tails = [rows[i, j:].tobytes() for i in range(40)]
        assert [tails[i] for i in order] == sorted(tails)
        assert symbols.tolist() == [rows[i, j - 1] for i in order]
        for k in range(1, 40):
            a, b = tails[order[k - 1]], tails[order[k]]
            shared = next((x for x in range(len(a)) if a[x] != b[x]), len(a))
            assert common[k] == shared
        assert common[0] == 0
