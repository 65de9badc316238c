import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from speechtables.llm import common, packing
from tests.llm.helpers import documents, odd_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_every_token_once_and_windows_full(lengths):
    pieces, windows = packing.pack(lengths)
    covered, filled = defaultdict(list), defaultdict(list)
    for document, start, length, window, offset in pieces:
        assert length > 0
        covered[document].append((start, length))
        filled[window].append((offset, length))
    for parts, sizes in ((covered, dict(enumerate(lengths))), (filled, dict(enumerate(windows)))):
        for key, size in sizes.items():
            at = 0
            for start, length in sorted(parts[key]):
                assert start == at
                at += length
            assert at == size
    assert all(w <= 2048 and w & (w - 1) == 0 for w in windows)
    short = [w for w in windows if w not in packing.TIERS]
    assert len(short) == len(set(short))  # only the last tokens are split further
    groups = packing.step_groups(windows, 8192)
    totals = defaultdict(int)
    for window, group in zip(windows, groups.tolist()):
        totals[group] += window
    assert sorted(totals.values())[1:] == [8192] * (len(totals) - 1) if totals else True


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=1, max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_ids_are_the_tokenizers_own(texts):
    found = ENCODER(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in found] == [plain_ids(t) for t in texts]


ENCODER = packing.Encoder(PATH)


def test_rows_against_the_tokenizer(spark):
    texts = odd_texts()
    rows = packing.packed(documents(spark, texts, "offset"), block_tokens=3000).collect()
    by_document, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*plain_ids(text), 1], "<u4")
        at = 0
        for r in sorted(by_document[i], key=lambda r: r["start"]):
            piece = ids[r["start"] : r["start"] + r["length"]].tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(piece), piece)
            at += r["length"]
        assert at == len(ids)
    for parts in by_window.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == parts[0]["tier"]


def test_empty_table_and_null_ids(spark):
    assert packing.packed(documents(spark, [])).count() == 0
    assert [r["doc_id"] for r in packing.packed(documents(spark, ["a"], ids=[None])).collect()] == [None, None][:1]


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_WORDS", 5)
    monkeypatch.setattr(packing, "_PIECES", 5)
    encoder = packing.Encoder(PATH)
    for _ in range(3):
        texts = [" ".join(f"ab{i}c{j}" for j in range(9)) for i in range(9)]
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder(texts)] == [plain_ids(t) for t in texts]
        assert len(encoder._words) <= 5 and len(encoder._pieces) <= 5


def test_a_worker_keeps_one_encoder_until_other_operators_run(monkeypatch):
    monkeypatch.setattr(common, "_RESIDENT", {})
    kept = packing._encoder(PATH)
    assert packing._encoder(PATH) is kept
    common.make_room()
    assert not common._RESIDENT and packing._encoder(PATH) is not kept
    common.resident("other", object)
    assert list(common._RESIDENT) == ["other"]
