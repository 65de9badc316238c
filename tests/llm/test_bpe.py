import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from speechtables.llm import bpe
from tests.llm.helpers import documents, odd_texts, sha

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_and_bytes_against_the_library(spark):
    known = bpe.vocabulary()
    texts = [*odd_texts(), "don't 'S x  y  \u0085z\n\n  end  ", "ﷺ 𝒳𝒴 ١٢٣ ½²", "\x00\x01\x1c\x1f", "ababababab" * 30, "tttttttthe"]
    frame = documents(spark, texts, "ids")
    for found in (bpe.encoded(frame), bpe.encoded_by_functions(frame, known, most=3)):
        rows = {r["doc_id"]: r for r in found.collect()}
        assert len(rows) == len(texts)
        for i, text in enumerate(texts):
            assert rows[i]["ids"] == PLAIN.encode_ordinary(text or ""), text
    tokens = bpe.encoded(frame)
    back = {r["doc_id"]: bytes(r["data"]) for r in tokens.select("doc_id", bpe.decoded(tokens["ids"], known).alias("data")).collect()}
    assert {i: sha(b) for i, b in back.items()} == {i: sha(t or "") for i, t in enumerate(texts)}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ENCODER(text).tolist() == PLAIN.encode_ordinary(text)


ENCODER = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_empty_table(spark):
    assert bpe.encoded(documents(spark, [])).count() == 0


def test_every_token_is_reached_by_two_parts_of_lower_rank():
    known = bpe.vocabulary()
    assert len(known.pairs) + len(known.whole) == len(RANKS) - 256
    for token in list(RANKS)[300:50256:997]:
        parts = bpe.parts_of(token, RANKS)
        assert b"".join(parts) == token and all(RANKS[p] < RANKS[token] for p in parts)
