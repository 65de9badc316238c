from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers

from speechtables.llm import chat
from tests.llm.helpers import sha

ROWS = "conv_id bigint, turn bigint, role string, text string, segment string"
HARD = st.lists(st.sampled_from(["<", "|", "\\", "end", ">", "\n", "[", "/INST]", "s>", "/", "é", "😀", " ", "word", "!", "<|end|>\n", "</s>"]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), HARD), HARD), max_size=6)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_turns_and_masks_come_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    wanted = [t for r, t in turns if r == "assistant" and t]
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == wanted
    found = ENCODER.encode(formatted, add_special_tokens=False)
    starts, ends = chat.token_spans(found.offsets)
    token, first, last = chat.masked_tokens(starts, ends, spans)
    brute = [(t, max(s, a), min(e, b)) for a, b in spans for t, (s, e) in enumerate(zip(starts, ends)) if min(e, b) > max(s, a)]
    assert list(zip(token, first, last)) == brute
    row = {"formatted": formatted, "loss_start": first.astype("<i8").tobytes(), "loss_end": last.astype("<i8").tobytes()}
    assert chat.loss_texts(row) == wanted


ENCODER = chat._encoder(public_tokenizers.path("byte_bpe_50k.json"))


def plain(turns):
    spoken = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(spoken), sha(spoken)


def test_conversations(spark):
    long = [(7, t, "assistant" if t % 2 else "user", f"turn {t} é <|end|>", "z") for t in range(300)]
    odd = [(1, 0, "user", None, "z"), (1, 1, "assistant", "", "z"), (1, None, None, "first", "z"), (1, 1, "assistant", "", "z")]
    same = [(2, 3, "assistant", "b", "z"), (2, 3, "assistant", "a", "z"), (None, 0, "assistant", "no id", "z")]
    rows = [*long, *odd, *same, (-1, 0, "user", "</s>[INST] ok [/INST]", "z"), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "z")]
    expected = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        expected[conv] = plain([(r, t) for _, r, t in own])
    frame = spark.createDataFrame(rows, ROWS)
    for turns, chars in ((1024, 1 << 20), (64, 500)):
        found = chat.digests(chat.formatted(frame, segment_turns=turns, segment_chars=chars)).collect()
        assert {r["conv_id"]: tuple(r)[1:5] for r in found} == expected
        assert len(found) == len(expected) and all(r["formatted_chars"] > 0 for r in found)
    assert chat.digests(chat.formatted(spark.createDataFrame([], ROWS))).count() == 0


def test_stretches_encode_like_the_whole(spark):
    frame = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"said {t}!\n", "z") for t in range(40)], ROWS)
    whole = chat.formatted(frame).collect()
    parts = sorted(chat.formatted(frame, segment_turns=7).collect(), key=lambda r: r["segment"])
    assert len(whole) == 1 and len(parts) == 6
    assert bytes(whole[0]["ids"]) == b"".join(bytes(p["ids"]) for p in parts)


def test_batches_go_by_characters(spark, monkeypatch):
    """Many long conversations in one task: what is encoded at once stays near ``batch_chars``."""
    rows = [(c, t, "assistant", f"{c} {t} " + "long text " * 400, "z") for c in range(30) for t in range(3)]
    frame = spark.createDataFrame(rows, ROWS).coalesce(1)
    sizes = spark.sparkContext.accumulator(0)
    plain_encoder = chat._encoder

    class Watched:
        def __init__(self, path):
            self._encoder = plain_encoder(path)

        def encode_batch(self, texts, **options):
            sizes.add(sum(map(len, texts)) > 30_000 + 13_000)
            return self._encoder.encode_batch(texts, **options)

    monkeypatch.setattr(chat, "_encoder", Watched)
    whole = sorted(map(tuple, chat.digests(chat.formatted(frame)).collect()))
    assert whole == sorted(map(tuple, chat.digests(chat.formatted(frame, batch_chars=30_000)).collect()))
    assert len(whole) == 30
