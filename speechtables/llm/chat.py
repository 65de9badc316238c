"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered with a template that opens and closes every turn, encoded once with offsets, and
the character spans of assistant texts are intersected with the token spans by binary search. The output
holds, per rendered stretch, the text, token ids, token spans, and the spans under the loss mask.

Control strings inside a text (the template's own ``<|``, and ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get one
backslash after their first character, and one more where there are some, so every text can be restored. Turn
marks are special tokens, so no token crosses the edge of a turn of a known role; at other roles the
spans are clipped to the turn.

A conversation of up to ``segment_turns`` turn numbers is one stretch. Longer ones are cut at turn numbers,
and a stretch ends early at ``segment_chars`` characters, so that no task gathers a conversation that grows
with the data; since turn marks are whole tokens, the ids are those of the whole conversation.

Defined cases: null text and null role are empty; a null turn comes first and a null conversation id is a
conversation; equal turn numbers are ordered by role, then text; repeated rows are repeated turns; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

END = "<|end|>\n"
ROLES = ("user", "assistant", "system")
_CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])(\\*)\\(\||/?s>|/?INST\])")
_TURN = re.compile(r"<\|((?:[^|\\]|\\.)*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("|", "\\p")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "|" if m[1] == "p" else m[1], role, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the character spans of the assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape_role(role)}|>\n", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def token_spans(offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends without the gaps that trimmed blanks leave."""
    pairs = np.array(offsets, np.int64).reshape(-1, 2)
    ends = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
    starts = np.minimum(pairs[:, 0], np.r_[0, ends[:-1]]) if len(pairs) else pairs[:, 0]
    return starts, ends


def masked_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]):
    """Numbers of the tokens that share a character with a span, and what they share."""
    begin = np.array([a for a, _ in spans], np.int64)
    stop = np.array([b for _, b in spans], np.int64)
    first = np.searchsorted(ends, begin, "right")
    last = np.searchsorted(starts, stop, "left")
    count = np.maximum(last - first, 0)
    token = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return token, np.maximum(starts[token], np.repeat(begin, count)), np.minimum(ends[token], np.repeat(stop, count))


def _encoder(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(END, special=True), *(AddedToken(f"<|{r}|>\n", special=True) for r in ROLES)])
    return tokenizer


_OUT = (
    "conv_id bigint, segment bigint, part int, formatted string, ids binary, starts binary, ends binary, "
    "loss_token binary, loss_start binary, loss_end binary"
)
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def formatted(
    conversations: DataFrame,
    *,
    tokenizer: str | None = None,
    segment_turns: int = 1024,
    segment_chars: int = 1 << 20,
    batch_chars: int = 1 << 21,
) -> DataFrame:
    """Stretches of formatted conversations; number arrays are little-endian (ids 32 bits, others 64).

    Stretches are encoded together until they hold ``batch_chars`` characters (about 80 bytes of memory each).
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-1 << 40)).cast("bigint").alias("segment"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "segment", "turn", "role", "text"]
    dealt = rows.repartition("conv_id", "segment").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        little = lambda x, kind="<i8": np.asarray(x).astype(kind).tobytes()
        done: list[tuple] = []
        waiting = 0

        def close(key: tuple, part: int, turns: list) -> bool:
            """Whether enough waits to be encoded."""
            nonlocal waiting
            text, spans = render(turns)
            done.append((*key, part, text, spans))
            waiting += len(text)
            return waiting >= batch_chars or len(done) >= 256

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            waiting = 0
            columns: list[list] = [[] for _ in _NAMES]
            for (conv, segment, part, text, spans), found in zip(done, encode.encode_batch([d[3] for d in done], add_special_tokens=False)):
                starts, ends = token_spans(found.offsets)
                token, a, b = masked_tokens(starts, ends, spans)
                row = (conv, segment, part, text, little(found.ids, "<u4"), *map(little, (starts, ends, token, a, b)))
                for column, value in zip(columns, row):
                    column.append(value)
            done.clear()
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)

        key, part, turns, size = None, 0, [], 0
        for batch in batches:
            for conv, segment, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "role", "text"))):
                if (conv, segment) != key or size + len(text) > segment_chars:
                    if turns and close(key, part, turns):
                        yield flush()
                    part = part + 1 if (conv, segment) == key else 0
                    key, turns, size = (conv, segment), [], 0
                turns.append((role, text))
                size += len(text)
        if turns:
            close(key, part, turns)
        if done:
            yield flush()

    return dealt.mapInArrow(run, _OUT)


def loss_texts(row: dict) -> list[str]:
    """The texts under the loss mask of one stretch, unescaped."""
    starts, ends = np.frombuffer(row["loss_start"], "<i8"), np.frombuffer(row["loss_end"], "<i8")
    if not len(starts):
        return []
    ends = np.maximum.accumulate(ends)
    fresh = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    last = np.r_[fresh[1:] - 1, len(starts) - 1]
    return [unescape(row["formatted"][a:b]) for a, b in zip(starts[fresh].tolist(), ends[last].tolist())]


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(stretches: DataFrame) -> DataFrame:
    """What a reader gets back from the output, per conversation: stretches are streamed in order, nothing but
    running hashes is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def result() -> pa.RecordBatch:
            conv, n, turns, chars, loss, size = state
            values = (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [c.split()[0] for c in _DIGEST.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        yield result()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(row["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for text in loss_texts(row):
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(row["formatted"])
        if state is not None:
            yield result()

    wanted = stretches.select("conv_id", "segment", "part", "formatted", "loss_start", "loss_end")
    return wanted.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part").mapInArrow(run, _DIGEST)
