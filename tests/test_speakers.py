"""Speaker mapping against word-by-word loops."""

import random

import pytest
from pyspark.sql import functions as F

from speechtables.operators import speakers as op

BLOCK = 4
NEAR = 300


def make(seed, n_segments, n_turns, early=False):
    """Segments with words, and turns, both in order without overlap."""
    draw = random.Random(seed)
    segments, at = [], 0
    for _ in range(n_segments):
        at += draw.randint(0, 900)
        words, t = [], at
        for _ in range(draw.randint(1, 7)):
            t += draw.choice([0, 100, 250])
            words.append((t, t + draw.randint(50, 700), "x" * draw.randint(1, 9)))
            t = words[-1][1]
        start = words[0][0] - (draw.choice([0, 400, 900]) if early else 0)
        start = max(start, at - 900) if early else words[0][0]
        segments.append((start, t, words))
        at = t
    turns, t = [], 0
    for _ in range(n_turns):
        t += draw.randint(300, 2500)
        turns.append((t, draw.randint(0, 2)))
    return segments, turns


def loop_mapping(segments, turns, compat):
    """The rule in words: walk through the pieces, keep the turn in force, cut where it ends."""
    ends = [e for e, _ in turns]
    at, end, speaker = 0, ends[0], turns[0][1]
    queue = [(s, e, [w[2] for w in ws], ws, i) for i, (s, e, ws) in enumerate(segments)]
    rows, was_cut = [], False
    while queue:
        start, stop, tokens, words, seg = queue.pop(0)
        while start > end - NEAR:
            at = min(at + 1, len(turns) - 1)
            end, speaker = turns[at]
            if at == len(turns) - 1:
                end = stop
                break
        cut = None
        if stop > end + NEAR:
            cut = next((k for k, w in enumerate(words) if w[0] > end - NEAR), None)
        if cut is None:
            piece = (seg, start, stop, " ".join(tokens))
        else:
            k = max(cut, 1)
            piece = (seg, words[0][0], words[k - 1][1], " ".join(tokens[:k]))
            rest = k if not (compat and cut == 0) else 0
            if rest < len(words):
                queue.insert(0, (words[rest][0], stop, tokens[rest:], words[rest:], seg))
            else:
                piece = (seg, words[0][0], stop, piece[3])
        if was_cut and len(rows) > 1:
            if len(rows[-1][3]) > len(piece[3]):
                speaker = rows[-1][4]
            elif len(rows[-1][3]) < len(piece[3]):
                rows[-1] = (*rows[-1][:4], speaker)
        rows.append((*piece, speaker))
        was_cut = cut is not None
    return rows


@pytest.mark.parametrize("compat", [False, True])
def test_segments_to_turns(spark, compat):
    data = {}
    for r in range(24):
        data[r] = make(r, 1 + r % 9, 1 + r % 5)
    segs = [(r, i, s, e, " ".join(w[2] for w in ws)) for r, (sg, _) in data.items() for i, (s, e, ws) in enumerate(sg)]
    words = [(r, i, k, w[2], w[0], w[1]) for r, (sg, _) in data.items() for i, (_, _, ws) in enumerate(sg) for k, w in enumerate(ws)]
    turns = [(r, i, e, s) for r, (_, ts) in data.items() for i, (e, s) in enumerate(ts)]
    out = op.segments_to_turns(
        spark.createDataFrame(segs, "recording_id bigint, seq bigint, start bigint, end bigint, text string"),
        spark.createDataFrame(words, "recording_id bigint, seq bigint, pos int, word string, start bigint, end bigint"),
        spark.createDataFrame(turns, "recording_id bigint, seq bigint, end bigint, speaker int"),
        NEAR,
        1000,
        compat=compat,
        rows=BLOCK,
    ).collect()
    pieces = 0
    for r, (segments, ts) in data.items():
        got = [(x.seq, x.start, x.end, x.text, x.speaker) for x in sorted((x for x in out if x.recording_id == r), key=lambda x: (x.seq, x.piece))]
        wanted = loop_mapping(segments, ts, compat)
        assert got == wanted, r
        pieces += len(wanted) - len(segments)
    assert pieces > 10


def test_first_word_past_the_turn(spark):
    """A segment starting before its words: the first word stands alone, repeated only on request."""
    segments = spark.createDataFrame([(0, 0, 0, 5000, "a b c")], "recording_id bigint, seq bigint, start bigint, end bigint, text string")
    words = spark.createDataFrame(
        [(0, 0, 0, "a", 1500, 2000), (0, 0, 1, "b", 2000, 3000), (0, 0, 2, "c", 3000, 5000)],
        "recording_id bigint, seq bigint, pos int, word string, start bigint, end bigint",
    )
    turns = spark.createDataFrame([(0, 0, 1000, 0), (0, 1, 9000, 1)], "recording_id bigint, seq bigint, end bigint, speaker int")

    def texts(compat):
        rows = op.segments_to_turns(segments, words, turns, NEAR, 1000, compat=compat, rows=BLOCK).collect()
        return [(x.text, x.speaker) for x in sorted(rows, key=lambda x: x.piece)]

    assert texts(False) == [("a", 0), ("b c", 1)]
    assert texts(True) == [("a", 0), ("a b c", 1)]


def loop_realign(words, speakers, most):
    def ends(i):
        return words[i][-1] in ".?!"

    n, k, speakers = len(words), 0, list(speakers)
    while k < n - 1:
        here, k = k, k + 1
        if speakers[here] == speakers[here + 1] or ends(here):
            continue
        left = here
        while left > 0 and here - left < most and speakers[left - 1] == speakers[left] and not ends(left - 1):
            left -= 1
        if left and not ends(left - 1):
            continue
        right = here
        while right < n and right - here < most - here + left - 1 and not ends(right):
            right += 1
        if right >= n or not (ends(right) or right == n - 1):
            continue
        labels = speakers[left : right + 1]
        top = min(set(labels), key=lambda s: (-labels.count(s), s))
        if labels.count(top) >= len(labels) // 2:
            speakers[left : right + 1] = [top] * len(labels)
            k = right + 1
    return speakers


@pytest.mark.parametrize("most", [5, 12])
def test_realign_by_sentence(spark, most):
    draw = random.Random(11)
    data = {}
    for r, n in enumerate([1, 2, 30, 150]):
        speaker, rows = 0, []
        for _ in range(n):
            speaker = draw.choice([speaker, speaker, speaker, draw.randint(0, 2)])
            rows.append((draw.choice(["a", "b", "c", "d."]), speaker))
        data[r] = rows
    df = spark.createDataFrame([(r, i, w, s) for r, v in data.items() for i, (w, s) in enumerate(v)], "recording_id bigint, at bigint, word string, speaker int")
    out = op.realign_by_sentence(df, most, rows=40).collect()
    changed = 0
    for r, rows in data.items():
        got = [x.speaker for x in sorted((x for x in out if x.recording_id == r), key=lambda x: x.at)]
        before = [s for _, s in rows]
        assert got == loop_realign([w for w, _ in rows], before, most)
        changed += got != before
    assert changed


def test_words_to_turns_after_the_last_turn(spark):
    words = spark.createDataFrame([(0, i, t, t + 10) for i, t in enumerate([5, 10, 11, 30, 99])], "recording_id bigint, pos int, start bigint, end bigint")
    turns = spark.createDataFrame([(0, 0, 10, 1), (0, 1, 25, 0), (0, 2, 40, 2)], "recording_id bigint, seq bigint, end bigint, speaker int")
    got = op.words_to_turns(words, turns, 8).orderBy("pos").select("speaker").collect()
    assert [x.speaker for x in got] == [1, 1, 0, 2, 2]
    middle = op.words_to_turns(words.select("recording_id", "pos", "start", (F.col("end") + 10).alias("end")), turns, 8, "mid")
    assert [x.speaker for x in middle.orderBy("pos").collect()] == [0, 0, 0, 2, 2]
