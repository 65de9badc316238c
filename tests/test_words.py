"""Word rules against loops."""

import random

from pyspark.sql import functions as F

from speechtables.operators import words as op


def test_punctuation(spark):
    draw = random.Random(1)
    bits = [" a", " b", "c", ".", ",", " \"", " (", ")", " ¿", "?", " -", "。"]
    data = {r: [draw.choice(bits) for _ in range(draw.randint(1, 12))] for r in range(120)}
    df = spark.createDataFrame([(r, 0, i, w, 1) for r, v in data.items() for i, w in enumerate(v)], "recording_id bigint, seq bigint, pos bigint, word string, n_tokens int")
    got = {}
    for x in op.merge_punctuation(df).orderBy("recording_id", "pos").collect():
        got.setdefault(x.recording_id, []).append((x.pos, x.word, x.n_tokens))
    for r, items in data.items():
        words = [[w, 1] for w in items]
        holder = len(words) - 1
        for i in reversed(range(len(words) - 1)):
            if words[i][0][0] == " " and words[i][0].strip() in op.OPENING_MARKS:
                words[holder] = [words[i][0] + words[holder][0], words[i][1] + words[holder][1]]
                words[i] = ["", 0]
            else:
                holder = i
        holder = 0
        for j in range(1, len(words)):
            if words[j][0] in op.CLOSING_MARKS and not words[holder][0].endswith(" "):
                words[holder] = [words[holder][0] + words[j][0], words[holder][1] + words[j][1]]
                words[j] = ["", 0]
            else:
                holder = j
        assert got.get(r, []) == [(i, w, n) for i, (w, n) in enumerate(words) if w], items


def test_boundaries(spark):
    draw = random.Random(2)
    rows, at = [], 0.0
    for seq in range(40):
        at += draw.choice([0.0, 0.5, 4.0])
        words, t = [], at
        for _ in range(draw.randint(0, 4)):
            t += draw.choice([0.0, 0.2])
            words.append({"word": "w", "start": t, "end": t + draw.choice([0.1, 0.3, 1.5]), "probability": 0.5})
            t = words[-1]["end"]
        rows.append((0, seq, at + draw.choice([0.0, 0.7]), t - draw.choice([0.0, 0.6]), words, 0.2, 0.4))
        at = t
    df = spark.createDataFrame(rows, f"recording_id bigint, seq bigint, start double, end double, words {op.WORDS_TYPE}, median double, longest double")
    got = op.fix_boundaries(df, rows=6).orderBy("seq").collect()
    spoken, moved = 0.0, 0
    for row, (_, _, start, end, words, median, longest) in zip(got, rows):
        w = [[x["start"], x["end"]] for x in words]
        if w:
            if w[0][1] - spoken > 4 * median and (w[0][1] - w[0][0] > longest or len(w) > 1 and w[1][1] - w[0][0] > 2 * longest):
                if len(w) > 1 and w[1][1] - w[1][0] > longest:
                    w[0][1] = w[1][0] = max(w[1][1] / 2, w[1][1] - longest)
                w[0][0] = max(0, w[0][1] - longest)
            if start < w[0][1] and start - 0.5 > w[0][0]:
                w[0][0] = max(0, min(w[0][1] - median, start))
            else:
                start = w[0][0]
            if end > w[-1][0] and end + 0.5 < w[-1][1]:
                w[-1][1] = max(w[-1][0] + median, end)
            else:
                end = w[-1][1]
            spoken = end
        assert (row.start, row.end) == (start, end)
        assert [[x.start, x.end] for x in row.words] == w
        moved += w != [[x["start"], x["end"]] for x in words]
    assert moved


def odd(words):
    real = [w for w in words if w["word"] not in op.OPENING_MARKS + op.CLOSING_MARKS][:8]
    score = 0.0
    for w in real:
        length = w["end"] - w["start"]
        score += (w["probability"] < 0.15) + max(0.0, (0.133 - length) * 15) + max(0.0, length - 2.0)
    return bool(words) and (score >= 3 or score + 0.01 >= len(real))


def test_hallucinations(spark):
    draw = random.Random(3)
    rows = []
    for window in range(80):
        at, origin = window * 30.0 + draw.choice([0.0, 5.0]), window * 30.0
        for k in range(draw.randint(1, 5)):
            at += draw.choice([0.1, 3.0])
            start, words = at, []
            for _ in range(draw.randint(0, 3)):
                words.append({"word": draw.choice([" a", "."]), "start": at, "end": at + draw.choice([0.05, 0.4, 4.0]), "probability": draw.choice([0.1, 0.9])})
                at = words[-1]["end"]
            rows.append((0, window, window * 10 + k, start, at, words, origin, origin + 30.0, max(0.0, origin - 1)))
    df = spark.createDataFrame(
        rows, f"recording_id bigint, window bigint, seq bigint, start double, end double, words {op.WORDS_TYPE}, window_start double, window_end double, last_speech double"
    )
    got = {x.seq for x in op.drop_hallucinations(df, 2.0).collect()}
    wanted = set()
    for window in range(80):
        part = [r for r in rows if r[1] == window]
        spoken = [r for r in part if r[5]]
        if spoken and odd(spoken[0][5]) and spoken[0][3] - window * 30.0 > 2.0:
            continue
        before, cut = part[0][8], None
        for r in spoken:
            after = [s for s in spoken if s[2] > r[2]]
            if odd(r[5]):
                following = after[0][5][0]["start"] if after else r[7]
                left = r[3] - before > 2.0 or r[3] < 2.0 or r[3] - r[6] < 2.0
                right = following - r[4] > 2.0 or (after and odd(after[0][5])) or r[7] - r[4] < 2.0
                if left and right:
                    cut = r[2]
                    break
            before = r[4]
        wanted |= {r[2] for r in part if cut is None or r[2] < cut}
    assert got == wanted and len(wanted) < len(rows)


def test_sentences_from_characters(spark):
    chars = []
    words = [("ab", 1.0, 2.0), ("cde", None, None), ("f", 1.5, 3.0), ("gh", None, None)]
    k = 0
    for w, (text, a, b) in enumerate(words):
        for c in text:
            chars.append((0, 0, 0, w, k, c, a, b, 0.8 if a is not None else None))
            k += 1
        chars.append((0, 0, 0, w, k, " ", None, None, None))
        k += 1
    df = spark.createDataFrame(chars, "recording_id bigint, seq bigint, sentence bigint, word_idx int, char_idx int, char string, start double, end double, score double")
    (row,) = op.chars_to_sentences(df).collect()
    rate = (2.0 - 1.0) / 2
    second = (2.0, 2.0 + 3 * rate)
    third = (second[1], 3.0)
    fourth = (3.0, 3.0 + 2 * rate)
    assert (row.start, row.end) == (1.0, 3.0)
    assert [(w.word, w.start, w.end, w.score) for w in row.words] == [
        ("ab", 1.0, 2.0, 0.8),
        ("cde", *second, 0.5),
        ("f", *third, 0.8),
        ("gh", *fourth, 0.5),
    ]


def test_missing_times(spark):
    draw = random.Random(4)
    rows = []
    for seq in range(60):
        start = draw.choice([None, float(seq * 10)])
        end = draw.choice([None, float(seq * 10 + 8)])
        rows.append((0, seq, start, end, "x" * draw.randint(1, 9)))
    df = spark.createDataFrame(rows, "recording_id bigint, seq bigint, start double, end double, text string")
    timed = [r for r in rows if r[2] is not None and r[3] is not None]
    rate = sum(r[3] - r[2] for r in timed) / sum(len(r[4]) for r in timed)
    last = 0.0
    for got, (_, _, start, end, text) in zip(op.estimate_missing_times(df, rows=7).orderBy("seq").collect(), rows):
        if start is None:
            start, end = last, last + len(text) * rate
        elif end is None:
            end = start + len(text) * rate
        assert abs(got.start - start) < 1e-9 and abs(got.end - end) < 1e-9
        last = end
    bare = spark.createDataFrame([(0, 0, None, None, "abcd")], df.schema)
    assert op.estimate_missing_times(bare).select(F.round("end", 6)).first()[0] == 0.4


def test_segments_are_dealt_out_by_their_number_before_they_become_rows(spark, tmp_path, monkeypatch):
    from speechtables.catalog import tables, words

    turns = [(conv, turn, "user", f"one two, three {conv}") for conv in range(30) for turn in range(2)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(tables, "SEGMENTS_PER_TASK", 5, raising=False)
    for name in ("char_words", "char_sentences", "repeats"):
        plan = getattr(words, name)(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and ", 12), REPARTITION_BY_NUM" in plan
    pieces = words.subword_rows(spark, str(tmp_path))
    assert "Union" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    ends = pieces.filter("token = 50257").collect()
    assert len(ends) == 60 and {(r.tok, r.subword) for r in ends} == {(6, "")}
