"""Region machines against frame-by-frame loops; blocks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from speechtables.operators import regions as op
from speechtables.plans.sliding import least_ahead

BLOCK = 7


def scores(seed, lengths=(1, 5, 30, 90)):
    draw = random.Random(seed)
    out = {}
    for r, n in enumerate(lengths):
        level, values = 0.5, []
        for _ in range(n):
            level = min(1.0, max(0.0, level + draw.choice([-0.3, -0.1, 0.0, 0.1, 0.3])))
            values.append(round(level, 2))
        out[r] = values
    return out


def frames(spark, data):
    return spark.createDataFrame([(r, i, p) for r, v in data.items() for i, p in enumerate(v)], "recording_id bigint, frame bigint, prob double")


def by_recording(rows, *columns):
    out = {}
    for row in rows:
        out.setdefault(row["recording_id"], []).append(tuple(row[c] for c in columns))
    return {r: sorted(v) for r, v in out.items()}


def loop_hysteresis(values, on, off):
    out, start = [], None
    for i, p in enumerate(values):
        if start is None and on(p):
            start = i
        elif start is not None and off(p):
            out.append((start, i - 1))
            start = None
    return out + ([(start, len(values) - 1)] if start is not None else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_speech_regions(spark, seed):
    data = scores(seed)
    got = by_recording(op.speech_regions(frames(spark, data), 0.6, 0.4, rows=BLOCK).collect(), "start_frame", "end_frame")
    wanted = {r: loop_hysteresis(v, lambda p: p >= 0.6, lambda p: p < 0.4) for r, v in data.items()}
    assert got == {r: w for r, w in wanted.items() if w}


def test_long_regions(spark):
    data = scores(3, (4, 40, 120))
    df = frames(spark, data)
    found = op.speech_regions(df, 0.3, 0.1, rows=BLOCK)
    got = by_recording(op.cut_long_regions(df, found, 10, rows=BLOCK).collect(), "start_frame", "end_frame", "first", "final")
    wanted = {}
    for r, values in data.items():
        for a, b in loop_hysteresis(values, lambda p: p >= 0.3, lambda p: p < 0.1):
            s = a
            while b - s > 10:
                window = values[s + 5 : min(b, s + 10)]
                cut = s + 5 + window.index(min(window))
                wanted.setdefault(r, []).append((s, cut, s == a, False))
                s = cut + 1
            wanted.setdefault(r, []).append((s, b, s == a, True))
    assert any(len(w) > 3 for w in wanted.values())
    assert got == {r: sorted(w) for r, w in wanted.items()}


def loop_binarize_limited(values, onset, offset, most):
    active, start, seen, out = values[0] > onset, 0, [(values[0], 0)], []
    for t in range(1, len(values)):
        y = values[t]
        if active:
            if t - start > most:
                half = len(seen) // 2
                low = min(range(half, len(seen)), key=lambda k: seen[k][0])
                out.append((start, seen[low][1]))
                start, seen = seen[low][1], seen[low + 1 :]
            elif y < offset:
                out.append((start, t))
                active, start, seen = False, t, []
            seen.append((y, t))
        elif y > onset:
            active, start = True, t
    return out + ([(start, len(values) - 1)] if active else [])


def test_binarize_with_limit(spark):
    data = scores(4, (1, 2, 50, 90))
    got = by_recording(op.binarize_limited(frames(spark, data), 0.3, 9, 0.2, rows=BLOCK).collect(), "start_frame", "end_frame")
    wanted = {r: sorted(loop_binarize_limited(v, 0.3, 0.2, 9)) for r, v in data.items()}
    assert got == {r: w for r, w in wanted.items() if w}


def loop_activity(values, threshold, shortest, longest, pause, cut_pause):
    """Speech marked second by second: a list of events per frame instead of running variables."""
    found, frame = [], 0
    total = 512 * len(values)
    start = quiet = None
    last_pause, resumed = None, None
    for frame, p in enumerate(values):
        at = 512 * frame
        if p >= threshold:
            if quiet is not None:
                quiet = None
                if last_pause is not None and (resumed is None or resumed < last_pause):
                    resumed = at
            if start is None:
                start = at
                continue
        if start is not None and at - start > longest:
            if last_pause is None:
                found.append((start, at))
                start = quiet = resumed = None
                continue
            found.append((start, last_pause))
            start = resumed if resumed is not None and resumed >= last_pause else None
            quiet = last_pause = resumed = None
        if start is not None and p < threshold - 0.15:
            quiet = at if quiet is None else quiet
            if at - quiet > cut_pause:
                last_pause = quiet
            if at - quiet >= pause:
                if quiet - start > shortest:
                    found.append((start, quiet))
                start = quiet = last_pause = resumed = None
    if start is not None and total - start > shortest:
        found.append((start, total))
    return found


@pytest.mark.parametrize("longest", [float("inf"), 1.5])
def test_voice_activity(spark, longest):
    data = scores(6, (3, 60, 200))
    got = by_recording(
        op.voice_activity(frames(spark, data), 0.5, 60, longest, 200, 30, rows=BLOCK).collect(), "start", "end"
    )
    limit = 16000 * longest - 512 - 2 * 480
    wanted = {r: sorted(loop_activity(v, 0.5, 960, limit, 3200, 1568)) for r, v in data.items()}
    assert got == {r: w for r, w in wanted.items() if w}


def random_regions(seed, lengths=(1, 6, 50)):
    draw = random.Random(seed)
    out = {}
    for r, n in enumerate(lengths):
        at, regions = 0, []
        for _ in range(n):
            at += draw.randint(1, 8)
            regions.append((at, at + draw.randint(1, 6)))
            at = regions[-1][1]
        out[r] = regions
    return out


def region_frame(spark, data):
    return spark.createDataFrame([(r, i, a, b) for r, v in data.items() for i, (a, b) in enumerate(v)], "recording_id bigint, seq bigint, start bigint, end bigint")


def test_merge_regions(spark):
    data = random_regions(7)
    got = by_recording(op.merge_regions(region_frame(spark, data), 5, 15, rows=BLOCK).collect(), "start", "end")
    for r, regions in data.items():
        out = []
        for a, b in regions:
            if out and a - out[-1][1] < 5 and b - out[-1][0] <= 15:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        assert got[r] == out


def test_packing(spark):
    data = random_regions(8)
    df = region_frame(spark, data)
    by_span = by_recording(op.pack_by_span(df, 20, rows=BLOCK).collect(), "seq", "chunk")
    by_speech = by_recording(op.pack_by_speech(df, 12, rows=BLOCK).collect(), "seq", "chunk")
    for r, regions in data.items():
        head, spans = None, []
        for i, (a, b) in enumerate(regions):
            if head is None or b - regions[head][0] > 20:
                head = i
            spans.append((i, head))
        assert by_span[r] == spans
        head, speech, sums = None, 0, []
        for i, (a, b) in enumerate(regions):
            if head is None or speech + b - a > 12:
                head, speech = i, 0
            speech += b - a
            sums.append((i, head))
        assert by_speech[r] == sums


def test_padding_and_packed_times(spark):
    data = random_regions(9)
    df = region_frame(spark, data)
    got = by_recording(op.pad_regions(df, 2, F.lit(10_000), rows=BLOCK).collect(), "seq", "start", "end")
    for r, regions in data.items():
        out = [list(x) for x in regions]
        out[0][0] = max(0, out[0][0] - 2)
        for i in range(len(regions) - 1):
            gap = regions[i + 1][0] - regions[i][1]
            out[i][1] += gap // 2 if gap < 4 else 2
            out[i + 1][0] -= gap // 2 if gap < 4 else 2
        out[-1][1] = min(10_000, out[-1][1] + 2)
        assert got[r] == [(i, a, b) for i, (a, b) in enumerate(out)]
    words = spark.createDataFrame([(2, i, float(t), t + 1.0) for i, t in enumerate(range(0, 150, 3))], "recording_id bigint, pos int, start double, end double")
    restored = op.restore_times(words, df, 32, rows=BLOCK).collect()
    for row in restored:
        packed, at = 0, int(row.pos * 3 + 0.5)
        for k, (a, b) in enumerate(data[2]):
            if at < packed + b - a or k == len(data[2]) - 1:
                assert row.start == row.pos * 3 + a - packed
                break
            packed += b - a


def test_clamp_and_silent_default(spark):
    pieces = spark.createDataFrame([(1, -50, 900), (1, 1000, 5200)], "recording_id bigint, start_ms bigint, end_ms bigint")
    recordings = spark.createDataFrame([(1, 5000), (2, 70000)], "recording_id bigint, duration_ms bigint")
    got = by_recording(op.clamp_or_default(pieces, recordings).collect(), "start_ms", "end_ms")
    assert got == {1: [(0, 900), (1000, 5000)], 2: [(0, 29000)]}


@pytest.mark.parametrize("first,width", [(0, 1), (1, 4), (5, 5)])
def test_least_ahead(spark, first, width):
    data = scores(7, (1, 9, 40))
    rows = frames(spark, data).withColumn("prob", F.when(F.col("frame") % 11 != 3, F.col("prob")))
    found = least_ahead(rows, ["recording_id"], "frame", "prob", first, width).filter("frame >= 0")
    got = {(r.recording_id, r.frame): (r.least.value, r.least.at) for r in found.collect()}
    wanted = {}
    for r, v in data.items():
        held = [(float("inf") if i % 11 == 3 else p, i) for i, p in enumerate(v)]
        for i in range(len(v) - first - width + 1):
            wanted[r, i] = min(held[i + first : i + first + width])
    assert got == wanted


def test_active_regions(spark):
    data = scores(8, (1, 30, 90))
    got = by_recording(op.active_regions(frames(spark, data), 0.6, 0.4, 2, 1, 1, 5, rows=BLOCK).collect(), "start", "end")
    wanted = {}
    for r, values in data.items():
        merged = []
        for a, b in loop_hysteresis(values, lambda p: p > 0.6, lambda p: p < 0.4):
            a, b = a - 2, min(b + 1, len(values) - 1) + 1
            if merged and a - merged[-1][1] <= 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        wanted[r] = [m for m in merged if m[1] - m[0] >= 5]
    assert got == {r: w for r, w in wanted.items() if w}
    with pytest.raises(ValueError):
        op.active_regions(frames(spark, data), 0.6, pad_onset=1, max_frames=4)


def test_restored_segments(spark):
    """Regions 2-4, 10-13: packed seconds 0-2 and 2-5; recording 1 has no regions."""
    word = "array<struct<word:string,start:double,end:double,probability:double>>"
    rows = [
        (0, 0, 0.0, 9.0, [("a", 0.5, 1.0, 0.5), ("b", 1.5, 2.2, 0.5), ("c", 2.5, 3.004, 0.5)], "x"),
        (0, 1, 1.0, 3.0, [], "y"),
        (0, 2, 4.0, 7.0, None, "z"),
        (1, 0, 1.0, 2.0, [("d", 1.25, 1.5, 0.5)], "u"),
    ]
    segments = spark.createDataFrame(rows, f"recording_id bigint, seq bigint, start double, end double, words {word}, text string")
    regions = spark.createDataFrame([(0, 0, 200, 400), (0, 1, 1000, 1300)], "recording_id bigint, seq bigint, start bigint, end bigint")
    got = op.restore_segments(segments, regions, width=1000, unit=100).orderBy("recording_id", "seq").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(2.5, 11.0, "x"), (3.0, 11.0, "y"), (12.0, 15.0, "z"), (1.25, 1.5, "u")]
    assert [(w.word, w.start, w.end) for w in got[0].words] == [("a", 2.5, 3.0), ("b", 3.5, 4.2), ("c", 10.5, 11.0)]
    assert got[1].words == [] and got[2].words is None
