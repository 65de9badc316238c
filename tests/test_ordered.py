"""Block computations against plain loops, with blocks of a few rows and one recording that is most of the data."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechtables.operators import turns as turn_op
from speechtables.operators.utterances import reconstruct
from speechtables.plans.asof import next_mark
from speechtables.plans.carry import fold
from speechtables.plans.ordered import neighbours, row_block, scan, with_ordinal

BLOCK = 4


def recordings(seed, lengths=(1, 3, 4, 9, 40)):
    draw = random.Random(seed)
    return {r: [draw.randint(0, 9) for _ in range(n)] for r, n in enumerate(lengths)}


@pytest.fixture(scope="module")
def numbers(spark):
    data = recordings(1)
    rows = [(r, i, v) for r, values in data.items() for i, v in enumerate(values)]
    random.Random(2).shuffle(rows)
    return data, spark.createDataFrame(rows, "recording_id bigint, seq bigint, v int")


def test_scan_kinds(spark, numbers):
    data, df = numbers
    big = F.when(F.col("v") > 6, F.col("v"))
    out = scan(
        df,
        ["recording_id"],
        ["seq"],
        row_block("seq", BLOCK),
        total={"t": F.col("v")},
        latest={"l": big},
        upcoming={"u": big},
        peak={"p": F.col("v")},
        prev={"b": F.col("v")},
        next={"n": F.col("v")},
        overall={"all": ("sum", F.col("v")), "most": ("max", F.col("v"))},
    )
    got = {(r.recording_id, r.seq): r for r in out.collect()}
    assert len(got) == sum(map(len, data.values()))
    for r, values in data.items():
        for i, v in enumerate(values):
            row = got[r, i]
            before, after = values[:i], values[i + 1 :]
            assert row.t == sum(values[: i + 1])
            assert row.l == next((x for x in reversed(values[: i + 1]) if x > 6), None)
            assert row.u == next((x for x in values[i:] if x > 6), None)
            assert row.p == (max(before) if before else None)
            assert row.b == (before[-1] if before else None)
            assert row.n == (after[0] if after else None)
            assert (row.all, row.most) == (sum(values), max(values))


def test_neighbours(spark, numbers):
    data, df = numbers
    out = neighbours(df, ["recording_id"], "seq", prev={"b": F.col("v")}, next={"n": F.col("v")}, rows=BLOCK)
    got = {(r.recording_id, r.seq): (r.b, r.n) for r in out.collect()}
    assert len(got) == sum(map(len, data.values()))
    for r, values in data.items():
        for i in range(len(values)):
            wanted = (values[i - 1] if i else None, values[i + 1] if i + 1 < len(values) else None)
            assert got[r, i] == wanted


def test_ordinals(spark, numbers):
    data, df = numbers
    out = with_ordinal(df, ["recording_id"], ["v", "seq"], F.expr("v div 3"), name="at")
    for r, values in data.items():
        wanted = {i: at for at, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
        assert {x.seq: x.at for x in out.filter(F.col("recording_id") == r).collect()} == wanted


def test_fold_carries_state_over_many_blocks(spark, numbers):
    data, df = numbers

    def step(rows, state, last):
        held = json.loads(state) if state else 0
        out = []
        for seq, v in zip(rows["seq"], rows["v"]):
            held = 0 if v == 0 else (held * 3 + int(v)) % 1001
            out.append((seq, held, last))
        return pd.DataFrame(out, columns=["seq", "held", "last"]), json.dumps(held)

    out = fold(df, ["recording_id"], ["seq"], row_block("seq", BLOCK), step, "seq bigint, held bigint, last boolean")
    got = {(r.recording_id, r.seq): (r.held, r["last"]) for r in out.collect()}
    for r, values in data.items():
        held = 0
        for i, v in enumerate(values):
            held = 0 if v == 0 else (held * 3 + v) % 1001
            assert got[r, i] == (held, i // BLOCK == (len(values) - 1) // BLOCK)


@pytest.mark.parametrize("strict", [False, True])
def test_next_mark(spark, strict):
    draw = random.Random(5)
    marks = {r: sorted(draw.sample(range(200), 9)) for r in range(3)}
    points = {r: [draw.randint(-5, 220) for _ in range(50)] for r in range(3)}
    m = spark.createDataFrame([(r, i, a) for r, v in marks.items() for i, a in enumerate(v)], "recording_id bigint, seq bigint, at bigint")
    p = spark.createDataFrame([(r, i, t) for r, v in points.items() for i, t in enumerate(v)], "recording_id bigint, i bigint, t bigint")
    got = next_mark(p, "t", m, "at", ["recording_id"], ["seq"], 16, strict=strict).select("recording_id", "t", "mark.seq").collect()
    assert len(got) == 150
    for row in got:
        fits = [i for i, a in enumerate(marks[row.recording_id]) if (a > row.t if strict else a >= row.t)]
        assert row.seq == (fits[0] if fits else len(marks[row.recording_id]) - 1)


def loop_turns(turns):
    """Overlaps to the middle, then touching turns of a speaker together."""
    turns = [list(t) for t in turns]
    for a, b in zip(turns, turns[1:]):
        if a[1] > b[0]:
            a[1] = b[0] = (a[1] + b[0]) / 2
    out = []
    for turn in turns:
        if out and out[-1][1] == turn[0] and out[-1][2] == turn[2]:
            out[-1][1] = turn[1]
        else:
            out.append(turn)
    return [tuple(t) for t in out]


def random_turns(draw, n):
    start, turns = 0, []
    for _ in range(n):
        start += draw.randint(1, 6)
        turns.append((float(start), float(start + draw.randint(1, 8)), draw.randint(0, 1)))
    return turns


def test_turn_cleanup(spark):
    draw = random.Random(3)
    data = {r: random_turns(draw, n) for r, n in enumerate([1, 2, 5, 60])}
    df = spark.createDataFrame(
        [(r, i, *turn) for r, turns in data.items() for i, turn in enumerate(turns)],
        "recording_id bigint, seq bigint, start double, end double, speaker int",
    )
    merged = turn_op.merge_same_speaker(turn_op.resolve_overlaps(df, rows=BLOCK), rows=BLOCK).collect()
    for r, turns in data.items():
        got = [(x.start, x.end, x.speaker) for x in sorted((x for x in merged if x.recording_id == r), key=lambda x: x.seq)]
        assert got == loop_turns(turns)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_reconstruction_keeps_every_word(spark):
    draw = random.Random(4)
    rows = [(0, i, i * 10, i * 10 + 9, draw.choice([0, 0, 1, None]), f"w{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "recording_id bigint, seq bigint, start bigint, end bigint, speaker int, text string")
    got = sorted(reconstruct(df, rows=BLOCK).collect(), key=lambda x: x.seq)
    wanted = []
    for _, seq, start, end, speaker, text in rows:
        if wanted and wanted[-1][2] == speaker:
            wanted[-1][1], wanted[-1][3] = end, wanted[-1][3] + text + " "
        else:
            wanted.append([start, end, speaker, text + " "])
    assert [[x.start, x.end, x.speaker, x.text] for x in got] == wanted


def test_copies_of_a_lookup_are_planned_at_their_size(spark):
    from speechtables.plans.skew import spread_lookup

    rows = spark.range(3_000_000).select((F.col("id") % 40_000).alias("key"), "id")
    lookup = spark.range(40_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    found = spread_lookup(rows, lookup, ["key"], F.col("id"))
    planned = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in planned and "BroadcastHashJoin" not in planned  # 64 copies of each row, 60 MB in all
    small = spread_lookup(rows.filter("id < 100000"), lookup, ["key"], F.col("id"), fanout=4)
    assert small.count() == 100_000 and small.filter("twice <> key * 2").isEmpty()
