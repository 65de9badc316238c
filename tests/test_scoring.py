"""Alignment against the textbook table, and the report tables built on it."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from speechtables.functions import alignment
from speechtables.functions.alignment import edit_path
from speechtables.operators import scoring as op
from speechtables.sources import documents as doc


def textbook(ref, hyp):
    """The whole table, then back from its corner: match or substitution, else deletion, else insertion."""
    table = [[i + j if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            turn = table[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1])
            table[i][j] = min(turn, table[i - 1][j] + 1, table[i][j - 1] + 1)
    i, j, path = len(ref), len(hyp), []
    while i or j:
        ways = []
        if i and j:
            ways.append((table[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), 0, (i, j)))
        if i:
            ways.append((table[i - 1][j] + 1, 1, (i, 0)))
        if j:
            ways.append((table[i][j - 1] + 1, 2, (0, j)))
        step = min(ways)[2]
        path.append(step)
        i, j = i - bool(step[0]), j - bool(step[1])
    return path[::-1]


def check(ref, hyp):
    assert [(step >> 32, step & 0xFFFFFFFF) for step in edit_path(ref, hyp).tolist()] == textbook(ref, hyp)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_path_is_the_textbook_one(ref, hyp):
    check(ref, hyp)


def test_long_paths():
    draw = random.Random(1)
    for n in (70, 200, 333):
        check([draw.choice("abcdefgh") for _ in range(n)], [draw.choice("abcdefgh") for _ in range(draw.randint(1, 2 * n))])


def test_texts_worked_out_together_take_their_own_paths(monkeypatch):
    draw = random.Random(2)
    texts = [[draw.randrange(9) for _ in range(draw.choice((0, 1, 7, 8, 9, 40, 150)))] for _ in range(240)]
    refs, hyps = texts[:120], texts[120:]
    hyps[:60] = [[word for word in ref if draw.random() > 0.2] for ref in refs[:60]]
    for lane, kept in ((1 << 11, 1 << 25), (48, 1 << 10)):
        monkeypatch.setattr(alignment, "LANE_BYTES", lane)
        monkeypatch.setattr(alignment, "KEPT_BYTES", kept)
        for ref, hyp, path in zip(refs, hyps, alignment.edit_paths(refs, hyps)):
            assert path.tolist() == edit_path(ref, hyp).tolist()


def test_lines_of_whole_utterances_are_not_gathered(spark):
    whole = op.utterance_details(op.align_words(pairs(spark), whole=True))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, op.utterance_details(op.align_words(pairs(spark))).collect()))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Aggregate" not in plan and "Window" not in plan


def pairs(spark):
    rows = [(1, "a b c d".split(), "a x c d e".split()), (2, "a a".split(), []), (3, [], ["z"]), (4, ["q"], ["q"])]
    return spark.createDataFrame(rows, "utt_id bigint, ref array<string>, hyp array<string>")


def test_reports(spark):
    steps = op.align_words(pairs(spark))
    total = op.error_summary(steps).first().asDict()
    assert total == {"ins": 2, "del": 2, "sub": 1, "corr": 4, "ref_len": 7, "errors": 5, "wer": 500 / 7}
    assert [tuple(r) for r in op.substitutions(steps).collect()] == [("b", "x", 1)]
    assert [tuple(r) for r in op.deletions(steps).collect()] == [("a", 2)]
    assert [tuple(r) for r in op.insertions(steps).collect()] == [("z", 1), ("e", 1)]
    stats = {r.word: (r.corr, r.errors, r.in_ref, r.in_hyp) for r in op.word_stats(steps).collect()}
    assert stats["a"] == (1, 2, 3, 1) and stats["b"] == (0, 1, 1, 0) and stats["x"] == (0, 1, 0, 1) and stats["q"] == (1, 0, 1, 1)
    details = {r.utt_id: r.detail for r in op.utterance_details(steps).collect()}
    assert details == {1: "a (b->x) c d (*->e)", 2: "(a a->*)", 3: "(*->z)", 4: "q"}


def test_report_files(spark, tmp_path):
    sections = doc.error_report(pairs(spark))
    doc.write_report(sections, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/deletions.parquet").count() == 1
    assert spark.read.parquet(f"{tmp_path}/summary.parquet").first()["errors"] == 5


def test_a_quiet_recording_without_agreement_is_silence(spark):
    from speechtables.operators import selection

    tops = spark.createDataFrame([(0, 0, "en", 0.9), (0, 1, "en", 0.8), (1, 0, "en", 0.9), (1, 1, "de", 0.4), (2, 0, "fr", 0.5)], "recording_id bigint, seg bigint, language string, prob double")
    levels = spark.createDataFrame([(0, 0.001, 0.5), (1, 0.5, 0.001), (2, 0.5, 0.5), (3, 0.5, 0.5)], "recording_id bigint, peak double, rms double")
    got = {r.recording_id: (r.language, round(r.confidence, 6)) for r in selection.vote_or_silence(tops, levels, confident=0.7).collect()}
    assert got == {0: ("en", 0.85), 1: ("silence", 1.0), 2: ("fr", 0.5), 3: ("silence", 1.0)}
