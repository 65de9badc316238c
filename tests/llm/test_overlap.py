import random

import pytest

import corpus_pipeline
from speechtables.llm import overlap
from tests.llm.helpers import documents, least_reachable, odd_texts, prose


def plain_set(text: str | None, words: int = 5) -> set:
    tokens = (text or "").encode().lower().split()
    runs = [tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1)]
    return set(runs or ([tuple(tokens)] if tokens else []))


def linked(a: set, b: set) -> bool:
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def edited(draw: random.Random, text: str, times: int) -> str:
    tokens = text.split()
    for _ in range(times):
        tokens[draw.randrange(len(tokens))] = f"n{draw.randrange(10**6)}"
    return " ".join(tokens)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(8)
    out = [*odd_texts(), "naïve café", "NAïVE  CAFé"]
    for _ in range(40):
        base = prose(draw, draw.randrange(60, 300))
        out += [base, *(edited(draw, base, max(1, int(len(base.split()) * share))) for share in (0.005, 0.01, 0.02, 0.03))]
    base = prose(draw, 120)  # copies that meet each other mostly through one text
    return out + [base, *(edited(draw, base, 2) for _ in range(60))]


@pytest.mark.parametrize("tile", [1024, 8])
def test_classes_equal_brute_force_jaccard(spark, texts, tile):
    sets = [plain_set(t) for t in texts]
    expected = least_reachable(len(texts), lambda i, j: linked(sets[i], sets[j]))
    frame = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    root = {r["row"]: r["root"] for r in overlap.overlap_classes(frame, tile_members=tile).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(root[i], i)
    assert [first[root[i]] for i in range(len(texts))] == expected


def test_stage_keeps_one_of_each_class(spark, texts):
    sets = [plain_set(t) for t in texts]
    expected = least_reachable(len(texts), lambda i, j: linked(sets[i], sets[j]))
    kept = corpus_pipeline.keep_one_of_each(spark, documents(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, e in enumerate(expected) if e == i]


def test_shared_keys_at_the_threshold():
    """Sets of similarity 0.8 to 0.82 share a key; 1 - 5e-8 is what the bands promise."""
    draw = random.Random(1)
    missed = 0
    for _ in range(2000):
        common = [draw.getrandbits(64) for _ in range(160)]
        pair = [overlap.np.unique(overlap.np.array(common + [draw.getrandbits(64) for _ in range(19)], "u8")) for _ in "ab"]
        missed += not set(overlap.band_keys(pair[0])) & set(overlap.band_keys(pair[1]))
    assert missed == 0


def test_no_rows(spark):
    assert overlap.overlap_classes(spark.createDataFrame([], "row bigint, text string")).count() == 0


def test_stage_decides_by_row(spark):
    """Repeated rows, ids with two texts and rows without an id: the first row of each class stays."""
    draw = random.Random(6)
    a, b, c, d = (prose(draw, 50) for _ in range(4))
    texts = [a, a, b, b, c, d, d, d, c + " end"]
    ids = [1, 1, 2, 3, 3, None, None, 9, None]
    frame = documents(spark, texts, ids=ids)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, frame, "").collect()]
    assert sorted(kept) == sorted([(1, a), (2, b), (3, c), (9, d)])
    nameless = documents(spark, [a, a, b], ids=[None] * 3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, nameless, "").collect()]
    assert len(kept) == 2 and {t for _, t in kept} == {a, b}


def test_repeats_keep_rows_that_lost_nothing(spark):
    """A blank row stays as it is; a row that the cut leaves blank goes."""
    text = prose(random.Random(9), 40)
    frame = documents(spark, [None, "", " \t ", text, text, text + " tail"])
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, frame, "").collect()}
    assert kept.keys() == {0, 1, 2, 3, 5} and not (kept[0] or kept[1]) and kept[2] == " \t " and kept[3] == text
