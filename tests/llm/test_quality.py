import numpy as np
import pytest

from speechtables.llm import quality
from speechtables.llm.common import read_table
from tests.llm.helpers import documents, odd_texts

LABELS = "doc_id bigint, quality int, toxic int"


def test_linear_time_equals_all_pairs():
    draw = np.random.default_rng(1)
    machine = quality.Machine(0.3, draw.normal(size=50), draw.normal(size=(50, 4)))
    index, value = np.array([3, 7, 19, 40]), np.array([0.5, -1.0, 2.0, 0.25])
    pairs = sum(
        machine.factors[index[i]] @ machine.factors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i)
    )
    assert machine.raw(index, value) == pytest.approx(0.3 + machine.linear[index] @ value + pairs)


def test_held_out_accuracy(spark):
    documents_, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    scored = quality.quality_scores(documents_, labels)
    assert scored.count() == documents_.count()
    held = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(held) > 40
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_odd_texts_nulls_and_equal_rows(spark):
    texts = odd_texts() * 2
    frame = documents(spark, texts, "score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(len(texts))] + [(None, 1, 0), (4, None, 0), (999, 1, 1)], LABELS)
    rows = {r["doc_id"]: r for r in quality.quality_scores(frame, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows.values())
    half = len(texts) // 2
    assert all(rows[i]["score"] == rows[i + half]["score"] for i in range(half))
    assert rows[0]["score"] == rows[1]["score"]
    kept = quality.accepted(frame, labels)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["score"] >= quality.THRESHOLD}


def test_one_class_no_labels_empty_table(spark):
    frame = documents(spark, ["a b", None], ids=[1, None])
    one = spark.createDataFrame([(1, 1, 0)], LABELS)
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in quality.quality_scores(frame, one).collect()] == [0.999999] * 2
    assert [r["score"] for r in quality.quality_scores(frame, none).collect()] == [0.5] * 2
    assert quality.quality_scores(documents(spark, []), one).count() == 0


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    from zlib import crc32

    ids = [i for i in range(200) if crc32(str(i).encode()) % 5 == 0]
    frame = documents(spark, [f"text {i}" for i in range(200)])
    flipped = [spark.createDataFrame([(i, int(i % 2 == v) if i in ids else int(i % 7 > 2), 0) for i in range(200)], LABELS) for v in (0, 1)]
    first, second = ({r["doc_id"]: r["score"] for r in quality.quality_scores(frame, x).collect()} for x in flipped)
    assert first == second


def test_shape_covers_the_whole_word():
    features = quality.Features()
    head = b"Ab1-" * 20
    for tail in (b"", b"xyz" * 200, b"a" * 10**6):
        plain, last = bytearray(), None
        for c in (head + tail).translate(quality._SHAPE):
            if c != last:
                plain.append(c)
            last = c
        assert features._buckets(head + tail)[1] == quality.WORDS + quality.crc32(bytes(plain)) % quality.WORDS
    assert features._buckets(head + b"x1" * 40)[1] != features._buckets(head + b"X-" * 40)[1]
