import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from speechtables.llm import topk

ROWS = "vec_id bigint, embedding array<float>, label int, score string"


def plain(rows, k=5, modulus=50):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in good if i % modulus == 0}:
        own = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own))
        out[q] = [(rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return {q: r for q, r in out.items() if r}


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], ROWS)
    out = {}
    for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_against_all_products(spark):
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(420, 6)) * np.exp(draw.normal(size=(420, 1)))
    vectors[100:160] = vectors[100]
    vectors[200:210] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [1.0, None, 2.0, 0, 0, 0]), (1050, [float("nan")] * 6), (1051, [float("inf")] * 6), (1100, [1.0, 2.0]), (1101, [2.0, 2.0]), (1150, []), (None, [1.0] * 6), (7, [9.0] * 6), (50, [3.0] * 6)]
    expected = plain(rows)
    for options in ({}, {"block_rows": 32, "query_rows": 3}, {"block_rows": 50, "step": 3.0}):
        assert found(spark, rows, **options) == expected


def test_high_thresholds_prune_by_coordinates(spark):
    draw = np.random.default_rng(9)
    centres = np.eye(8)[draw.integers(0, 8, 500)]
    rows = [(i, v.tolist()) for i, v in enumerate(centres + draw.normal(size=(500, 8)) * 0.05)]
    assert found(spark, rows, block_rows=64) == plain(rows)
    block = topk.Block({"ids": np.arange(3).astype("<i8").tobytes(), "norms": np.array([2.0, 1.0, 1.0]).tobytes(), "bounds": b"", "vectors": np.array([[2.0, 0], [0, 1.0], [1.0, 0]]).tobytes()}, "")
    unit = block.vectors / block.norms[:, None]
    query = np.array([1.0, 0.0])
    assert topk.survivors(block, unit, query, 1.0, 1.5).tolist() == [0]
    assert topk.survivors(block, unit, query, 1.0, 2.5) == slice(0, 0)
    assert topk.survivors(block, unit, query, 1.0, 0.9) == slice(0, 3)
    assert topk.survivors(block, unit, query, 1.0, -1.0) == slice(None)


def test_empty_table_and_few_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == {0: [(1, 1, 256 * 512)]}
    assert found(spark, [(0, [1.0])]) == {}


def test_copies_of_blocks_are_not_broadcast(spark, monkeypatch):
    draw = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(900, 6)))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(topk, "_QUERY_BYTES", 1 << 8, raising=False)  # many groups
    monkeypatch.setattr(topk, "_VECTOR_BYTES", 1 << 12, raising=False)
    best = topk.top_k(frame, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=4)
    plan = best._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in best.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    for q, own in good[::50]:
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)
        assert found[q] == [(rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    # a broadcast passes through the driver: no copies of blocks are below one
    indent = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.split("\n")
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            inside = itertools.takewhile(lambda x: indent(x) > indent(line), lines[at + 1 :])
            assert not any("Generate" in x for x in inside)
