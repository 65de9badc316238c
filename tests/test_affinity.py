"""Affinity graphs and clustering against dense matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechtables.operators import affinity as op
from speechtables.plans.tiles import NORM_EPS
from speechtables.session import cut_lineage


def blobs(seed, sizes, dim=16, noise=0.15):
    draw = np.random.default_rng(seed)
    centres = np.eye(dim)[: len(sizes)]
    labels = np.concatenate([[k] * n for k, n in enumerate(sizes)])
    draw.shuffle(labels)
    return centres[labels] + noise * draw.standard_normal((len(labels), dim)), labels


def table(spark, data):
    rows = [(r, i, [float(x) for x in v]) for r, vectors in data.items() for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "recording_id bigint, seg_idx bigint, vec array<float>")


def dense(vectors):
    v = np.float32(vectors).astype(float)
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + NORM_EPS)
    s = u @ u.T
    np.fill_diagonal(s, 1.0)
    return s


def test_edges_range_and_rows(spark):
    data = {0: blobs(1, [20, 15, 9])[0], 1: blobs(2, [3, 2])[0]}
    rows = op.single_scale(table(spark, data))
    edges = op.neighbour_edges(rows, 4, tile=8).toPandas()
    ranges = op.affinity_range(rows, tile=8).toPandas().set_index("recording_id")
    summary = op.row_summary(rows, tile=8).toPandas()
    for r, vectors in data.items():
        s = dense(vectors)
        best = np.argsort(-s, axis=1, kind="stable")[:, :4]
        got = edges[edges.recording_id == r].sort_values(["i", "rank"]).j.to_numpy().reshape(-1, 4)
        assert (got == best).all()
        assert np.allclose([ranges.lo[r], ranges.hi[r]], [s.min(), s.max()])
        part = summary[summary.recording_id == r].sort_values("i")
        off = np.where(np.eye(len(s), dtype=bool), -np.inf, s)
        assert (part.nearest.to_numpy() == off.argmax(1)).all() and np.allclose(part.total, s.sum(1))
        assert (part.farthest.to_numpy() == np.where(np.isinf(off), np.inf, s).argmin(1)).all()


def test_graph_tables(spark):
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 3, 3, 1.0), (1, 5, 4, 1.0), (1, 4, 6, 1.0)], "recording_id bigint, i bigint, j bigint, weight double")
    roots = {(x.recording_id, x.node): x.root for x in op.components(edges).collect()}
    assert roots == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 3): 3, (1, 4): 4, (1, 5): 4, (1, 6): 4}
    assert {x.recording_id: x.connected for x in op.connected(edges).collect()} == {0: False, 1: True}
    values = {(x.recording_id, x.i, x.j): x.value for x in op.laplacian(op.symmetrise(edges)).collect()}
    assert values[0, 0, 0] == 0.5 and values[0, 1, 1] == 1.0 and values[0, 0, 1] == -0.5 and values[0, 3, 3] == 0.0


def test_components_of_a_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(n)], "recording_id bigint, i bigint, j bigint, weight double")
    assert {x.root for x in op.components(edges).collect()} == {0}


def agree(labels, truth):
    """Same partition up to the names of the labels."""
    return len(set(zip(labels, truth))) == len(set(truth)) == len(set(labels))


def test_clusters_match_the_speakers(spark):
    data, truth = {}, {}
    for r, sizes in enumerate([[60, 50], [45, 40, 35], [1]]):
        data[r], truth[r] = blobs(r + 10, sizes)
    rows = op.single_scale(table(spark, data))
    counts = op.neighbour_search(rows)
    found = {x.recording_id: x.speakers for x in counts.collect()}
    assert (found[0], found[1]) == (2, 3)
    labels = op.cluster_speakers(rows, counts).toPandas()
    for r in data:
        part = labels[labels.recording_id == r].sort_values("i")
        assert len(part) == len(truth[r]) and agree(part.label, truth[r])
    # a search over every k-th window only, and a known number of speakers
    some = op.cluster_speakers(rows, op.neighbour_search(rows, search_rows=64)).toPandas()
    known = op.cluster_speakers(rows.filter("recording_id = 0"), op.neighbour_search(rows, known=2)).toPandas()
    for labelled, recordings in ((some, (0, 1)), (known, (0,))):
        for r in recordings:
            part = labelled[labelled.recording_id == r].sort_values("i")
            assert len(part) == len(truth[r]) and agree(part.label, truth[r])


def test_connection_rank_is_the_least_connecting_number(spark):
    draw = np.random.default_rng(7)
    data = {0: blobs(1, [30, 25])[0], 1: draw.standard_normal((40, 16)), 2: blobs(3, [9, 8, 30], noise=0.02)[0], 3: draw.standard_normal((1, 16)), 4: draw.standard_normal((2, 16))}
    wanted, few = {}, {}
    edges = []
    for r, vectors in data.items():
        s = dense(vectors)
        wanted[r] = next(p for p in range(1, len(s) + 1) if op.is_connected(op.neighbour_graph(s, p)))
        few[r] = wanted[r] if wanted[r] <= 3 else None
        best = np.argsort(-s, axis=1, kind="stable")
        edges += [(r, i, int(j), k + 1) for i, row in enumerate(best) for k, j in enumerate(row)]
    assert wanted[2] > 8 and wanted[3] == 1
    table = cut_lineage(spark.createDataFrame(edges, "recording_id bigint, i bigint, j bigint, rank int").coalesce(2))
    assert {x.recording_id: x.connects for x in op.connection_rank(table).collect()} == wanted
    assert {x.recording_id: x.connects for x in op.connection_rank(table.filter("rank <= 3")).collect()} == few


def test_smallest_vectors_span_those_of_the_dense_matrix():
    draw = np.random.default_rng(5)
    dense = draw.random((60, 60)) * (draw.random((60, 60)) < 0.2)
    dense = (dense + dense.T) / 2
    i, j = np.nonzero(dense)
    found = op.smallest_vectors(i, j, dense[i, j], 60, 3)
    values, vectors = op.spectrum(dense, vectors=True)
    assert values[3] - values[2] > 1e-6
    assert np.allclose(np.linalg.svd(found.T @ vectors[:, :3])[1], 1, atol=1e-3)


def test_chains_of_jumps_take_few_rounds(spark, monkeypatch):
    from speechtables.plans import jumps

    rounds = []
    plain = jumps.cut_lineage
    monkeypatch.setattr(jumps, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    n = 200
    rows = [(0, i, i + 1 if i + 1 < n else None) for i in range(n)] + [(1, i, i + 3 if i + 3 < n else None) for i in range(n)]
    frame = spark.createDataFrame(rows, "recording_id bigint, seq bigint, nxt bigint")
    got = {(r.recording_id, r.seq) for r in jumps.visited(frame, ["recording_id"], "seq", "nxt").collect()}
    assert got == {(0, i) for i in range(n)} | {(1, i) for i in range(0, n, 3)}
    assert len(rounds) <= 2 + 3 * (n.bit_length() + 1)


def test_short_counts(spark):
    data = {0: blobs(21, [12, 12], noise=0.02)[0], 1: np.random.default_rng(1).standard_normal((120, 16))}
    counts = {x.recording_id: x.speakers for x in op.count_speakers_short(table(spark, data)).collect()}
    assert set(counts) == {0} and counts[0] >= 1


@pytest.mark.parametrize("whole, wanted", [([False, False, True, True], 4), ([True, True, True, True], 1)])
def test_search_pick_lags_one_step(whole, wanted):
    ratios = [0.1, 0.2, 0.3, 0.4] if not whole[0] else [0.1, 0.5, 0.5, 0.5]
    t = pd.DataFrame({"p": [1, 2, 3, 4], "ratio": ratios, "speakers": [1, 2, 3, 4], "connected": whole, "connected_at_one": whole[0]})
    assert op.search_pick(t, 4) == (wanted, wanted)


def test_label_mismatch_is_reported(spark):
    windows = spark.createDataFrame([(0, 0, 0, 500), (0, 1, 250, 500)], "recording_id bigint, i bigint, offset int, duration int")
    labels = spark.createDataFrame([(0, 0, 3)], "recording_id bigint, i bigint, label int")
    rows = {x.seq: x for x in op.labels_to_turns(windows, labels).collect()}
    assert rows[0].error is None and rows[0].speaker == 3 and rows[1].error


def test_scorer_must_answer_every_window(spark):
    df = spark.range(5).select(F.col("id").alias("seg_idx"))
    assert op.score_batches(df, lambda b: b.assign(score=1.0), "seg_idx bigint, score double").count() == 5
    with pytest.raises(Exception, match="Mismatch of counts"):
        op.score_batches(df, lambda b: b.assign(score=1.0).iloc[1:], "seg_idx bigint, score double").count()


def test_best_columns_are_those_of_a_stable_sort():
    from speechtables.plans.tiles import best_columns

    draw = np.random.default_rng(4)
    for block in (draw.standard_normal((9, 70)), draw.integers(0, 5, (9, 70)).astype(float)):
        for p in (1, 4, 69, 70):
            assert (best_columns(block, p) == np.argsort(-block, axis=1, kind="stable")[:, :p]).all()


def test_tiles_are_copied_once_for_every_wide_tile(spark):
    from speechtables.plans.tiles import WIDER, tile_pairs

    rows = cut_lineage(op.single_scale(table(spark, {0: blobs(1, [200, 150])[0], 1: blobs(2, [3])[0]})))
    pairs = tile_pairs(rows, ["recording_id"], tile=4).groupBy("recording_id", "__wide").count().collect()
    left, right = -(-350 // 4), -(-350 // (4 * WIDER))
    assert {(r.recording_id, r["__wide"]): r["count"] for r in pairs} == {(0, False): left * right, (0, True): right, (1, False): 1, (1, True): 1}
    edges = op.neighbour_edges(rows, 5, tile=4).toPandas()
    s = dense(blobs(1, [200, 150])[0])
    got = edges[edges.recording_id == 0].sort_values(["i", "rank"]).j.to_numpy().reshape(-1, 5)
    assert (got == np.argsort(-s, axis=1, kind="stable")[:, :5]).all()
