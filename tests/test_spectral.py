"""Eigenvalues and clusters found on tables against dense matrices."""

import numpy as np
import pytest

from speechtables.operators import affinity as op
from speechtables.plans.spectral import cluster_points, least_eigenpairs
from tests.test_affinity import agree, blobs, table


def graphs():
    draw = np.random.default_rng(3)
    parts = np.zeros((60, 60))
    for a, b in ((0, 20), (20, 45), (45, 60)):
        parts[a:b, a:b] = draw.random((b - a, b - a)) < 0.4
    near = np.argsort(-draw.random((120, 120)), axis=1)[:, :7]
    ring = np.zeros((120, 120))
    np.put_along_axis(ring, near, 1.0, axis=1)
    few = draw.random((3, 3))
    lone = np.zeros((1, 1))
    return [(g + g.T) / 2 for g in (parts, ring, few, lone)]


def edges_of(spark, dense):
    rows = []
    for r, g in enumerate(dense):
        linked = (g != 0) | np.eye(len(g), dtype=bool)
        rows += [(r, int(i), int(j), float(g[i, j])) for i, j in zip(*np.nonzero(linked))]
    return spark.createDataFrame(rows, "recording_id bigint, i bigint, j bigint, weight double").repartition(4)


def test_least_eigenpairs_are_those_of_the_dense_matrix(spark):
    dense = graphs()
    values, vectors = least_eigenpairs(edges_of(spark, dense), 4, ["recording_id"], upper=2, node_rows=32)
    found = {r.recording_id: r for r in values.collect()}
    points = vectors.toPandas()
    for r, g in enumerate(dense):
        want, across = op.spectrum(g, vectors=True)
        k = min(4, len(g))
        assert np.allclose(found[r]["values"][:k], want[:k], atol=1e-6 * max(want.max(), 1))
        assert found[r].largest == pytest.approx(want.max(), rel=1e-6, abs=1e-8)
        part = points[points.recording_id == r].sort_values("i")
        assert list(part.i) == list(range(len(g)))
        if len(g) > 4 and want[4] - want[3] > 1e-3:
            got = np.stack(part.point.to_numpy())
            assert np.allclose(np.linalg.svd(got.T @ across[:, :4])[1], 1, atol=1e-4)


def test_points_fall_into_the_clusters_of_the_plain_loop(spark):
    draw = np.random.default_rng(8)
    rows, counts, wanted = [], [], {}
    for r, k in enumerate((3, 2, 1)):
        points = np.concatenate([draw.normal(5 * c, 0.3, (20 + 7 * c, 3)) for c in range(k)])
        used = points[:, :k]
        wanted[r] = op.nearest_centres(used, k)
        rows += [(r, i, [float(x) for x in p]) for i, p in enumerate(points)]
        counts.append((r, k))
    points = spark.createDataFrame(rows, "recording_id bigint, i bigint, point array<double>")
    found = cluster_points(points, spark.createDataFrame(counts, "recording_id bigint, k int"), 3, ["recording_id"]).toPandas()
    for r, labels in wanted.items():
        part = found[found.recording_id == r].sort_values("i")
        assert list(part.label) == labels.tolist()


def test_tables_and_tasks_give_the_same_speakers(spark):
    data, truth = {}, {}
    for r, sizes in enumerate([[14, 12], [10, 9, 11]]):
        data[r], truth[r] = blobs(r + 10, sizes)
    rows = op.single_scale(table(spark, data))
    in_tasks = {r.recording_id: r.asDict() for r in op.neighbour_search(rows).collect()}
    counts = op.neighbour_search(rows, task_rows=0)
    assert {r.recording_id: r.asDict() for r in counts.collect()} == in_tasks
    labels = op.cluster_speakers(rows, counts, task_edges=0).toPandas()
    for r in data:
        part = labels[labels.recording_id == r].sort_values("i")
        assert len(part) == len(truth[r]) and agree(part.label, truth[r])


def test_graphs_of_bits_are_those_of_the_dense_matrix(spark, monkeypatch):
    import pandas as pd

    from speechtables.plans import bitgraph
    from speechtables.plans.spectral import least_eigenvalues

    monkeypatch.setattr(bitgraph, "BLOCK_CELLS", 1 << 11)  # blocks of a few rows
    monkeypatch.setattr(bitgraph, "PRODUCT_CELLS", 1 << 10)
    vectors = np.vstack([blobs(4, [37, 30, 16])[0], blobs(4, [9])[0][:4], blobs(4, [9])[0][:4]])  # with equal rows
    vectors = np.round(vectors * 16) / 16  # products are exact, so equal ones stay equal in any block
    n = len(vectors)
    part = pd.DataFrame({"vectors": [[v] for v in vectors], "owners": [[i] for i in range(n)], "lo": None, "hi": None})
    affinity = op.fused_affinity(part, (1.0,))
    for p in (1, 2, 3, 9, 40, n):
        graph, wanted = bitgraph.BitGraph(part, (1.0,), p), op.neighbour_graph(affinity, p)
        values = op.spectrum(wanted)
        off = wanted - np.diag(np.diag(wanted))
        assert np.allclose(graph.times(np.eye(n)), np.diag(off.sum(1)) - off)
        assert graph.connected() == op.is_connected(wanted)
        assert graph.connected_by_nearest() == op.is_connected(op.neighbour_graph(affinity, 1))
        least, largest = least_eigenvalues(graph.times, graph.degree, 5)
        assert np.allclose(least, values[:5], atol=1e-6 * values.max()) and largest == pytest.approx(values.max(), rel=1e-6)


def test_recordings_beyond_a_dense_matrix_stay_in_tasks(spark, monkeypatch):
    data = {r: blobs(r + 10, sizes)[0] for r, sizes in enumerate([[14, 12], [10, 9, 11]])}
    rows = op.single_scale(table(spark, data))
    wanted = {r.recording_id: r.asDict() for r in op.neighbour_search(rows).collect()}
    for name in ("_table_search", "least_eigenpairs"):
        monkeypatch.setattr(op, name, None)  # tables are for recordings beyond the bits
    counts = op.neighbour_search(rows, task_rows=8)
    assert {r.recording_id: r.asDict() for r in counts.collect()} == wanted
    assert op.cluster_speakers(rows, counts).count() == sum(map(len, data.values()))


def as_part(vectors):
    import pandas as pd

    return pd.DataFrame({"vectors": [[v] for v in vectors], "owners": [[i] for i in range(len(vectors))], "lo": None, "hi": None})


def test_search_solves_what_the_choice_takes(monkeypatch):
    import pandas as pd

    from speechtables.plans import bitgraph

    monkeypatch.setattr(bitgraph, "BLOCK_CELLS", 1 << 12)
    monkeypatch.setattr(bitgraph, "LISTED_ROWS", 8)  # some graphs by lists, some by bits
    draw = np.random.default_rng(6)
    ring = np.c_[np.cos(np.arange(90) * 2 * np.pi / 90 + draw.uniform(0, 0.02, 90)), np.sin(np.arange(90) * 2 * np.pi / 90)]
    made = [blobs(1, [70, 60, 50])[0], blobs(2, [100, 60], noise=0.03)[0], draw.standard_normal((150, 16)), ring, draw.standard_normal((9, 4)), blobs(3, [60, 50], noise=0.25)[0]]
    made.append(np.round(np.repeat(made[0][:60], 3, axis=0) * 16) / 16)  # equal rows
    solved, problems, walks = [], 0, set()
    plain = op.least_eigenvalues

    def counted(*a, **kw):
        found = plain(*a, **kw)
        solved.append(found is not None)
        return found

    monkeypatch.setattr(op, "least_eigenvalues", counted)
    for vectors in made:
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        part, n = as_part(vectors), len(vectors)
        steps = np.unique(op.search_list(n, 0.25, 30))
        affinity = op.fused_affinity(part, (1.0,))
        rows = [(int(p), *op.eigen_gap(affinity, int(p), 8), *(op.is_connected(op.neighbour_graph(affinity, q)) for q in (int(p), 1))) for p in steps]
        wanted = pd.DataFrame(rows, columns=["p", "ratio", "speakers", "connected", "connected_at_one"])
        assert op.bit_search(part, (1.0,), steps, 8) == op.search_pick(wanted, max(int(n * 0.25), 2))
        walks.add(bool(wanted["connected"].iloc[wanted["ratio"].argmin()]))
        problems += len(steps)
        for p, degree in zip(steps, bitgraph.degrees(part, (1.0,), [int(p) for p in steps])):
            graph = bitgraph.BitGraph(part, (1.0,), int(p))
            off = op.neighbour_graph(affinity, int(p)) * (1 - np.eye(n))
            assert np.allclose(graph.degree, degree) and (graph.out is None) == (p * 8 > n)
            assert np.allclose(graph.times(np.eye(n)), np.diag(off.sum(1)) - off)
    assert walks == {True, False}
    assert sum(solved) < 0.75 * problems  # far fewer in larger recordings, where bounds are closer
