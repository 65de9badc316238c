import math

import numpy as np
import pytest

from speechtables.llm import whitening
from speechtables.llm.whitening import Spectrum, rank_one, secular_roots

ROWS = "vec_id bigint, embedding array<float>, label int, n int, component string"


def frame(spark, rows):
    given = [(i, v and [None if x is None else float(x) for x in v], 0, 3, "x") for i, v in rows]
    return spark.createDataFrame(given, ROWS)


def plain(vectors, k=32):
    """x, exact deviations, and the components by a dense solver."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(((n * row - s) ** 2).sum()) for row in x]
    centred = np.array([(n * row - s) for row in x], float) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    k = min(k, int((values > 1e-12 * values.sum()).sum()))
    return deviation, centred @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_secular_roots_and_updates():
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64):
        for scale in (1e-8, 1.0, 1e8):
            d, v = np.sort(draw.random(n)) * scale, draw.normal(size=n)
            z = v / np.linalg.norm(v)
            roots, _ = secular_roots(d, z, float(v @ v))
            expected = np.linalg.eigvalsh(np.diag(d) + np.outer(v, v))
            assert np.allclose(roots, expected, rtol=1e-12, atol=1e-13 * expected.max())
    d, q = np.zeros(12), np.eye(12)
    whole = np.zeros((12, 12))
    for step in range(200):
        v = draw.normal(size=12) if step % 3 else np.eye(12)[step % 12] * (step % 5)
        v[3] = 0
        d, q = rank_one(d, q, v)
        whole += np.outer(v, v)
        assert (np.diff(d) >= 0).all()
    assert np.abs(q.T @ q - np.eye(12)).max() < 1e-12
    assert np.abs(q * d @ q.T - whole).max() < 1e-10 * whole.max()


def test_merged_states_equal_one_state():
    draw = np.random.default_rng(4)
    x = draw.integers(-50, 50, (300, 8)) + 1_000_000
    x[100:180] = x[100]
    x[:, 5] = 1_000_007
    parts = []
    for a, b in ((0, 0), (0, 1), (1, 120), (120, 300)):
        state = Spectrum(8)
        for row in x[a:b]:
            state.add(row, 1)
        parts.append(Spectrum.of({k: v[0] for k, v in state.row(0).items()}))
    for other in parts[1:]:
        parts[0].merge(other)
    centred = x - x.mean(axis=0)
    assert parts[0].n == 300 and (parts[0].s == x.sum(axis=0)).all()
    assert np.allclose(parts[0].d, np.linalg.eigvalsh(centred.T @ centred), atol=1e-6)
    again = Spectrum(8)
    for row, times in zip(*np.unique(x, axis=0, return_counts=True)):
        again.add(row, int(times))
    assert np.allclose(again.d, parts[0].d, atol=1e-6)


def check(found, rows, k=32):
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    wide = max(len(v) for _, v in kept)
    deviation, projected, explained = plain([list(v) + [0.0] * (wide - len(v)) for _, v in kept], k)
    assert len(found) == projected.size
    by_row = {}
    for r in found:
        by_row.setdefault(r["component"], []).append((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]))
        assert r["n"] == len(kept) and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    for c, values in by_row.items():
        own = [(i if i is not None else -1, d, w) for (i, _), d, w in zip(kept, deviation, projected[:, c - 1])]
        assert sorted((i, d) for i, d, _ in values) == sorted((i, d) for i, d, _ in own)
        order = lambda rows: np.array([w for *_, w in sorted(rows, key=lambda r: (r[0], r[1]))])
        a, b = order(values), order(own)
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_against_a_dense_solver(spark):
    draw = np.random.default_rng(5)
    mixed = draw.normal(size=(700, 40)) @ draw.normal(size=(40, 40)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    rows += [(900, None), (901, [1.0, None] * 20), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [])]
    rows += [(None, mixed[0].tolist()), (950, [1.5] * 33)] + [(7, mixed[7].tolist())] * 300
    check(whitening.whitened(frame(spark, rows).repartition(7)).collect(), rows)
    check(whitening.whitened(frame(spark, rows), components=3).collect(), rows, 3)


def test_merge_rounds(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(200, 5)))]
    check(whitening.whitened(frame(spark, rows).repartition(40)).collect(), rows)


def test_no_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whitened(frame(spark, rows))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert found.collect() == []
    large = [(i, [1e9 * (i % 5), float(i)]) for i in range(9)]
    found = whitening.whitened(frame(spark, large)).collect()
    assert len(found) == 9 and {r["deviation"] for r in found} == {None}
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    check(whitening.whitened(frame(spark, line)).collect(), line)
