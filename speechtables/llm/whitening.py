"""Whitening of vectors by an incremental eigendecomposition of their covariance.

Each entry c becomes the whole number x = floor(64 * c) + 1000000. Every task holds one state: the count and the
exact sums of its x-vectors, and the spectrum of their scatter matrix. A vector changes the spectrum by one
centred rank-one update: the new eigenvalues are the roots of the secular equation, one between each two old
ones, after entries that cannot move are deflated. States are merged in groups of ``MERGED``: the other state's
eigenpairs and the distance of the two means are added as successive rank-one updates. The merged vectors span
a space in which a last pass over all rows gives the Rayleigh-Ritz matrix; its eigenvectors are the
components, to double precision.

What leaves Spark is bounded by the square of the dimension, whatever the number of rows; a task holds a batch
of rows and one state.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped, and so are those with
an entry of 2**40 or more in size, whose x no sum could hold; shorter vectors are filled up with zeros to the longest;
repeated rows and ids count as often as they occur; null ids are kept; components without variance (a
relative eigenvalue of 1e-12 or less) are not returned, so equal vectors, a single vector and an empty
table give no rows; equal eigenvalues are numbered in any order; a deviation beyond a long is null;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtables.llm.common import batch_of, stored

SCALE, SHIFT = 64.0, 1_000_000
MERGED = 16
_LARGEST = float(1 << 40)
_EPS = np.finfo(np.float64).eps
_NO_VARIANCE = 1e-12


def _deflated(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """Numbers of the entries that the update moves; equal eigenvalues are rotated (in place) until one
    of them holds the whole weight."""
    least = 8 * _EPS * max(np.abs(d).max(), rho)
    live = np.flatnonzero(rho * np.abs(z) > least)
    if len(live) < 2:
        return live
    both = np.hypot(z[live[1:]], z[live[:-1]])
    if (np.diff(d[live]) * np.abs(z[live[1:]] * z[live[:-1]]) > least * both**2).all():
        return live
    kept, last = [], live[0]
    for i in live[1:]:
        weight = np.hypot(z[i], z[last])
        c, s = z[i] / weight, z[last] / weight
        if abs((d[i] - d[last]) * c * s) > least:
            kept.append(last)
        else:
            z[i], z[last] = weight, 0.0
            q[:, last], q[:, i] = c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]
            d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
        last = i
    kept = np.array([*kept, last])
    return kept[np.argsort(d[kept], kind="stable")]


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z**2 / (d - x)) for rising ``d``, and the matrix d[j] - root[i] without cancellation.

    Each root is sought from the nearer of its two poles by fitting one pole to each side, with a bracket that
    falls back on halving.
    """
    n = len(d)
    weight = rho * z * z
    above = np.append(d[1:], d[-1] + weight.sum())
    half = (above - d) / 2
    middle = 1 + (weight / (d - (d + half)[:, None])).sum(axis=1)
    right = middle < 0
    from_above = right.copy()
    from_above[-1] = False
    origin = np.where(from_above, above, d)
    low = np.where(from_above, -half, np.where(right, half, 0.0))
    high = np.where(from_above, 0.0, np.where(right, 2 * half, half))
    apart = d - origin[:, None]
    lower = np.tri(n, dtype=bool)
    p, q = d - origin, above - origin
    x = (low + high) / 2
    for _ in range(80):
        gap = apart - x[:, None]
        term = weight / gap
        slope = term / gap
        below, beyond = (term * lower).sum(axis=1), (term * ~lower).sum(axis=1)
        f = 1 + below + beyond
        low, high = np.where(f <= 0, x, low), np.where(f > 0, x, high)
        done = (np.abs(f) <= 4 * _EPS * n * (1 + np.abs(below) + np.abs(beyond))) | (high - low <= 2 * _EPS * np.abs(x))
        if done.all():
            break
        down, up = (slope * lower).sum(axis=1), (slope * ~lower).sum(axis=1)
        b, e = down * (p - x) ** 2, up * (q - x) ** 2
        level = f - down * (p - x) - up * (q - x)
        one, two = level * (p + q) + b + e, level * p * q + b * q + e * p
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(one * one - 4 * level * two, 0))
            large = (one + np.copysign(root, one)) / 2
            first, second = large / level, two / large
        inside = lambda y: (y > low) & (y < high)
        step = np.where(inside(first), first, np.where(inside(second), second, (low + high) / 2))
        x = np.where(done, x, step)
    return origin + x, apart - x[:, None]


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of q diag(d) q' + v v' for rising ``d``, again rising."""
    z = v @ q
    rho = float(z @ z)
    if rho == 0.0:
        return d, q
    z, d, q = z / np.sqrt(rho), d.copy(), q.copy()
    live = _deflated(d, q, z, rho)
    if len(live) == 1:
        d[live] += rho * z[live] ** 2
    elif len(live):
        poles = d[live]
        roots, gap = secular_roots(poles, z[live], rho)
        # the weights that have exactly these roots make the new vectors orthogonal
        n = len(live)
        among = poles[:, None] - poles
        pair = np.where(np.tri(n, dtype=bool), np.vstack([among[1:], np.ones(n)]), among)
        exact = np.copysign(np.sqrt(np.abs(np.prod(-gap / pair, axis=0))), z[live])
        turn = exact / gap
        turn /= np.linalg.norm(turn, axis=1)[:, None]
        q[:, live] = q[:, live] @ turn.T
        d[live] = roots
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def _apart(n: int, x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """n * x - s, in Python's integers where 64 bits may not hold it."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return n * x - s
    return n * x.astype(object) - s.astype(object)


class Spectrum:
    """Count, exact sums and scatter spectrum of whole-number vectors."""

    def __init__(self, dimension: int):
        self.n, self.s = 0, np.zeros(dimension, np.int64)
        self.d, self.q = np.zeros(dimension), np.eye(dimension)

    def add(self, x: np.ndarray, times: int) -> None:
        """``times`` copies of ``x``."""
        if self.n:
            apart = _apart(self.n, x, self.s).astype(np.float64) / self.n
            self.d, self.q = rank_one(self.d, self.q, apart * np.sqrt(self.n * times / (self.n + times)))
        self.n += times
        self.s += times * x

    def merge(self, other: Spectrum) -> None:
        if not self.n or not other.n:
            if other.n:
                self.n, self.s, self.d, self.q = other.n, other.s, other.d, other.q
            return
        for value, vector in zip(other.d, other.q.T):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, vector * np.sqrt(value))
        apart = self.s / self.n - other.s / other.n
        self.d, self.q = rank_one(self.d, self.q, apart * np.sqrt(self.n * (other.n / (self.n + other.n))))
        self.n += other.n
        self.s = self.s + other.s

    def row(self, part: int) -> dict:
        return {"part": [part], "n": [self.n], "s": [self.s.tobytes()], "d": [self.d.tobytes()], "q": [self.q.tobytes()]}

    @classmethod
    def of(cls, row) -> Spectrum:
        out = cls(0)
        out.n, out.s = int(row["n"]), np.frombuffer(row["s"], np.int64).copy()
        out.d = np.frombuffer(row["d"], np.float64).copy()
        out.q = np.frombuffer(row["q"], np.float64).reshape(len(out.d), len(out.d)).copy()
        return out


_STATE = "part bigint, n bigint, s binary, d binary, q binary"
_STATE_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("s", pa.binary()), ("d", pa.binary()), ("q", pa.binary())])


def _whole(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """The x-vectors of a batch."""
    entries = batch.column("c").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return np.floor(SCALE * entries).astype(np.int64) + SHIFT


def usable(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, c) of the vectors that take part, ``c`` as doubles of any length."""
    c = F.col(column).cast("array<double>")
    bad = F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= _LARGEST / SCALE))
    rows = embeddings.select(F.col(id_column).alias("vec_id"), c.alias("c"))
    return rows.filter(F.col("c").isNotNull() & (F.size("c") > 0) & ~bad)


def _spectra(rows: DataFrame, dimension: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum(dimension)
        for batch in batches:
            if batch.num_rows:
                for x, times in zip(*np.unique(_whole(batch, dimension), axis=0, return_counts=True)):
                    state.add(x, int(times))
        if state.n:
            yield batch_of(state.row(TaskContext.get().partitionId()), _STATE_ARROW)

    return rows.mapInArrow(run, _STATE)


def _merged(states: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] // MERGED != group:
                    if state is not None:
                        yield batch_of(state.row(group), _STATE_ARROW)
                    group, state = row["part"] // MERGED, Spectrum.of(row)
                else:
                    state.merge(Spectrum.of(row))
        if state is not None:
            yield batch_of(state.row(group), _STATE_ARROW)

    dealt = states.repartition(F.expr(f"part div {MERGED}")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, _STATE)


def fitted(rows: DataFrame, dimension: int) -> Spectrum | None:
    """The merged spectrum of all rows; one state comes to the driver."""
    states = stored(_spectra(rows, dimension), "whitening-states")
    while (last := states.agg(F.max("part")).first()[0]) is not None and last > 0:
        states = stored(_merged(states), "whitening-states")
    found = states.first()
    return None if found is None else Spectrum.of(found)


def _centred(batch: pa.RecordBatch, dimension: int, n: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - s exactly, and x minus the mean."""
    apart = _apart(n, _whole(batch, dimension), s)
    return apart, apart.astype(np.float64) / n


def _second_moments(rows: DataFrame, dimension: int, n: int, s: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and mean square matrix of all centred vectors seen in ``basis``; the square of its width comes to the driver."""
    k = basis.shape[1]
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                y = _centred(batch, dimension, n, s)[1] @ basis
                total[:k] += y.T @ y
                total[k] += y.sum(axis=0)
        i, j = np.indices(total.shape).reshape(2, -1)
        yield batch_of({"i": i, "j": j, "value": total.ravel()}, schema)

    sums = rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((k + 1, k))
    for i, j, value in sums.collect():
        out[i, j] = value / n
    return out[k], (out[:k] + out[:k].T) / 2


_RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def whitened(embeddings: DataFrame, components: int = 32, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    spark = embeddings.sparkSession
    rows = usable(embeddings, id_column, column)
    least, dimension = rows.agg(F.min(F.size("c")), F.max(F.size("c"))).first()
    if dimension is None:
        return spark.createDataFrame([], _RESULT)
    if least < dimension:
        rows = rows.select("vec_id", F.concat("c", F.array_repeat(F.lit(0.0), F.lit(dimension) - F.size("c"))).alias("c"))
    state = fitted(rows, dimension)
    n, s = state.n, state.s
    basis = np.linalg.qr(state.q)[0]
    value, turn = np.linalg.eigh(_second_moments(rows, dimension, n, s, basis)[1])
    value, vectors, trace = value[::-1], (basis @ turn)[:, ::-1], value.sum()
    k = int((value[:components] > _NO_VARIANCE * max(trace, 0)).sum())
    if not k:
        return spark.createDataFrame([], _RESULT)
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)])
    unit, explained = vectors / np.sqrt(value[:k]), value[:k] / trace
    mean, square = _second_moments(rows, dimension, n, s, unit)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    schema = pa.schema(
        [
            ("vec_id", pa.int64()),
            ("component", pa.int32()),
            ("n", pa.int64()),
            ("deviation", pa.int64()),
            ("whitened", pa.float64()),
            ("explained", pa.float64()),
            ("identity_error", pa.float64()),
        ]
    )
    most = np.sqrt(float(1 << 62) / dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                m = batch.num_rows
                apart, centred = _centred(batch, dimension, n, s)
                if apart.dtype == np.int64 and np.abs(apart).max() <= most:
                    deviation = pa.array((apart * apart).sum(axis=1))
                else:
                    exact = [sum(v * v for v in r) for r in apart.tolist()]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                each = np.repeat(np.arange(m), k)
                yield batch_of(
                    {
                        "vec_id": batch.column("vec_id").cast(pa.int64()).take(pa.array(each)),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                        "n": np.full(m * k, n),
                        "deviation": deviation.take(pa.array(each)),
                        "whitened": (centred @ unit).ravel(),
                        "explained": np.tile(explained, m),
                        "identity_error": np.full(m * k, error),
                    },
                    schema,
                )

    return rows.mapInArrow(run, _RESULT)
