"""Whitening of embeddings by the leading eigenvectors of their covariance, found by contour integration.

Entries become whole numbers x = floor(64 c) + 1,000,000, so counts and sums are
exact. Spark sums the centred products of all vectors to a covariance of
dimension x dimension numbers; only these reach the driver. There the spectrum
is cut into intervals by inertia: the signs of the pivots of V - shift I tell
how many eigenvalues lie below the shift. For each interval a quadrature of
solves with complex shifts around it projects random vectors onto the
interval's eigenvectors, and a Rayleigh-Ritz step extracts them; this repeats
until residuals are at rounding level. An interval is done only if it has
exactly as many eigenvalues as the inertia counted, so none is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlab.llm.common import map_arrow, small_batches, stored

COUNT = 32
SCALE, SHIFT = 64, 1_000_000
#: Larger whole numbers saturate, so that sums of split halves stay exact.
LARGEST = 2**52
#: Components with less than this share of the total variance are rounding noise.
NOISE = 1e-11
NODES = 8
CROWD, WIDE = 12, 4.0


def negative_pivots(a: np.ndarray) -> int:
    """The number of negative eigenvalues of a symmetric matrix, from an L D L' factorisation with pivots of one or two rows."""
    a, n, i, negative = a.copy(), len(a), 0, 0
    while i < n:
        rest = np.abs(a[i:, i:])
        p = int(np.argmax(np.diagonal(rest)))
        r, s = np.unravel_index(int(np.argmax(rest)), rest.shape)
        if rest[r, s] == 0:
            break
        if rest[p, p] >= 0.64 * rest[r, s]:
            _swap(a, i, i + p)
            column = a[i + 1 :, i]
            negative += bool(a[i, i] < 0)
            a[i + 1 :, i + 1 :] -= np.outer(column, column) / a[i, i]
            i += 1
        else:  # the off-diagonal entry dominates: one eigenvalue of either sign
            r, s = sorted((int(r), int(s)))
            _swap(a, i, i + r)
            _swap(a, i + 1, i + s)
            columns = a[i + 2 :, i : i + 2]
            negative += 1
            a[i + 2 :, i + 2 :] -= columns @ np.linalg.solve(a[i : i + 2, i : i + 2], columns.T)
            i += 2
    return negative


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def eigenvalues_above(v: np.ndarray, at: float) -> int:
    return len(v) - negative_pivots(v - at * np.eye(len(v)))


def intervals(v: np.ndarray, low: float, high: float, wanted: int) -> Iterator[tuple[float, float, int]]:
    """Intervals of eigenvalues from the largest down, each with its count, until `wanted` are covered.

    An interval ends below WIDE times its start, so that what lies far below it
    is far outside its contour, too.
    """
    todo = [(low, high, eigenvalues_above(v, low), 0)]
    covered = 0
    while todo and covered < wanted:
        a, b, above_a, above_b = todo.pop()
        m = above_a - above_b
        if m <= 0:
            continue
        if (m <= CROWD and b <= WIDE * a) or b - a <= 1e-9 * high:
            covered += m
            yield a, b, m
            continue
        middle = (a + b) / 2 if b <= WIDE * a else np.sqrt(a * b)
        above = eigenvalues_above(v, middle)
        todo += [(a, middle, above_a, above), (middle, b, above, above_b)]


def project(v: np.ndarray, y: np.ndarray, a: float, b: float) -> np.ndarray:
    """`y` projected onto the eigenvectors in [a, b]: a quadrature over the upper half of the circle around it."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius, one = (a + b) / 2, (b - a) / 2, np.eye(len(v))
    out = np.zeros_like(y)
    for point, weight in zip(points, weights, strict=True):
        turn = radius * np.exp(0.5j * np.pi * (1 - point))
        out += weight / 2 * (turn * np.linalg.solve((centre + turn) * one - v, y)).real
    return out


def rayleigh_ritz(v: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(y)
    values, inner = np.linalg.eigh(q.T @ v @ q)
    return values, q @ inner


def eigen_interval(v: np.ndarray, a: float, b: float, m: int, seed: int = 7) -> np.ndarray:
    """The `m` eigenvectors with eigenvalues in [a, b], as columns; v has a norm of about 1."""
    d = len(v)
    rng = np.random.default_rng(seed)
    margin = max(1e-12, 0.02 * (b - a))  # an eigenvalue may lie on the rim
    near = max(m, eigenvalues_above(v, a - margin) - eigenvalues_above(v, b + margin))
    y = rng.standard_normal((d, min(d, 2 * near + 4)))
    found = False
    for _ in range(60):
        values, x = rayleigh_ritz(v, project(v, y, a - margin, b + margin))
        residual = np.linalg.norm(v @ x - x * values, axis=0)
        inside = np.flatnonzero((values >= a - 1e-13) & (values < b + 1e-13) & (residual <= 1e-14 * d))
        if len(inside) == m and found:
            return x[:, inside]
        y, found = x, len(inside) == m  # one more round brings residuals to rounding level
        if len(inside) > m and y.shape[1] < d:  # a double at the rim: widen the space and go on
            y = np.hstack([y, rng.standard_normal((d, min(4, d - y.shape[1])))])
    raise ArithmeticError(f"{len(inside)} of {m} eigenvalues found between {a} and {b}")


def leading_components(v: np.ndarray, count: int = COUNT) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit vectors as columns.

    Those of at most NOISE of the trace are left out. The sign makes each
    vector's largest entry positive.
    """
    size = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if not size > 0:
        return np.empty(0), np.empty((len(v), 0))
    scaled = (v + v.T) / (2 * size)
    low = NOISE * float(np.trace(scaled))
    parts = [eigen_interval(scaled, a, b, m) for a, b, m in intervals(scaled, low, 1.0 + 1e-9, count)]
    if not parts:
        return np.empty(0), np.empty((len(v), 0))
    values, x = rayleigh_ritz(scaled, np.hstack(parts))
    values, x = values[::-1][:count], x[:, ::-1][:, :count]
    top = x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])]
    return values * size, x * np.sign(top)


@dataclass(frozen=True)
class Fit:
    """What all vectors of one number of dimensions share."""

    n: int
    total: list[int]
    near: np.ndarray
    offset: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; whole numbers near the mean are taken off first, which is exact."""
        return (x - self.near) - self.offset

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        left = [s - self.n * int(c) for s, c in zip(self.total, self.near, strict=True)]
        y = x - self.near
        bound = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, left), default=0)
        if bound * bound * len(left) < 2**63:
            return ((self.n * y - np.array(left)) ** 2).sum(axis=1).tolist()
        rows = ((self.n * y.astype(object) - np.array(left, object)) ** 2).sum(axis=1).tolist()
        return [r if r < 2**63 else None for r in rows]


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows with a vector of finite entries only: id, dimensions, whole numbers as bytes."""
    lists = batch.column("_vector")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = lists.flatten()
    c = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths]) & (lengths > 0)
    c = c[np.repeat(ok, lengths)]
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    offsets = np.concatenate([[0], 8 * np.cumsum(lengths[ok])]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])
    return pa.RecordBatch.from_arrays([batch.column("_id").filter(pa.array(ok)), pa.array(lengths[ok]), column], ["_id", "_d", "_x"])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimensions, places in the batch and whole numbers of the vectors of each dimension."""
    sizes, rows = batch.column("_d").to_numpy(), batch.column("_x").to_pylist()
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, np.frombuffer(b"".join([rows[i] for i in at]), np.int64).reshape(-1, d)


def _totals(table: DataFrame, step: Callable[[int, np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray]:
    """Sum `step` over all vectors of each dimension: one partial sum a task, added up by Spark."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _parts(batch):
                held[d] = held.get(d, 0) + step(d, x)
        for d, total in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, d)), pa.array(np.arange(total.size)), pa.array(total.ravel().astype(dtype))], ["d", "at", "m"]
            )

    rows = table.select("_d", "_x").mapInArrow(run, f"d long, at long, m {kind}").groupBy("d", "at").agg(F.sum("m").alias("m"))
    return {int(d): part.sort_values("at")["m"].to_numpy() for d, part in rows.toPandas().groupby("d")}


def fit(table: DataFrame, count: int = COUNT) -> dict[int, Fit]:
    """Means and leading components of all vectors, for each number of dimensions."""
    halves = _totals(table, lambda d, x: np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), "long")
    fits = {}
    for d, sums in halves.items():
        n = int(sums[0])
        total = [(int(h) << 32) + int(w) for h, w in zip(sums[1 : d + 1], sums[d + 1 :], strict=True)]
        near = [(2 * s + n) // (2 * n) for s in total]
        offset = np.array([(s - n * c) / n for s, c in zip(total, near, strict=True)])
        fits[d] = Fit(n, total, np.array(near, np.int64), offset, np.empty(0), np.empty((d, 0)), np.empty(0))

    def products(d: int, x: np.ndarray) -> np.ndarray:
        y = fits[d].centred(x)
        return y.T @ y

    for d, sums in _totals(table, products, "double").items():
        v = sums.reshape(d, d) / fits[d].n
        values, axes = leading_components(v, count)
        fits[d] = Fit(fits[d].n, fits[d].total, fits[d].near, fits[d].offset, values, axes, values / np.trace(v) if len(values) else values)
    return fits


def identity_errors(table: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, measured over all vectors."""
    means = {d: s / fits[d].n for d, s in _totals(table, lambda d, x: fits[d].whitened(x).sum(axis=0), "double").items()}

    def products(d: int, x: np.ndarray) -> np.ndarray:
        w = fits[d].whitened(x) - means[d]
        return w.T @ w

    sums = _totals(table, products, "double")
    return {d: float(np.abs(s.reshape(len(means[d]), -1) / fits[d].n - np.eye(len(means[d]))).max()) for d, s in sums.items()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COUNT) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` for every vector and component.

    Null vectors, empty ones and those with a null or non-finite entry are
    dropped. Vectors of each number of dimensions are a list of their own.
    Components without variance (at most NOISE of the trace) have no rows, so a
    list of equal vectors, or of one, has none. Entries beyond 2^46 saturate; a
    deviation beyond a long is null. Every row counts, those of repeated or
    null ids too. Other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vector"))
    table = stored(map_arrow(rows, _whole, "_id long, _d long, _x binary"), "vectors")
    fits = fit(table, count)
    fits = {d: f for d, f in fits.items() if len(f.values)}
    table = table.filter(F.col("_d").isin(list(fits)))
    errors = identity_errors(table, fits)

    def project_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for d, at, x in _parts(batch):
            f = fits[d]
            k, m = len(f.values), len(x)
            each = lambda column: column.take(pa.array(np.repeat(np.arange(m), k)))
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        each(batch.column("_id").take(pa.array(at))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, f.n)),
                        each(pa.array(f.deviations(x), pa.int64())),
                        pa.array(f.whitened(x).ravel()),
                        pa.array(np.tile(f.explained, m)),
                        pa.array(np.full(m * k, errors[d])),
                    ],
                    ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
            )
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    schema = "_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return map_arrow(table, project_rows, schema).withColumnRenamed("_id", id_col)
