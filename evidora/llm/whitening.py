"""Embedding whitening by QDWH spectral divide and conquer (operator 13).

Sums and products are Spark aggregations of whole numbers, so the covariance is
exact before it becomes doubles: entries are centred at the whole number next to
the mean, multiplied, and added up as decimals; what is left of the mean (at most
a half) is taken off in fractions.  Only width x width numbers reach the driver.

The covariance's eigenvectors come from polar decompositions.  QDWH iterates
X <- X (aI + bX'X)(I + cX'X)^-1 with dynamic weights, each step by the QR
factors of [sqrt(c) X; I], until X is the orthogonal polar factor U of A - sI.
(U + I) / 2 then projects on the eigenvectors over the shift s.  Bases of the
projector's range and of its complement split A into two smaller symmetric
matrices, which are split in turn until they are numbers or multiples of I.

The matrix of the first components over the roots of their eigenvalues is
broadcast (width x components numbers) and applied to every vector.

Defined cases: rows whose vector is null or holds null or non-finite entries go;
null ids and repeated rows stay, row by row; shorter vectors end in zeros, as an
entry of 0.  Entries beyond 2^52 after scaling are held there.  A component
without variance (to double precision) has no whitened values (null) and takes no
part in identity_error; explained is null if nothing varies.  A deviation that a
long cannot hold is null.  Other columns are not looked at; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow
from .vectors import matrix

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(2**52)
EPS = float(np.finfo(float).eps)
LONG = 0x7FFFFFFFFFFFFFFF
STEP = 4096
SUMS = "i int, j int, s decimal(38,0)"


def polar(a: np.ndarray, steps: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps."""
    n = len(a)
    alpha = np.linalg.norm(a)  # at least the largest singular value
    if alpha == 0:
        return np.eye(n)
    x = a / alpha
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * math.sqrt(n))  # at most the smallest
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(0.9 * low if math.isfinite(low) else 0.0, EPS), 1.0)
    for _ in range(steps):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3) if low < 1 else 0.0
        p = math.sqrt(1 + d)
        weight = p + math.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * p), 0)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q = np.linalg.qr(np.vstack((math.sqrt(c) * x, np.eye(n))))[0]
        new = b / c * x + (weight - b / c) / math.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (weight + b * low**2) / (1 + c * low**2), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved < (4 * EPS) ** (1 / 3) and abs(1 - low) < 10 * EPS:
            break
    return x


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    n, size = len(v), np.linalg.norm(v)
    done: list[np.ndarray] = []
    todo = [np.eye(n)]
    while todo:
        basis = todo.pop()
        k = basis.shape[1]
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        middle = np.diag(a).mean() if k else 0.0
        if k <= 1 or np.linalg.norm(a - middle * np.eye(k)) <= EPS * size:
            done.append(basis)
            continue
        rng = np.random.default_rng((n, k))
        for shift in (np.median(np.diag(a)), middle, *(middle + np.linalg.norm(a - middle * np.eye(k)) * rng.uniform(-0.5, 0.5, 20))):
            above = (polar(a - shift * np.eye(k)) + np.eye(k)) / 2
            rank = round(float(np.trace(above)))
            if not 0 < rank < k or np.linalg.norm(above @ above - above) > 1e-8 * k:
                continue  # the shift is beside or on the eigenvalues
            parts = []
            for projector, r in ((above, rank), (np.eye(k) - above, k - rank)):
                q = np.linalg.qr(projector @ rng.standard_normal((k, r)))[0]
                parts.append(np.linalg.qr(projector @ q)[0])
            halves = np.linalg.qr(np.hstack(parts))[0]
            todo += [basis @ halves[:, rank:], basis @ halves[:, :rank]]
            break
        else:
            done.append(basis @ _rotations(a))  # eigenvalues too close for any shift between them
    q = np.linalg.qr(np.hstack(done))[0] if done else np.zeros((n, 0))
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


def _rotations(a: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Eigenvectors by Jacobi rotations, for the small rest that no shift splits."""
    a, q, n = a.copy(), np.eye(len(a)), len(a)
    for _ in range(sweeps):
        for i in range(n):
            for j in range(i + 1, n):
                angle = math.atan2(2 * a[i, j], a[i, i] - a[j, j]) / 2
                turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j]] = turn.T @ a[[i, j]]
                q[:, [i, j]] = q[:, [i, j]] @ turn
    return q


def whole_entries(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * entry) as doubles that are whole numbers, and which rows stay."""
    m, good = matrix(column, width)
    with np.errstate(invalid="ignore"):
        return np.clip(np.floor(m * SCALE), -LARGEST, LARGEST), good


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y of whole numbers, exact, as Python integers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(len(x), 1)
    if most < 2.0**53:
        return (x.T @ y).astype(np.int64).astype(object)
    return x.astype(np.int64).astype(object).T @ y.astype(np.int64).astype(object)


def _sum_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    i, j = np.nonzero(total != 0)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([int(v) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "s"])


def _sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Row 0: sums of entries, and in place ``width`` the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, width + 1), object)
        for batch in batches:
            m, good = whole_entries(batch.column(0), width)
            total[0] += _products(np.ones((int(good.sum()), 1)), np.hstack((m[good], np.ones((int(good.sum()), 1)))))[0]
        yield from _sum_rows(total)

    return run


def _covariance(width: int, centre: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of products (i <= j) of entries less the whole ``centre``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            m, good = whole_entries(batch.column(0), width)
            m = m[good] - centre
            for lo in range(0, len(m), STEP):
                total += _products(m[lo : lo + STEP], m[lo : lo + STEP])
        yield from _sum_rows(np.triu(total))

    return run


class Whitening:
    """What the fit gives: n, sums S, and the components with their eigenvalues and shares."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], centre: list[int], components: int):
        self.n, self.width, self.sums = n, len(sums), sums
        rest = [Fraction(s, n) - c for s, c in zip(sums, centre)]
        v = np.zeros((self.width, self.width))
        for i in range(self.width):
            for j in range(i, self.width):
                v[i, j] = v[j, i] = float(Fraction(products.get((i, j), 0), n) - rest[i] * rest[j])
        values, vectors = eigen(v)
        k = min(components, self.width)
        self.values, trace = values[:k], float(np.trace(v))
        self.some = self.values > max(self.width * EPS * float(values.max(initial=0)), 0)
        self.explained = self.values / trace if trace > 0 else np.full(k, np.nan)
        self.matrix = np.where(self.some, vectors[:, :k] / np.sqrt(np.where(self.some, self.values, 1)), 0)
        self.centre, self.rest = np.array(centre, float), np.array([float(r) for r in rest])

    def apply(self, m: np.ndarray) -> np.ndarray:
        """Whitened values of rows of whole entries."""
        return ((m - self.centre) - self.rest) @ self.matrix

    def deviations(self, m: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2 of each row; None beyond a long."""
        far = float(np.abs(m).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0)
        if far < 2.0**62 and far * far * max(self.width, 1) < 2.0**62:
            d = m.astype(np.int64) * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = m.astype(np.int64).astype(object) * self.n - np.array(self.sums, object)
        return [s if s <= LONG else None for s in (d * d).sum(axis=1).tolist()] if self.width else [0] * len(m)


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """Three passes over the vectors: width, sums, products.  None without rows."""
    column = vectors.select("embedding").where("embedding IS NOT NULL")
    width = column.agg(F.max(F.size("embedding"))).first()[0] or 0

    def total(run: Callable) -> dict[tuple[int, int], int]:
        return {(r.i, r.j): int(r.s) for r in column.transform(map_arrow, run, SUMS).groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}

    sums = total(_sums(width))
    n = sums.get((0, width), 0)
    if not n:
        return None
    whole = [sums.get((0, i), 0) for i in range(width)]
    centre = [(2 * s + n) // (2 * n) for s in whole]
    return Whitening(n, whole, total(_covariance(width, np.array(centre, float))), centre, components)


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened values' covariance less the identity, from one more pass."""
    k = int(model.some.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            m, good = whole_entries(batch.column(0), model.width)
            w = model.apply(m[good])[:, model.some]  # centred already, to rounding
            total += np.vstack((w.T @ w, w.sum(axis=0)))
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    if not k:
        return None
    found = np.zeros((k + 1, k))
    sums = vectors.select("embedding").where("embedding IS NOT NULL").transform(map_arrow, run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in sums.collect():
        found[r.i, r.j] = r.s / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error from rows (vec_id, embedding)."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = _identity_error(vectors, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, good = whole_entries(batch.column(1), model.width)
            ids, m = batch.column(0).filter(pa.array(good)), m[good]
            for lo in range(0, len(m), STEP):
                part = m[lo : lo + STEP]
                row = np.repeat(np.arange(len(part)), k)
                repeat = pa.array(row)
                tile = np.tile(np.arange(k), len(part))
                deviation = pa.array(model.deviations(part), pa.int64())
                columns = [
                    ids.slice(lo, len(part)).take(repeat),
                    pa.array((tile + 1).astype(np.int32)),
                    pa.array(np.full(len(row), model.n, np.int64)),
                    deviation.take(repeat),
                    pa.array(model.apply(part).ravel(), mask=~model.some[tile]),
                    pa.array(model.explained[tile], from_pandas=True),
                    pa.array([error] * len(row), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding IS NOT NULL")
    return rows.transform(map_arrow, run, schema)
