"""Whitening of embeddings: principal components by FEAST (contour integrals of shifted solves) of an exactly summed covariance."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certalog.llm.common import table

#: x = floor(SCALE * c) + SHIFT of an entry c (fixed values); components told of a vector at most.
SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
#: Points of the quadrature, eigenvalues that one contour encloses at most, and rounds before it is laid anew.
POINTS, ENCLOSED, ROUNDS = 16, 8, 12


# The spectrum: of a matrix of dimensions squared, which is small beside the vectors.


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the inertia of every shift of v: Householder reflections from both sides."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not x[1:].any():
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues are above the shift: positive pivots of the shifted matrix (Sylvester's law)."""
    diagonal, off = t
    tiny = np.finfo(float).tiny ** 0.5
    count, pivot = 0, 1.0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = pivot if abs(pivot) > tiny else -tiny
        count += pivot > 0
    return count


def contour(v: np.ndarray, low: float, high: float, inside: int, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(eigenvalues, vectors) of v between low and high by FEAST; None if they do not come out as many as the inertia says.

    A subspace is filtered by the spectral projector of the interval, the quadrature of the resolvent on an ellipse around it (Gauss
    points on the upper half, the lower being its mirror), and Rayleigh-Ritz pairs of it are taken, until their residuals are at
    rounding.
    """
    n = len(v)
    wide = min(n, inside + max(4, inside))
    basis = np.random.default_rng(seed).standard_normal((n, wide))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi / 2 * (1 + nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * angle)
    shifts = centre + radius * turn
    size = max(abs(low), abs(high), float(np.abs(v).max()))
    eye = np.eye(n)
    solvers = [np.linalg.inv(z * eye - v) for z in shifts]
    best, values, vectors = np.inf, None, None
    for _ in range(ROUNDS):
        filtered = sum((w * radius / 2 * (u * (s @ basis))).real for w, u, s in zip(weights, turn, solvers))
        q = np.linalg.qr(filtered)[0]
        ritz, small = np.linalg.eigh(q.T @ v @ q)
        basis = q @ small
        own = (ritz > low) & (ritz <= high)
        if own.sum() != inside:
            continue
        residual = np.abs(v @ basis[:, own] - basis[:, own] * ritz[own]).max(initial=0)
        if residual >= best:
            break
        best, values, vectors = residual, ritz[own], basis[:, own]
        if residual <= 4 * np.finfo(float).eps * size:
            break
    return (values, vectors) if values is not None and best <= 1e-10 * size else None


def place(t: tuple[np.ndarray, np.ndarray], k: int, top: float) -> float:
    """About where the k-th largest eigenvalue is, by inertia counts: contours go between such places."""
    low, high = -top, top
    for _ in range(56):
        mid = (low + high) / 2
        low, high = (mid, high) if inertia(t, mid) >= k else (low, mid)
    return (low + high) / 2


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the most largest eigenvalues of a covariance that are above rounding.

    Intervals come from inertia counts: their ends lie in the widest gaps, so that each holds few eigenvalues and together all that are
    asked for. What the contour of an interval yields must be as many as the inertia at its ends says; else it is laid anew from another start,
    then divided.
    """
    n = len(v)
    bound = float(np.abs(v).sum(axis=1).max()) if n else 0.0  # no eigenvalue is above
    if not bound:
        return np.zeros(0), np.zeros((n, 0))
    scale = 2.0 ** np.floor(np.log2(bound))
    v, top = (v + v.T) / (2 * scale), bound / scale * (1 + 1e-9)
    t = tridiagonal(v)
    count = inertia(t, 16 * n * np.finfo(float).eps * float(np.trace(v)))
    want = min(most, count)
    if not want:
        return np.zeros(0), np.zeros((n, 0))
    near = [place(t, k, top) for k in range(1, min(n, want + ENCLOSED) + 1)]
    gap = lambda k: near[k - 1] - (near[k] if k < len(near) else 0.0)

    def edge(k: int) -> float:
        """Between the k-th eigenvalue and the next."""
        return near[k - 1] - gap(k) / 2 if k else min(top, near[0] + max(gap(1) / 2, 1e-6 * near[0]))

    last = want if want == count else max(range(want, min(count, len(near) - 1) + 1), key=gap)
    segments, i = [], 0
    while i < last:
        j = last
        if last - i > ENCLOSED:
            j = max(range(i + ENCLOSED // 2, i + ENCLOSED + 1), key=gap)
            if gap(j) < 1e-9 * top:  # in a bunch: all of it
                j = next((k for k in range(j, last) if gap(k) >= 1e-9 * top), last)
        segments.append((i, j))
        i = j
    found = []
    while segments:
        i, j = segments.pop()
        low, high = edge(j), edge(i)
        if inertia(t, low) - inertia(t, high) != j - i:
            raise ArithmeticError(f"no interval holds the eigenvalues {i + 1} to {j} alone")
        one = next((x for seed in range(3) if (x := contour(v, low, high, j - i, seed)) is not None), None)
        if one is not None:
            found.append(one)
        elif j - i > 1:
            k = max(range(i + 1, j), key=gap)
            segments += [(i, k), (k, j)]
        else:
            raise ArithmeticError(f"the eigenvalue number {j} did not come out")
    values, vectors = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found], axis=1)
    order = np.argsort(-values, kind="stable")[:want]
    return values[order] * scale, vectors[:, order]


# The sums over all vectors: Spark's work.


def _matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The lists of a column, all dims long, as rows."""
    lists = batch.column(column).combine_chunks() if isinstance(batch.column(column), pa.ChunkedArray) else batch.column(column)
    return np.asarray(lists.flatten(), dtype=np.int64).reshape(batch.num_rows, dims)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows whose vector can be used, x = floor(64 * entry) + 1000000 as longs.

    Out are null and empty vectors, those with a null, a non-finite entry, or one whose x is no long.
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < 9.0e18)
    rows = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(fine(c), F.lit(False))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def summed(x: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension of the longest dimension that most vectors have: each task sums its own, then Spark by dimension."""
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return 0, []
    dims = sizes[0].d

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            m = _matrix(batch, "x", dims)
            high, low = m >> 31, m & 0x7FFFFFFF  # no sum of a batch overflows
            total = [t + (int(h) << 31) + int(k) for t, h, k in zip(total, high.sum(axis=0), low.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], names=["dim", "s"])

    parts = x.where(F.size("x") == dims).select("x").mapInArrow(partial, "dim int, s string")
    rows = parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    return sizes[0].n, [int(r.s) for r in sorted(rows, key=lambda r: r.dim)]


def centred(m: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray | None]:
    """x - S / n as doubles, and n * x - S as exact integers: longs if they fit, else Python's."""
    reach = n * (int(np.abs(m).max(initial=0)) + 1) + max((abs(s) for s in sums), default=0)
    if reach < 1 << 62:
        exact = m * np.int64(n) - np.array(sums, dtype=np.int64)
        return exact / float(n), exact
    exact = m.astype(object) * n - np.array(sums, dtype=object)
    return np.array([[float(Fraction(e, n)) for e in row] for row in exact], dtype=np.float64).reshape(m.shape), exact


def products(x: DataFrame, n: int, sums: list[int], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the centred vectors, or of those times the weights: each task multiplies its own, then Spark sums by entry."""
    dims = len(sums)
    wide = dims if weights is None else weights.shape[1]
    i, j = np.triu_indices(wide)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((wide, wide)), np.zeros(wide)
        for batch in batches:
            y = centred(_matrix(batch, "x", dims), n, sums)[0]
            y = y if weights is None else y @ weights
            total += y.T @ y
            first += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, np.arange(wide)], pa.int32()), pa.array(np.r_[j, np.full(wide, -1)], pa.int32()), pa.array(np.r_[total[i, j], first])], names=["i", "j", "s"]
        )

    parts = x.where(F.size("x") == dims).select("x").mapInArrow(partial, "i int, j int, s double")
    out, mean = np.zeros((wide, wide)), np.zeros(wide)
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # dimensions squared
        if r.j < 0:
            mean[r.i] = r.s / n
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return mean, out - np.outer(mean, mean)  # the mean is 0 but for rounding


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    Vectors that are null, empty, hold a null or a non-finite entry, or one whose x is no long have no rows, and nor have those of another length
    than most have (ties: the longer). Components whose eigenvalue is within rounding of 0 have none: constant vectors, or a single one,
    give an empty result, as an empty table does. A deviation beyond a long is null. Rows that repeat a vec_id, or whose vec_id is null, are vectors of their own;
    other columns are ignored. The driver holds numbers of dimensions squared; all else is by vectors' tasks.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = integers(vectors)
    n, sums = summed(x)
    dims = len(sums)
    if not n:
        return spark.createDataFrame([], schema)
    _, covariance = products(x, n, sums)
    values, axes = components(covariance, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    weights = axes / np.sqrt(values)
    error = float(np.abs(products(x, n, sums, weights)[1] - np.eye(len(values))).max())
    share = values / float(np.trace(covariance))
    k = len(values)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            y, exact = centred(_matrix(batch, "x", dims), n, sums)
            if exact.dtype == object or dims * int(np.abs(exact).max(initial=0)) ** 2 >= 1 << 62:
                exact = exact.astype(object)
            deviation = [d if d < 1 << 63 else None for d in (exact * exact).sum(axis=1).tolist()]
            each = pa.array(np.repeat(np.arange(count), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()), pa.array(np.full(count * k, n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(each), pa.array((y @ weights).ravel()), pa.array(np.tile(share, count)), pa.array(np.full(count * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.where(F.size("x") == dims).mapInArrow(told, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
