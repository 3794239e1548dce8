"""Whitening of embeddings: leading principal components of the distinct vectors, each projection scaled to unit variance.

Vectors are read as whole numbers, floor(256 * entry), and each distinct one counts once. Two passes over them in tasks give the
sums of each dimension, which are exact, and then the covariance of what is left after the mean is taken away: a task sends its own
sums, and Spark adds them up entry by entry. What reaches the driver is a matrix of dimensions by dimensions, whatever the number
of vectors. There it is made tridiagonal by Householder reflections; Sturm counts, which say how many eigenvalues lie below a
number, give the leading eigenvalues by bisection; inverse iteration gives their vectors, made orthogonal within clusters of close
eigenvalues. The mean and the components go to every task, and each row is projected where it lies.

Defined cases: rows whose vector is null or has a null, infinite or not-a-number entry are left out, and so are entries too large
for a whole number of 62 bits; of vectors of several lengths, those of the commonest length count (the longer of equally common
ones), others are left out; a row without id is kept with its null id; rows that repeat are all given back, but count once for
the fit; a component without variance (all vectors equal, or fewer vectors than components) has whitened null and explained 0;
an empty table gives no rows; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

COMPONENTS, SCALE = 4, 256.0
#: Eigenvalues that are less apart than this share of the largest are a cluster.
CLUSTER = 1e-3
#: A component has variance if its eigenvalue is above this share of the trace.
NO_VARIANCE = 1e-12
_LARGEST = float(1 << 62)


def whole_numbers(column: pa.Array, dim: int, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have `dim` finite entries, and those rows as a matrix of longs, floor(scale * entry)."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    flat = column.filter(right).flatten().cast(pa.float64()).fill_null(float("nan"))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * flat.to_numpy(zero_copy_only=False).reshape(-1, dim)) + 0.0
        good = (np.abs(x) < _LARGEST).all(axis=1)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))[good]
    return rows, x[good].astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def common_length(rows: DataFrame, vector: str) -> int | None:
    """The commonest number of entries, the larger of equally common ones; None without vectors."""
    sizes = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    return first and first.dim


def distinct_vectors(rows: DataFrame, vector: str, dim: int, scale: float = SCALE) -> DataFrame:
    """x, each distinct vector of whole numbers once; copies meet within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = whole_numbers(b.column(0), dim, scale)
            ends = pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["x"])

    return rows.select(F.col(vector).cast("array<double>")).mapInArrow(run, "x array<long>").distinct()


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, exact; a task sends one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for b in batches:
            x = _matrix(b.column(0), dim)
            n += len(x)
            if len(x):
                safe = float(np.abs(x).max()) * len(x) < _LARGEST
                total = [a + int(s) for a, s in zip(total, x.sum(axis=0) if safe else x.astype(object).sum(axis=0))]
        if n:
            sums = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim), sums], ["i", "n", "total"])

    parts = fit.mapInArrow(run, "i int, n long, total decimal(38,0)").groupBy("i")
    found = parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()  # a row per dimension
    return (found[0].n, [int(r.total) for r in found]) if found else (0, [0] * dim)


def product_sums(fit: DataFrame, dim: int, width: int, turned) -> np.ndarray:
    """The sum of y' y over all vectors, y being what `turned` makes of a batch of them (rows of `width` numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            y = turned(_matrix(b.column(0), dim))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    cells = fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    out = np.zeros((width, width))
    for r in cells.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # width x width rows
        out[r.i, r.j] = r.value
    return (out + out.T) / 2


# Eigenvalues and eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections (in order) that make `a` tridiagonal."""
    a, n, mirrors = a.astype(np.float64).copy(), len(a), []
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or not v[1:].any():
            off[k] = v[0]
            mirrors.append(np.zeros(n - k - 1))
            continue
        off[k] = -np.copysign(length, v[0])
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        mirrors.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diagonal(a).copy(), off, mirrors


def restored(z: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix, in the coordinates of the matrix it came from."""
    z = z.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        z[k + 1 :] -= 2 * (v @ z[k + 1 :]) * v
    return z


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each of `x`: the negative pivots of the matrix less x."""
    tiny = np.finfo(float).tiny * max(1.0, float((off * off).max(initial=0.0)))
    count, q = np.zeros(len(x), np.int64), np.ones(len(x))
    for i, d in enumerate(diagonal):
        q = d - x - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    n = len(diagonal)
    reach = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    width = max(float(np.abs(diagonal).max(initial=0)) + float(reach.max(initial=0)), np.finfo(float).tiny)
    low, high = np.full(k, float((diagonal - reach).min())) - 1e-12 * width, np.full(k, float((diagonal + reach).max())) + 1e-12 * width
    rank = n - 1 - np.arange(k)  # the eigenvalue with so many below it
    while True:
        middle = (low + high) / 2
        if not ((low < middle) & (middle < high) & (high - low > 1e-17 * width)).any():
            return (low + high) / 2
        over = below(diagonal, off, middle) > rank
        low, high = np.where(over, low, middle), np.where(over, middle, high)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots below `least` count as that."""
    n = len(diagonal)
    u, v, w, x = [0.0] * n, [0.0] * n, [0.0] * n, b.tolist()  # the rows left after elimination: three diagonals
    p, q = float(diagonal[0] - shift), float(off[0]) if n > 1 else 0.0  # of the row in hand, from column i on
    for i in range(n - 1):
        e, d, f = float(off[i]), float(diagonal[i + 1] - shift), float(off[i + 1]) if i + 2 < n else 0.0
        if abs(e) > abs(p):
            u[i], v[i], w[i] = e, d, f
            m = p / e
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
            p, q = q - m * d, -m * f
        else:
            p = p if abs(p) >= least else least
            u[i], v[i], w[i] = p, q, 0.0
            m = e / p
            x[i + 1] -= m * x[i]
            p, q = d - m * q, f
    u[n - 1] = p if abs(p) >= least else least
    for i in range(n - 1, -1, -1):
        t = x[i] - (v[i] * x[i + 1] if i + 1 < n else 0.0) - (w[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = t / u[i]
    return np.array(x)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows, largest entry positive."""
    size = float(np.abs(matrix).max(initial=0.0))
    k = min(k, len(matrix))
    if size == 0:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diagonal, off, mirrors = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, k)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    vectors, first, rng = [], 0, np.random.default_rng(0)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j  # a new cluster
        z = rng.standard_normal(len(matrix))
        for _ in range(6):
            for other in vectors[first:] * 2:
                z -= (other @ z) * other
            z /= np.linalg.norm(z)
            z = _solved(diagonal, off, value, z, 1e-16 * norm)
            z /= np.abs(z).max()
        for other in vectors[first:] * 2:
            z -= (other @ z) * other
        vectors.append(z / np.linalg.norm(z))
    out = np.stack([restored(z, mirrors) for z in vectors])
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    out *= np.where(out[np.arange(k), np.abs(out).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return values * size, out


class Whitening(NamedTuple):
    """What was fitted: the number of distinct vectors, their sums, components with their variances, and how good they are."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def varies(self) -> np.ndarray:
        return self.explained > NO_VARIANCE

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors; nan for components without variance."""
        scale = np.where(self.varies(), np.sqrt(np.where(self.varies(), self.values, 1.0)), np.nan)
        return ((x - self.mean) @ self.components.T) / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        largest = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if largest * largest * x.shape[1] < _LARGEST:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fitted(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", scale: float = SCALE) -> Whitening | None:
    """The whitening of `embeddings`; None without a vector that counts."""
    dim = common_length(embeddings, vector)
    if dim is None:
        return None
    fit = written(distinct_vectors(embeddings, vector, dim, scale), "distinct")
    n, sums = exact_sums(fit, dim)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    covariance = product_sums(fit, dim, dim, lambda x: x - mean) / n
    values, vectors = leading(covariance, components)
    trace = float(np.trace(covariance))
    found = Whitening(n, sums, vectors, values, np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values)), 0.0)
    of = np.flatnonzero(found.varies())
    if not len(of):
        return found
    # Projections of what is left after the mean have mean 0, so their products are their covariance.
    error = product_sums(fit, dim, len(of), lambda x: found.project(x)[:, of]) / n - np.eye(len(of))
    return found._replace(identity_error=float(np.abs(error).max()))


def whitened(embeddings: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """`key`, whitened (a number, or null, for each component) and deviation of each row whose vector counts."""
    kind = embeddings.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = whole_numbers(b.column(1), len(model.sums), scale)
            y = model.project(x)
            flat = pa.array(y.ravel(), from_pandas=True)  # nan is null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), lists, pa.array(model.deviation(x), pa.int64())], [key, "whitened", "deviation"])

    picked = embeddings.select(key, F.col(vector).cast("array<double>"))
    if model is None:
        return picked.limit(0).select(key, F.lit(None).cast("array<double>").alias("whitened"), F.lit(None).cast("long").alias("deviation"))
    return picked.mapInArrow(run, f"`{key}` {kind}, whitened array<double>, deviation long")


def op13_whitening(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fitted(rows)
    out = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [float(x) for x in model.explained] if model else [0.0]
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1)
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
