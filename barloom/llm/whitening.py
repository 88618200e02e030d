"""Embedding whitening by spectral divide and conquer over QDWH polar decompositions.

Entries become integers x = floor(256 c), so the moments of the distinct vectors are exact sums of integers that Spark adds up, and
the covariance is rounded once. Its leading eigenvectors come from the polar factor U of the covariance less a shift: (U + I) / 2
projects on the span of the eigenvectors beyond the shift, an orthonormal basis of that span and of its complement splits the matrix in two,
and the halves are split again until they are single vectors or a multiple of the identity. The d x d matrices are the only thing
on the driver, and the d x k whitening matrix the only thing broadcast; d is at most MAX_DIMENSION.

A vector that is null or has a null, non-finite or too large entry (2**54 or more) is left out. A shorter vector counts as
filled up with zeros to the longest one's length. Rows with equal ids, and null ids, stand on their own. A component without variance (fewer
distinct vectors than dimensions, or all alike) has explained 0 and whitened 0 for all rows; the identity error leaves it out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.cluster import ship, stored

SCALE = 256
COMPONENTS = 4
MAX_DIMENSION = 4096
_EPS = np.finfo(np.float64).eps
_MAX = (1 << 63) - 1


# ---- d x d linear algebra

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    norm = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    x = a / norm
    low = max(_EPS / 4, 1 / max(1.0, np.linalg.cond(x, 1)) / np.sqrt(n))  # at most the least singular value
    eye = np.eye(n)
    for _ in range(60):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        root = np.sqrt(1 + d)
        weight_a = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * root))) / 2
        weight_b = (weight_a - 1) ** 2 / 4
        weight_c = weight_a + weight_b - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(weight_c) * x, eye)))
        new = weight_b / weight_c * x + (weight_a - weight_b / weight_c) / np.sqrt(weight_c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (weight_a + weight_b * l2) / (1 + weight_c * l2))
        change = np.abs(new - x).max()
        x = new
        if abs(1 - low) < 10 * _EPS and change < np.cbrt(_EPS) / 10:
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of its complement: the columns of greatest norm first, then one
    more pass, which makes the range exact to rounding."""
    n = len(projector)
    left, chosen = projector.copy(), []
    for _ in range(rank):
        norms = np.einsum("ij,ij->j", left, left)
        k = int(norms.argmax())
        q = left[:, k] / np.sqrt(norms[k])
        chosen.append(k)
        left -= np.outer(q, q @ left)
    q, _ = np.linalg.qr(np.hstack((projector[:, chosen], np.eye(n))))
    start = projector @ q[:, :rank]
    q, _ = np.linalg.qr(np.hstack((start, q[:, rank:n])))
    return q[:, :rank], q[:, rank:n]


def leading_eigenvectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of the symmetric matrix ``a``, falling, and their unit eigenvectors as columns."""
    scale = max(np.abs(a).max(initial=0.0), np.finfo(np.float64).tiny)

    def split(m: np.ndarray, basis: np.ndarray, wanted: int) -> list[np.ndarray]:
        n = len(m)
        middle = np.trace(m) / n
        if n == 1 or np.linalg.norm(m - middle * np.eye(n)) <= 4 * n * _EPS * scale:
            return [basis[:, j] for j in range(min(n, wanted))]
        # The mean of the diagonal lies between the extreme eigenvalues; later shifts move off an eigenvalue that it hits.
        spread = np.linalg.norm(m - middle * np.eye(n)) / np.sqrt(n)
        for shift in (middle, *(middle + f * spread for f in (0.11, -0.11, 0.29, -0.29, 0.47, -0.47, 0.83, -0.83))):
            projector = (polar(m - shift * np.eye(n)) + np.eye(n)) / 2
            trace = np.trace(projector)
            rank = int(round(trace))
            if 0 < rank < n and abs(trace - rank) < 1e-6:
                high, low = _bases(projector, rank)
                if np.linalg.norm(low.T @ m @ high) <= 1e-10 * max(scale, np.linalg.norm(m)):
                    break
        else:
            raise ArithmeticError(f"no shift splits a block of {n}")
        out: list[np.ndarray] = []
        for side in (high, low):
            if len(out) < wanted:
                inner = side.T @ m @ side
                out += split((inner + inner.T) / 2, basis @ side, wanted - len(out))
        return out

    vectors = np.column_stack(split(a, np.eye(len(a)), min(k, len(a))))
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return np.maximum(values, 0), vectors * signs


# ---- vectors and moments

def _integers(vector: Column) -> Column:
    """floor(256 c) of the entries; null for a vector that is left out."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(1 << 54)))  # false for NaN, too
    return F.when(vector.isNotNull() & fits, scaled)


def _matrix(arrays: pa.Array, dimension: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    sizes = pc.list_value_length(arrays).to_numpy(zero_copy_only=False)
    out = np.zeros((len(arrays), dimension), np.int64)
    out[np.arange(dimension) < sizes[:, None]] = arrays.flatten().to_numpy(zero_copy_only=False)
    return out


def _slices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    step = max(1, (1 << 20) // max(1, dimension))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y in exact integers."""
    bound = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(1, len(x))
    if bound < 1 << 53:
        return (x.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
    if bound <= _MAX:
        return x.T @ y
    return x.astype(object).T @ y.astype(object)


def _summed(frame: DataFrame, fn, dimension: int, kind: str) -> dict[tuple[int, int], object]:
    """The matrices that fn makes of slices of integer rows, added up by Spark entry by entry; at most d * (d + 1) entries."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches, dimension):
            new = fn(_matrix(batch["x"], dimension))
            total = new if total is None else total + new
        if total is not None:
            i, j = np.indices(total.shape)
            upper = (i <= j).ravel()
            cells = [v if kind == "double" else str(v) for v in total.ravel()[upper].tolist()]
            for at in range(0, len(cells), 10_000):
                here = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(i.ravel()[upper][here], pa.int32()), pa.array(j.ravel()[upper][here], pa.int32()),
                    pa.array(cells[here], pa.float64() if kind == "double" else pa.string())], names=["i", "j", "v"])

    rows = frame.select("x").mapInArrow(parts, f"i int, j int, v {'double' if kind == 'double' else 'string'}") \
        .groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v")).toArrow()
    return {(i, j): v for i, j, v in zip(*(rows[c].to_pylist() for c in ("i", "j", "v")))}


def _square(cells: dict, size: int, dtype) -> np.ndarray:
    out = np.zeros((size, size), dtype)
    for (i, j), v in cells.items():
        out[i, j] = out[j, i] = v
    return out


class Whitening:
    """Fitted on distinct integer vectors: their number and sums, the covariance, eigenvalues, eigenvectors and identity error."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums, self.dimension = n, sums, len(sums)
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = leading_eigenvectors(covariance, components)
        self.live = self.values > len(sums) * _EPS * max(self.trace, np.finfo(np.float64).tiny)
        self.values = np.where(self.live, self.values, 0.0)
        self.matrix = self.vectors * np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1.0)), 0.0)
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        s = np.array(self.sums, object)
        if (int(np.abs(x).max(initial=0)) * self.n + int(np.abs(s).max(initial=0))) <= _MAX:
            return x * self.n - s.astype(np.int64)
        return x.astype(object) * self.n - s

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) / self.n @ self.matrix

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; none where one is beyond a long."""
        top = int(np.abs(centred).max(initial=0))
        if top * top * max(1, self.dimension) <= _MAX:
            return (centred * centred).sum(axis=1).tolist()
        totals = (centred.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v <= _MAX else None for v in totals]


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct integer vectors of a table; none if no row is left or all vectors are empty."""
    ship(vectors.sparkSession)
    distinct = stored(vectors.select(_integers(F.col(f"`{vector_col}`")).alias("x")).where("x IS NOT NULL").distinct(), "vectors")
    n, dimension = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not dimension:
        return None
    if dimension > MAX_DIMENSION:
        raise ValueError(f"vectors of {dimension} entries; at most {MAX_DIMENSION} make a covariance that fits in memory")

    def moments(x: np.ndarray) -> np.ndarray:
        # The first row and column hold the plain sums.
        return _products(np.hstack((np.ones((len(x), 1), np.int64), x)), np.hstack((np.ones((len(x), 1), np.int64), x)))

    cells = {k: int(v) for k, v in _summed(distinct, moments, dimension, "decimal(38,0)").items()}
    sums = [cells[0, j + 1] for j in range(dimension)]
    covariance = _square({(i - 1, j - 1): (n * v - sums[i - 1] * sums[j - 1]) / (n * n)
                          for (i, j), v in cells.items() if i}, dimension, np.float64)
    out = Whitening(n, sums, covariance, components)
    shared = vectors.sparkSession.sparkContext.broadcast(out)

    def whitened(x: np.ndarray) -> np.ndarray:
        w = shared.value.project(shared.value.centred(x))
        w = np.hstack((np.ones((len(w), 1)), w))
        return w.T @ w

    k = len(out.values)
    again = _square(_summed(distinct, whitened, dimension, "double"), k + 1, np.float64) / n
    error = np.abs(again[1:, 1:] - np.outer(again[0, 1:], again[0, 1:]) - np.eye(k))
    out.identity_error = float(error[np.ix_(out.live, out.live)].max(initial=0.0))
    shared.unpersist()
    return out


def whiten(vectors: DataFrame, fitted: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), _integers(F.col(f"`{vector_col}`")).alias("x")).where("x IS NOT NULL")
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for batch in _slices(batches, model.dimension):
            centred = model.centred(_matrix(batch["x"], model.dimension))
            whole = batch.num_rows
            by_row = np.repeat(np.arange(whole), k)
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(pa.array(by_row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), whole)),
                pa.array(np.full(whole * k, model.n)), pa.array(model.deviations(centred), pa.int64()).take(pa.array(by_row)),
                pa.array(model.project(centred).ravel()), pa.array(np.tile(explained, whole)),
                pa.array(np.full(whole * k, model.identity_error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)
