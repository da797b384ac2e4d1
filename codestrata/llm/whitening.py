"""Whitening of embeddings: principal components of integer-scaled vectors, and rows projected on them with unit variance.

The fit reads the vectors twice.  The first pass sums each dimension exactly; the second adds up the scatter of the
centred vectors.  Each task reduces its own rows to one matrix, whose entries Spark sums by (row, column), so what moves
is one matrix for each task and what reaches the driver is one matrix of dimensions x dimensions, whatever the number
of vectors.  There the scatter is factored by pivoted Cholesky and the triangular factor is made orthogonal by one-sided
Jacobi rotations: its column norms give the eigenvalues and its normalised columns the components.  A third pass measures
the covariance of the whitened rows, a last one writes them.

Defined results
* A null vector, or one with a null, NaN or infinite entry, is left out.  The longest vector sets the number of
  dimensions; a shorter one lacks entries, which count as null.  An entry whose scaled value lies beyond 2^53 counts as
  not finite, since it is no exact integer any more.
* Repeated rows count and are returned once each; a null id is an id.  Equal eigenvalues: their order is the one that
  the rotations give, the same for all rows.  Only components with an eigenvalue above the factorisation's rounding are
  returned, so a table with fewer independent vectors than components, a single vector or no vector gives fewer or none.
* deviation is exact; a value that no long can hold is null.
* Memory: a task holds one batch of vectors and one matrix of dimensions x dimensions doubles.  Text columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import map_batches, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LIMIT = float(1 << 53)
ROWS = 4096  # rows of a matrix product


def scaled(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The long vectors of the usable rows, and where they stand in the column."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    place = np.flatnonzero(lengths == dims)
    if dims <= 0 or not len(place):
        return np.zeros((0, max(dims, 0)), np.int64), place[:0]
    flat = column.take(pa.array(place)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * values)
        good = (np.abs(x) < LIMIT).all(1)  # false for NaN and infinity
    return x[good].astype(np.int64) + OFFSET, place[good]


def vectors(rows: DataFrame, vector: str) -> DataFrame:
    return rows.select(rows[vector].alias("v"))


def dimensions(rows: DataFrame, vector: str) -> int:
    found = vectors(rows, vector).agg(F.max(F.size("v"))).first()[0]
    return max(int(found or 0), 0)


def exact_sums(x: np.ndarray) -> list[int]:
    if not len(x) or int(np.abs(x).max()) < (1 << 62) // len(x):
        return [int(s) for s in x.sum(0)]
    return [sum(c) for c in x.T.tolist()]


def sums(rows: DataFrame, vector: str, dims: int) -> tuple[int, list[int]]:
    """The number of usable vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x, _ = scaled(batch["v"], dims)
            n += len(x)
            total = [a + b for a, b in zip(total, exact_sums(x))]
        if n:
            # two halves keep the sums exact: Spark adds them up as decimals
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                    pa.array([s >> 32 for s in total], pa.int64()), pa.array([s & 0xFFFFFFFF for s in total], pa.int64()),
                ],
                ["i", "n", "high", "low"],
            )

    parts = map_batches(vectors(rows, vector), run, "i int, n long, high long, low long")
    added = parts.groupBy("i").agg(F.sum("n"), *(F.sum(F.col(c).cast("decimal(20,0)")) for c in ("high", "low")))
    found = sorted(added.collect())  # one row for each dimension
    return (found[0][1], [(int(h) << 32) + int(low) for _, _, h, low in found]) if found else (0, [0] * dims)


@dataclass(frozen=True)
class Mean:
    """The exact mean S/n, as whole numbers and what remains of them."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n without the loss that large values have: whole numbers first."""
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exact."""
        z, rest = x - self.whole, np.array([s % self.n for s in self.sums], np.int64)
        most = (int(np.abs(z).max()) + 1) * self.n if len(z) else 0
        if most * most * max(len(self.sums), 1) < 1 << 63:
            return ((self.n * z - rest) ** 2).sum(1).tolist()
        return [sum((self.n * a - r) ** 2 for a, r in zip(row, rest.tolist())) for row in z.tolist()]


def scatter(rows: DataFrame, vector: str, dims: int, width: int, project, mean_of=None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of y and of y y^T over the usable vectors, where y = project(x) has `width` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            x, _ = scaled(batch["v"], dims)
            n += len(x)
            for a in range(0, len(x), ROWS):
                y = project(x[a : a + ROWS])
                if mean_of is not None:
                    y = y - mean_of
                total += y.sum(0)
                product += y.T @ y
        if n:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, np.arange(width)), pa.int32()),
                 pa.array(np.append(j, np.full(width, -1)), pa.int32()),
                 pa.array(np.append(product[i, j], total))],
                ["i", "j", "s"],
            )

    parts = map_batches(vectors(rows, vector), run, "i int, j int, s double")
    found = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()  # width * (width + 1) / 2 + width rows
    total, product = np.zeros(width), np.zeros((width, width))
    one = found["j"].to_numpy() < 0
    i, j, s = (found[c].to_numpy() for c in "ijs")
    total[i[one]] = s[one]
    product[i[~one], j[~one]] = s[~one]
    product[j[~one], i[~one]] = s[~one]
    return total, product


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L^T, up to a permutation of rows that is undone: the largest remaining diagonal is taken first.

    Stops where what remains is rounding, so L has as many columns as a has rank.
    """
    a = a.copy()
    d = len(a)
    least = d * np.finfo(float).eps * max(float(a.diagonal().max(initial=0.0)), 0.0)
    columns, rest = [], a.diagonal().copy()
    for _ in range(d):
        p = int(np.argmax(rest))
        if rest[p] <= least:
            break
        column = a[:, p] - (np.stack(columns, 1) @ np.array([c[p] for c in columns]) if columns else 0.0)
        column[[c for c in range(d) if rest[c] < 0]] = 0.0  # pivots of before have nothing left
        column = column / np.sqrt(column[p])
        columns.append(column)
        rest = rest - column**2
        rest[p] = -1.0
        rest[(rest < 0) & (rest > -0.5)] = 0.0
    return np.stack(columns, 1) if columns else np.zeros((d, 0))


def rounds(k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of k columns in rounds of disjoint pairs."""
    ring = list(range(k + k % 2))
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], ring[::-1]) if max(a, b) < k]
        if pairs:
            yield tuple(np.array(pairs).T)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(l: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components) of l l^T: rotations make the columns of l orthogonal."""
    u = l[:, np.argsort(-(l**2).sum(0), kind="stable")].copy()
    for _ in range(sweeps):
        turned = False
        for p, q in rounds(u.shape[1]):
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            p, q, a, b, aa, bb, ab = p[turn], q[turn], a[:, turn], b[:, turn], aa[turn], bb[turn], ab[turn]
            zeta = (bb - aa) / (2 * ab)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            u[:, p], u[:, q] = c * a - s * b, s * a + c * b
        if not turned:
            break
    e = (u**2).sum(0)
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order] / np.sqrt(np.where(e[order] > 0, e[order], 1.0))


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: the mean, eigenvalues and components of the covariance, and how well it whitens its fit list."""

    dims: int
    mean: Mean | None
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """The first components of the covariance of all usable vectors, with the measured covariance of whitened rows."""
    dims = dimensions(rows, vector)
    n, total = sums(rows, vector, dims) if dims else (0, [])
    if not n:
        return Whitening(dims, None, np.zeros(0), np.zeros((dims, 0)), 0.0)
    mean = Mean(n, tuple(total))
    left, product = scatter(rows, vector, dims, dims, mean.centred)
    v = product / n
    values, components = one_sided_jacobi(pivoted_cholesky(v))
    model = Whitening(dims, mean, values[:most], components[:, :most], float(v.trace()))
    width = len(model.values)
    if not width:
        return model
    centre = (left / n) @ model.components / np.sqrt(model.values)
    _, product = scatter(rows, vector, dims, width, model.project, centre)
    error = float(np.abs(product / n - np.eye(width)).max())
    return Whitening(dims, mean, model.values, model.components, model.trace, error)


def whitened(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, deviation, whitened array<double>): one row for each usable vector."""
    kept = rows.select(rows[id_col].alias("id"), rows[vector].alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, place = scaled(batch["v"], model.dims) if model.mean else (None, np.zeros(0, np.int64))
            if not len(place):
                continue
            y = model.project(x)
            far = [d if d < 1 << 63 else None for d in model.mean.deviations(x)]
            at = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(place)), pa.array(far, pa.int64()), pa.ListArray.from_arrays(at, pa.array(y.ravel()))],
                ["id", "deviation", "whitened"],
            )

    kind = kept.schema["id"].dataType.simpleString()
    return map_batches(kept, run, f"id {kind}, deviation long, whitened array<double>")


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    model = fit(rows)
    explained = [float(e / model.trace) for e in model.values]
    shares = F.array(*(F.lit(e) for e in explained)) if explained else F.array().cast("array<double>")
    found = whitened(rows, model).select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return found.select(
        F.col("id").alias("vec_id"),
        (F.col("place") + 1).alias("component"),
        F.lit(model.mean.n if model.mean else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
