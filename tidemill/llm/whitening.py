"""Whitening of vectors by their leading principal components.

Each entry becomes a whole number. Sums, the covariance about the mean, and the check of the result are added up in tasks
over the distinct vectors; the driver sees matrices of the vectors' length only. There the covariance is brought to
tridiagonal form by Householder reflections, its largest eigenvalues are bisected by Sturm counts, and each eigenvector
comes by inverse iteration, made orthogonal within its cluster of near eigenvalues after every step, and is reflected
back. Mean and scaled components are broadcast (as many numbers as the length times the components) and every row is projected.

Defined results: a row whose vector is null, empty or holds a null or non-finite entry is left out; of several lengths the
most frequent is whitened (ties: the shorter), rows of others are left out; entries beyond 2**34 count as that; a component
of no variance (to double precision) is left out, so that a single vector, or copies of one, give no rows; repeated ids are
rows of their own and a null id is kept; a deviation beyond a long is the largest long; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.store import materialise, table

COMPONENTS, SCALE, SHIFT, WIDEST, NEAR = 16, 64, 1_000_000, float(1 << 34), 1e-3
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(df: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows that have a vector."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    number = lambda c: (F.floor(F.least(F.greatest(c, F.lit(-WIDEST)), F.lit(WIDEST)) * SCALE).cast("long") + SHIFT)
    return df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, number).alias("x"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b["x"]
    return x.flatten().to_numpy().reshape(len(x), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:  # a batch's sums fit a long: 2**14 rows of 2**41
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([_matrix(b).sum(0)])], ["n", "sums"])


class Centre(NamedTuple):
    """A mean as whole numbers and what is over, so that a centred value is exact but for its own rounding."""

    n: int
    sums: list[int]

    def of(self, x: np.ndarray) -> np.ndarray:
        base = np.array([s // self.n for s in self.sums])
        over = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - base) - over


def _products(shared):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's rows: sums and products of the centred (and projected) values, as one list."""
        centre, project = shared.value
        total = None
        for b in batches:
            if b.num_rows:
                y = centre.of(_matrix(b))
                y = y if project is None else y @ project
                y = np.hstack([y, np.ones((len(y), 1))])
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["sums"])

    return products


def covariance(fit: DataFrame, centre: Centre, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance, with divisor n, of the rows' centred values or of their projections."""
    shared = fit.sparkSession.sparkContext.broadcast((centre, project))
    sums = fit.mapInArrow(_products(shared), "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    flat = np.array([v for _, v in sorted(sums.collect())])
    total = flat.reshape(int(len(flat) ** 0.5), -1) / centre.n
    left = total[:-1, -1]  # what rounding has left of the mean
    out = total[:-1, :-1] - np.outer(left, left)
    return (out + out.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q for which q.T a q is tridiagonal, by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not np.any(v[1:]):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def sturm(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each of the places ``at``."""
    tiny = np.finfo(float).tiny
    q = diag[0] - at
    below = (q < 0).astype(int)
    for a, b in zip(diag[1:], off, strict=True):
        q = a - at - b * b / np.where(np.abs(q) < tiny, -tiny, q) if b else a - at
        below += q < 0
    return below


def leading(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected to the last bit that doubles tell apart."""
    d = len(diag)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    lo, hi = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max() + np.finfo(float).tiny)
    hi += np.abs(hi) * 1e-15
    rank = d - 1 - np.arange(k)  # so many eigenvalues are smaller
    for _ in range(2000):
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        more = sturm(diag, off, mid) > rank
        lo, hi = np.where(more, lo, mid), np.where(more, mid, hi)
    return lo + (hi - lo) / 2


def vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns: inverse iteration, kept orthogonal to those of near eigenvalues."""
    d, random = len(diag), np.random.default_rng(0)
    t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    norm = max(np.abs(t).sum(0).max(), np.finfo(float).tiny)
    out, first = np.zeros((d, len(values))), 0
    for i, e in enumerate(values):
        if i and values[i - 1] - e > NEAR * norm:
            first = i  # a cluster ends where neighbours are far apart
        near = out[:, first:i]
        z = random.standard_normal(d)
        shift = t - (e + 4 * np.finfo(float).eps * norm * (1 + i - first)) * np.eye(d)
        for _ in range(6):
            for _ in range(2):
                z = z - near @ (near.T @ z)
            z = z / np.linalg.norm(z)
            z = np.linalg.solve(shift, z)
            z = z / np.linalg.norm(z)
        for _ in range(2):
            z = z - near @ (near.T @ z)
        out[:, i] = z / np.linalg.norm(z)
    return out


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    diag, off, q = tridiagonal(v)
    values = leading(diag, off, min(most, len(v)))
    values = values[values > len(v) * 1e-14 * max(np.trace(v), 0)]
    out = q @ vectors(diag, off, values)
    return values, out * np.sign(out[np.abs(out).argmax(0), np.arange(len(values))])


class Whitener(NamedTuple):
    centre: Centre
    project: np.ndarray  # components over the roots of their eigenvalues, as columns
    explained: np.ndarray
    error: float

    def deviation(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sums of squares of n x - S, exactly."""
        n, most = self.centre.n, int(np.abs(x).max(initial=0)) * self.centre.n + max(map(abs, self.centre.sums))
        if most < 1 << 60 and len(self.centre.sums) * (int(np.abs(n * x - np.array(self.centre.sums)).max(initial=0)) + 1) ** 2 < 1 << 63:
            return ((n * x - np.array(self.centre.sums)) ** 2).sum(1)
        return [min(sum((n * int(c) - s) ** 2 for c, s in zip(row, self.centre.sums, strict=True)), (1 << 63) - 1) for row in x]


def fit(rows: DataFrame, dim: int, most: int = COMPONENTS) -> Whitener:
    """The whitening of the distinct vectors ``x`` of ``rows``, all of length ``dim``."""
    distinct = materialise(rows.select("x").distinct(), "fit")
    sums = distinct.mapInArrow(_sums, "n long, sums array<long>").select("n", F.posexplode("sums").alias("at", "s"))
    sums = sorted(sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    centre = Centre(sums[0]["n"], [int(r["s"]) for r in sums])
    v = covariance(distinct, centre)
    values, axes = components(v, most)
    project = axes / np.sqrt(values)
    error = np.abs(covariance(distinct, centre, project) - np.eye(len(values))).max() if len(values) else 0.0
    return Whitener(centre, project, values / np.trace(v) if len(values) else values, float(error))


def _project(shared):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitener = shared.value
        k, names = len(w.explained), [c.split()[0] for c in OUT.split(", ")]
        for b in batches:
            if b.num_rows and k:
                x = _matrix(b)
                white = w.centre.of(x) @ w.project
                every = lambda a: np.repeat(np.asarray(a), k)  # noqa: B023, E731
                ids = b["vec_id"].take(pa.array(every(np.arange(len(x)))))
                cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, w.centre.n)), pa.array(every(np.array(w.deviation(x), np.int64)))]
                cols += [pa.array(white.ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(x) * k, w.error))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return project


def whiten(df: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each of ``df`` (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    rows = whole_numbers(df)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], OUT)
    rows = rows.where(F.size("x") == length["d"])
    shared = spark.sparkContext.broadcast(fit(rows, length["d"], most))
    return rows.mapInArrow(_project(shared), OUT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
