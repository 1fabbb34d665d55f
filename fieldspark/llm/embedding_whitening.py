"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries c become integers x = floor(64 c) + 1000000. Each different vector x counts once: n of them, with sums S by
dimension. Tasks add up exact products, which give the integer scatter M = n * sum(x x') - S S', n^2 times the
covariance. Its characteristic polynomial is found modulo primes, a task taking some primes, and put together;
its largest roots are isolated and refined, and tasks find the eigenvector of each (see ``exact_eigen``). Rows are
then centred exactly, as n x - S, and projected. The driver holds a matrix of one row a dimension.

Defined results: rows with a null vector, or with null or non-finite entries, are dropped, and so are those with an
entry of 2^56 or more (x would not fit a long), those of no dimension, and those whose length differs from the
commonest one (of several the longest). Components are only those with a positive eigenvalue, so copies of one
vector give no rows, nor does an empty table. A null vec_id is allowed; rows that repeat one have a result each. A
deviation beyond a long is null. Of equal eigenvalues the eigenvectors are some orthonormal ones. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored
from .exact_eigen import coefficient_bits, largest_roots, polynomial_mod, primes, remaindered, vectors

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows multiplied at a time, and entries up to which their products are exact in double precision.
ROWS, EXACT = 4096, 1 << 20
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(df: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain."""
    fine = F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < float(1 << 56), F.lit(False)))
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(fine & (F.size("v") > 0))
    x = stored(x.select("vec_id", F.transform("v", lambda c: F.floor(SCALE * c) + SHIFT).alias("x")), "integers")
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    return x.where(F.size("x") == (sizes.d if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) - SHIFT


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, numbers): row i of the exact sum of z z' over a task's vectors z = (1, x - SHIFT)."""
    total = None
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            y = _matrix(batch.column(0).slice(k, ROWS))
            z = np.c_[np.ones(len(y), np.int64), y]
            z = z.astype(np.float64 if np.abs(y).max() < EXACT else object)
            own = z.T @ z
            own = own.astype(np.int64).astype(object) if own.dtype != object else own
            total = own if total is None else total + own
    if total is not None:
        yield _text_rows(dict(enumerate(total)))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.array([int(v) for v in text.split()], object)
            sums[i] = sums[i] + own if i in sums else own
    yield _text_rows(sums)


def _text_rows(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([" ".join(map(str, r)) for r in rows.values()], pa.string())], names=["i", "numbers"])


def scatter(fit: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and the integer scatter of the vectors x - SHIFT of ``fit``."""
    ddl = "i int, numbers string"
    added = fit.select("x").mapInArrow(_products, ddl).repartition(min(d + 1, 64), "i").mapInArrow(_added, ddl)
    all_ = np.array([[int(v) for v in r.numbers.split()] for r in sorted(added.collect())], object)
    n, sums = int(all_[0, 0]), all_[0, 1:]
    return n, sums, n * all_[1:, 1:] - sums[:, None] * sums


def components(spark: SparkSession, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Square roots of the k largest positive eigenvalues, their shares of the trace, and eigenvectors as columns."""
    trace = int(np.trace(m))
    if not trace:
        return np.empty(0), np.empty(0), np.empty((len(m), 0))
    sent = spark.sparkContext.broadcast(m)  # one row a dimension

    def polynomials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_mod(sent.value, p)], pa.list_(pa.int64()))], names=["p", "residues"])

    own = primes(coefficient_bits(trace, len(m)))
    tasks = spark.createDataFrame([(p,) for p in own], "p long").repartition(min(len(own), 1000))
    found = {r.p: np.array(r.residues, np.int64) for r in tasks.mapInArrow(polynomials, "p long, residues array<long>").collect()}
    roots = largest_roots(remaindered(found), k)

    def eigenvectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                v = vectors(sent.value, roots[i])
                yield pa.RecordBatch.from_arrays([pa.array([i] * v.shape[1]), pa.array(np.arange(v.shape[1])), pa.array(list(v.T), pa.list_(pa.float64()))], names=["i", "j", "v"])

    got = spark.range(0, len(roots), 1, max(1, len(roots))).mapInArrow(eigenvectors, "i long, j long, v array<double>").orderBy("i", "j").limit(k).collect()
    values = [Fraction(roots[r.i].low + roots[r.i].high, 1 << (roots[r.i].shift + 1)) for r in got]
    return np.sqrt([float(v) for v in values]), np.array([float(v / trace) for v in values]), np.array([r.v for r in got]).T


class Whitening:
    """What every row needs: n, sums of x - SHIFT, eigenvectors and square roots of the scatter's eigenvalues."""

    def __init__(self, n: int, sums: np.ndarray, roots: np.ndarray, shares: np.ndarray, basis: np.ndarray):
        self.n, self.sums, self.roots, self.shares, self.basis = n, sums, roots, shares, basis

    def rows(self, column: pa.Array) -> tuple[list, np.ndarray]:
        """Deviations and whitened values of a column of vectors x."""
        y = _matrix(column)
        most = self.n * int(np.abs(y).max()) + max(abs(int(s)) for s in self.sums) if y.size else 0
        if most * most * y.shape[1] < 1 << 63:
            c = self.n * y - self.sums.astype(np.int64)
            deviation = (c * c).sum(axis=1).tolist()
        else:
            c = self.n * y.astype(object) - self.sums
            deviation = [v if v < 1 << 63 else None for v in (c * c).sum(axis=1)]
        return deviation, c.astype(np.float64) @ self.basis / self.roots


def identity_error(fit: DataFrame, sent) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                w = sent.value.rows(batch.column(0).slice(k, ROWS))[1]
                z = np.c_[np.ones(len(w)), w]
                total = total + z.T @ z
        if not np.isscalar(total):
            i, j = np.divmod(np.arange(total.size), len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = {(r.i, r.j): r.s for r in fit.select("x").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    k = len(sent.value.roots)
    z = np.array([[sums[i, j] for j in range(k + 1)] for i in range(k + 1)]) / sums[0, 0]
    return float(np.abs(z[1:, 1:] - np.outer(z[0, 1:], z[0, 1:]) - np.eye(k)).max())


def whiten(df: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, for up to k components."""
    spark = df.sparkSession
    x = integers(df)
    first = x.select(F.size("x").alias("d")).first()
    if not first:
        return spark.createDataFrame([], OUT)
    fit = stored(x.select("x").distinct(), "vectors")
    n, sums, m = scatter(fit, first.d)
    roots, shares, basis = components(spark, m, k)
    if not len(roots):
        return spark.createDataFrame([], OUT)
    sent = spark.sparkContext.broadcast(Whitening(n, sums, roots, shares, basis))
    error = identity_error(fit, sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(a, ROWS)
                deviation, white = w.rows(batch.column(1).slice(a, ROWS))
                rows, c = white.shape
                at = np.repeat(np.arange(rows), c)
                arrays = [ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), rows)), pa.array(np.full(rows * c, w.n)), pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(white.ravel()), pa.array(np.tile(w.shares, rows)), pa.array(np.full(rows * c, error))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        release()

    return x.mapInArrow(run, OUT)
