"""Covariances, empirical orthogonal functions and projections.

A field becomes rows of numbers along its shorter side, placed by the order of that side's keys and checked: every
row must have a value for every key, each once, or ValueError says so (``spatial.compress`` or ``densify`` first).
Sums of products run in tasks, block by block, and are added up in stripes, or tile by tile where a whole matrix is too
much for a task; the driver sees matrices of the shorter side by the number of modes, whose size is bounded, and cells
and times beyond it stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import small_batches, stored

#: Largest side of a square matrix that comes to the driver, and most numbers of any (8 bytes each).
MOST, MOST_NUMBERS = 4000, 1 << 26
#: Rows of a matrix that travel together.
STRIPE = 512
#: Shorter sides up to this are solved by their whole Gram matrix.
EXACT = 1500
#: Features up to which a task holds a whole matrix of products, and the side of a tile beyond.
WHOLE, SIDE = 2048, 1024


@dataclass
class Rows:
    """A field as a table (key, x): ``x`` holds a value for each of ``names``, in their order."""

    table: DataFrame
    names: np.ndarray
    n: int


def rows_of(field: DataFrame, key: str = "t", name: str = "cell") -> Rows:
    """Rows by ``key`` along the values of ``name``."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(name).alias("k"), F.col("value").cast("double").alias("v"))))
    made = field.groupBy(key).agg(pairs.alias("p")).select(F.col(key).alias("key"), F.transform("p", lambda p: p["v"]).alias("x"), F.xxhash64(F.transform("p", lambda p: p["k"])).alias("h"), F.transform("p", lambda p: p["k"]).alias("k"), F.size("p").alias("n"), (F.exists("p", lambda p: p["v"].isNull() | F.isnan(p["v"])) | (F.size(F.array_distinct(F.transform("p", lambda p: p["k"]))) < F.size("p"))).alias("bad"))
    made = stored(made, "rows")
    got = made.agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("bad").alias("bad"), F.max("n").alias("m"), F.count("*").alias("n")).first()
    if not got.n:
        return Rows(made.select("key", "x"), np.zeros(0, np.int64), 0)
    if got.a != got.b or got.bad:
        raise ValueError(f"every {key} needs one value for every {name}: compress or fill the field first")
    if got.m > MOST_NUMBERS:
        raise ValueError(f"{got.m} values of {name} are too many for a row")
    names = made.select("k").first().k  # those of any row
    return Rows(made.select("key", "x"), np.array(names, np.int64), got.n)


def matrix_of(column: pa.Array) -> np.ndarray:
    """List rows of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def block_sum(table: DataFrame, product, shape: tuple[int, int]) -> DataFrame:
    """(stripe, block): the sum over batches of a matrix product, in stripes of rows as bytes.

    product: makes a matrix of ``shape`` of a batch. Each task adds up its own and sends its stripes.
    """
    if shape[0] * shape[1] > MOST_NUMBERS:
        raise ValueError(f"a matrix of {shape[0]} by {shape[1]} is too large for a task")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = product(batch)
                total = own if total is None else np.add(total, own, out=total)
        if total is not None:
            for k in range(0, len(total), STRIPE):
                yield pa.RecordBatch.from_arrays([pa.array([k // STRIPE], pa.int32()), pa.array([np.ascontiguousarray(total[k : k + STRIPE]).tobytes()], pa.binary())], names=["stripe", "block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(block.as_buffer(), np.float64)
                sums[stripe] = own.copy() if stripe not in sums else np.add(sums[stripe], own, out=sums[stripe])
        for stripe, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["stripe", "block"])

    ddl, stripes = "stripe int, block binary", -(-shape[0] // STRIPE)
    return table.mapInArrow(part, ddl).repartition(stripes, "stripe").mapInArrow(add, ddl)


def collected(blocks: DataFrame, shape: tuple[int, int], width: int | None = None) -> np.ndarray:
    """Driver copy of a block sum, whose size ``block_sum`` has checked. width: numbers in a row of what was multiplied."""
    out = np.zeros(shape)
    with small_batches(blocks.sparkSession, shape[1] if width is None else width):
        for r in blocks.collect():
            own = np.frombuffer(r.block, np.float64).reshape(-1, shape[1])
            out[r.stripe * STRIPE : r.stripe * STRIPE + len(own)] = own
    return out


def _entries(blocks: DataFrame, width: int, rows: np.ndarray | None = None, columns: np.ndarray | None = None) -> DataFrame:
    """(i, j, s) of a block sum, with the numbers or the names of rows and columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(block.as_buffer(), np.float64)
                i, j = np.divmod(np.arange(len(own)), width)
                i = i + stripe * STRIPE
                yield pa.RecordBatch.from_arrays([pa.array(i if rows is None else rows[i]), pa.array(j if columns is None else columns[j]), pa.array(own)], names=["i", "j", "s"])

    return blocks.mapInArrow(run, "i long, j long, s double")


def _tiles(table: DataFrame, m: int, symmetric: bool, side: int) -> DataFrame:
    """(i, j, s) of sums of products of two list columns (x, y) of m numbers: s = sum over rows of x_i y_j, tile by tile.

    A task cuts its rows into stripes of ``side`` numbers and sends those of a tile together, some rows at a time; a
    tile's task adds up its products. No task holds more than a tile and a batch. With ``symmetric`` (y is x) the
    tiles under the diagonal are those above it.
    """
    n = -(-m // side)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = matrix_of(batch.column(0)), matrix_of(batch.column(1))
                left = [np.ascontiguousarray(x[:, k * side : (k + 1) * side]).tobytes() for k in range(n)]
                right = [np.ascontiguousarray(y[:, k * side : (k + 1) * side]).tobytes() for k in range(n)]
                for i in range(n):
                    js = range(i if symmetric else 0, n)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(js), pa.int32()), pa.array(js, pa.int32()), pa.array([len(x)] * len(js), pa.int32()), pa.array([left[i]] * len(js), pa.binary()), pa.array([right[j] for j in js], pa.binary())], names=["i", "j", "rows", "x", "y"])

    def rows(i: int, j: int, tile: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b, own in ((i, j, tile), (j, i, tile.T))[: 1 + (symmetric and i != j)]:
            for k in range(0, len(own), 256):
                part = own[k : k + 256]
                p, q = np.divmod(np.arange(part.size), part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(p + a * side + k), pa.array(q + b * side), pa.array(part.ravel())], names=["i", "j", "s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, count = (batch.column(c)[k].as_py() for c in range(3))
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.float64).reshape(count, -1) for c in (3, 4))
                if (i, j) != at:
                    if at:
                        yield from rows(*at, tile)
                    at, tile = (i, j), np.zeros((x.shape[1], y.shape[1]))
                tile += x.T @ y
        if at:
            yield from rows(*at, tile)

    with small_batches(table.sparkSession, 2 * m):
        sent = table.mapInArrow(cut, "i int, j int, rows int, x binary, y binary")
        return stored(sent.repartition(n * (n + 1) // 2 if symmetric else n * n, "i", "j").sortWithinPartitions("i", "j").mapInArrow(add, "i long, j long, s double"), "tiles")


def gram(field: DataFrame, sample: str = "t", feature: str = "cell", whole: int = WHOLE, side: int = SIDE) -> DataFrame:
    """(i, j, s): sum over samples of x_i * x_j for features i, j, numbered in their order.

    Up to ``whole`` features a task adds up the matrix itself; beyond that it goes by tiles of ``side``.
    """
    r = rows_of(field, sample, feature)
    m = len(r.names)
    if m > whole:
        return _tiles(r.table.select("x", F.col("x").alias("y")), m, True, side)
    with small_batches(field.sparkSession, m):
        blocks = stored(block_sum(r.table, lambda b: (x := matrix_of(b.column(1))).T @ x, (m, m)), "gram")
    return _entries(blocks, max(m, 1))


def paired(r: Rows, lag: int) -> DataFrame:
    """(key, x, y): rows t with those at t + lag, where both are."""
    later = r.table.select((F.col("key") - lag).alias("key"), F.col("x").alias("y"))
    return r.table.join(later, "key").select("key", "x", "y")


def lag_covariance(field: DataFrame, lag: int, feature: str = "cell", whole: int = WHOLE, side: int = SIDE) -> DataFrame:
    """(i, j, s): sum over t of x_i(t + lag) * x_j(t), for samples that have both; by tiles as ``gram``."""
    r = rows_of(field, "t", feature)
    m = len(r.names)
    if m > whole:
        own = _tiles(paired(r, lag).select("y", "x"), m, False, side)
        names = field.sparkSession.sparkContext.broadcast(r.names)  # one row of the field

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(names.value[b.column(0).to_numpy()]), pa.array(names.value[b.column(1).to_numpy()]), b.column(2)], names=["i", "j", "s"])

        return own.mapInArrow(named, "i long, j long, s double")
    with small_batches(field.sparkSession, 2 * m):
        blocks = stored(block_sum(paired(r, lag), lambda b: matrix_of(b.column(2)).T @ matrix_of(b.column(1)), (m, m)), "covariance")
    return _entries(blocks, max(m, 1), r.names, r.names)


def to_coo(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """A driver matrix as (i, j, re, im)."""
    m = np.asarray(m)
    i, j = np.indices(m.shape, np.int32)
    return spark.createDataFrame(pa.table({"i": i.ravel(), "j": j.ravel(), "re": np.real(m).ravel().astype(float), "im": np.imag(m).ravel().astype(float)})) if m.size else spark.createDataFrame([], "i int, j int, re double, im double")


def canonical(vectors_: np.ndarray) -> np.ndarray:
    """Columns with the sign that makes their largest entry (the first on ties) positive."""
    big = np.abs(vectors_).argmax(axis=0)
    return vectors_ * np.where(vectors_[big, np.arange(vectors_.shape[1])] < 0, -1, 1)


def _leading(r: Rows, k: int, exact: int = EXACT, over: int = 30, passes: int = 300, tolerance: float = 1e-8, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the Gram matrix along the row, and their vectors as columns.

    Up to ``exact`` names the matrix itself is solved. Beyond that a basis grows by blocks of residuals, each multiplied
    by the matrix in the tasks, a batch of rows at a time, and starts again from its best k + ``over`` directions
    where it is full (block Krylov with thick restarts). It ends when no residual of the k pairs exceeds ``tolerance``
    of the largest value; ValueError where ``passes`` over the rows do not get there.
    """
    m = len(r.names)
    k = min(k, m)
    if m <= exact:
        values, vectors = np.linalg.eigh(collected(block_sum(r.table, lambda b: (x := matrix_of(b.column(1))).T @ x, (m, m)), (m, m)))
        return np.maximum(values[::-1][:k], 0), vectors[:, ::-1][:, :k]
    keep = min(k + over, m)
    most = min(m, max(2 * keep, keep + 200))
    if m * most > MOST_NUMBERS:
        raise ValueError(f"{k} modes of {m} values are too many for the driver")

    def times(q: np.ndarray) -> np.ndarray:
        sent = r.table.sparkSession.sparkContext.broadcast(q)  # of checked size
        z = collected(block_sum(r.table, lambda b: (x := matrix_of(b.column(1))).T @ (x @ sent.value), (m, q.shape[1])), (m, q.shape[1]), m)
        sent.destroy()
        return z

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, keep)))[0]
    image = times(basis)
    for _ in range(passes):
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
        ahead = turn[:, :keep]
        rest = image @ ahead - (basis @ ahead) * values[:keep]
        size = np.linalg.norm(rest, axis=0)
        if size[:k].max() <= tolerance * max(values[0], 1e-300) or basis.shape[1] == m:
            return values[:k], basis @ turn[:, :k]
        open_ = np.flatnonzero(size > tolerance * values[0])
        if basis.shape[1] + len(open_) > most:
            basis, image = basis @ ahead, image @ ahead
        new = rest[:, open_][:, : most - basis.shape[1]] / size[open_][: most - basis.shape[1]]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
            new, scale = np.linalg.qr(new)
            new = new[:, np.abs(np.diag(scale)) > 1e-10 * max(1e-300, np.abs(np.diag(scale)).max())]
        basis, image = np.c_[basis, new], np.c_[image, times(new)]
    raise ValueError(f"{passes} passes do not settle {k} modes: the largest residual is {size[:k].max() / values[0]:.1e} of the first value")


def _of_names(spark: SparkSession, names: np.ndarray, m: np.ndarray, key: str) -> DataFrame:
    """(key, mode, loading) of a driver matrix whose rows are ``names``; the tasks make the rows."""
    sent = spark.sparkContext.broadcast((names, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = sent.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            for a in range(0, len(own), max(1, 100_000 // max(m.shape[1], 1))):
                at = own[a : a + max(1, 100_000 // max(m.shape[1], 1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at], m.shape[1])), pa.array(np.tile(np.arange(m.shape[1], dtype=np.int32), len(at))), pa.array(m[at].ravel())], names=[key, "mode", "loading"])

    return spark.range(0, len(names), 1, max(1, m.size // 1_000_000)).mapInArrow(run, f"{key} long, mode int, loading double")


def _times(r: Rows, m: np.ndarray, key: str) -> DataFrame:
    """(key, mode, loading): each row times a driver matrix."""
    sent = r.table.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = matrix_of(batch.column(1)) @ sent.value
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), y.shape[1])), pa.array(np.tile(np.arange(y.shape[1], dtype=np.int32), len(y))), pa.array(y.ravel())], names=[key, "mode", "loading"])

    return r.table.mapInArrow(run, f"{key} long, mode int, loading double")


def total_variance(r: Rows, key_is_sample: bool) -> float:
    """Sum over cells of their sample variance, in one pass over the rows."""
    if key_is_sample:
        got = block_sum(r.table, lambda b: np.stack([(x := matrix_of(b.column(1))).sum(0), (x * x).sum(0), np.full(x.shape[1], float(len(x)))]), (3, len(r.names)))
        s, q, n = collected(got, (3, len(r.names)))
        return float(np.sum(np.maximum(q - s * s / n, 0) / np.maximum(n - 1, 1)))
    if len(r.names) < 2:
        return 0.0
    got = block_sum(r.table, lambda b: np.array([[matrix_of(b.column(1)).var(axis=1, ddof=1).sum()]]), (1, 1))
    return float(collected(got, (1, 1), len(r.names))[0, 0])


def eof(field: DataFrame, k: int, exact: int = EXACT) -> tuple[DataFrame, DataFrame]:
    """Basis (cell, mode, loading) and statistics (mode, sval, eigval, var_expl) of an uncentred field.

    The shorter of times and cells is solved for; the loadings of a field with more cells than times are products
    of its rows with the solution and stay distributed. Modes without variance (beyond the rank) have loadings of
    an arbitrary orthonormal completion where cells are the shorter side, and are left out otherwise.
    """
    spark = field.sparkSession
    field = stored(field.select(F.col("t").cast("long").alias("t"), F.col("cell").cast("long").alias("cell"), F.col("value").cast("double").alias("value")), "field")
    size = field.agg(F.countDistinct("t").alias("nt"), F.countDistinct("cell").alias("nc")).first()
    wide = size.nc > size.nt
    r = rows_of(field, "cell", "t") if wide else rows_of(field, "t", "cell")
    values, basis = _leading(r, k, exact)
    total = total_variance(r, not wide)
    if wide:
        some = values > (values[:1] * 1e-14 if len(values) else 0)
        values = values[some]
        with small_batches(spark, len(r.names)):
            loadings = stored(_times(r, basis[:, some] / np.sqrt(values), "cell"), "loadings")
        loadings = _signed(loadings)
    else:
        loadings = _of_names(spark, r.names, canonical(basis), "cell")
    nt = size.nt
    stats = spark.createDataFrame([(m, float(np.sqrt(v)), float(v / nt), float(v / nt / total) if total else None) for m, v in enumerate(values)], "mode int, sval double, eigval double, var_expl double")
    return loadings, stats


def _signed(loadings: DataFrame) -> DataFrame:
    """The sign that makes the largest loading of each mode (of the first cell on ties) positive."""
    big = loadings.groupBy("mode").agg(F.max_by(F.signum("loading"), F.struct(F.abs("loading").alias("a"), (-F.col("cell")).alias("c"))).alias("__s"))
    return loadings.join(F.broadcast(big), "mode").select("cell", "mode", F.when(F.col("__s") < 0, -F.col("loading")).otherwise(F.col("loading")).alias("loading"))  # a row a mode


def eof_randomized(field: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """As eof, by a subspace also where the whole Gram matrix would be small."""
    return eof(field, k, exact=0)


def project(field: DataFrame, loadings: DataFrame) -> DataFrame:
    """Principal components (t, mode, value) of a field in a basis."""
    return field.join(loadings, "cell").groupBy("t", "mode").agg(F.sum(F.col("value") * F.col("loading")).alias("value"))


def project_checked(field: DataFrame, loadings: DataFrame) -> DataFrame:
    """As project; cells that only one side has raise ValueError."""
    a, b = field.select("cell").distinct(), loadings.select("cell").distinct()
    if a.join(b, "cell", "left_anti").union(b.join(a, "cell", "left_anti")).limit(1).count():
        raise ValueError("field and basis have different cells")
    return project(field, loadings)


def reconstruct(pcs: DataFrame, loadings: DataFrame) -> DataFrame:
    """Back from modes to cells."""
    return pcs.join(loadings, "mode").groupBy("t", "cell").agg(F.sum(F.col("value") * F.col("loading")).alias("value"))


def chain(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """A basis over modes of a basis over cells: (cell, mode, loading) of the product."""
    left = outer.withColumnRenamed("mode", "__k").withColumnRenamed("loading", "__a")
    right = inner.select(F.col("cell").alias("__k"), "mode", "loading")
    return left.join(right, "__k").groupBy("cell", "mode").agg(F.sum(F.col("__a") * F.col("loading")).alias("loading"))


def scalar_factor(loadings: DataFrame, weights: DataFrame) -> DataFrame:
    """(mode, factor) for weights (cell, w): an index of the field becomes a short sum over modes."""
    return loadings.join(weights, "cell").groupBy("mode").agg((F.sum(F.col("loading") * F.col("w")) / F.sum("w")).alias("factor"))


def scalar_index(pcs: DataFrame, factor: DataFrame) -> DataFrame:
    return pcs.join(factor, "mode").groupBy("t").agg(F.sum(F.col("value") * F.col("factor")).alias("value"))


def eof_bulk(weighted: dict[str, DataFrame], plain: dict[str, DataFrame], k: int, bases: dict[str, DataFrame] | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each variable its basis and the principal components of its plain field in it.

    The basis is that of the weighted field, or the one in ``bases`` (another experiment's), whose cells must be the same.
    """
    out = {}
    for name, field in weighted.items():
        loadings = bases[name] if bases else eof(field, k)[0]
        out[name] = (loadings, project_checked(plain[name], loadings))
    return out
