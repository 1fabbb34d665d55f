"""Spherical harmonics: analysis, synthesis and regridding of fields on grids of latitudes by longitudes.

f(lat, lon) = sum over m from -T to T, n from |m| to T of c(n, m) P(n, m; sin lat) exp(i m lon), with associated Legendre
functions of norm one on the sphere (no factor (-1)^m) and c(n, -m) the conjugate of c(n, m), so only m >= 0 is kept.
A time is a row: a Fourier transform along each latitude, then for each m a quadrature along the latitudes. Rows
need nothing of each other, so a field of any length takes one pass; the tables of Legendre functions, latitudes by
degrees for each m, are made in the tasks from the latitudes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import MOST_NUMBERS, matrix_of, rows_of, small_batches

COEFFICIENTS = "t long, n int, m int, re double, im double"


def legendre(x: np.ndarray, m: int, top: int) -> np.ndarray:
    """P(n, m; x) for n = m .. top as columns, by the recurrence over n of normalised functions, which keeps its digits."""
    out = np.zeros((len(x), max(top - m + 1, 0)))
    if top < m:
        return out
    k = np.arange(1, m + 1)
    with np.errstate(divide="ignore"):
        size = 0.5 * (np.log((2 * m + 1) / (4 * np.pi)) + np.log((2 * k - 1) / (2 * k)).sum()) + (m * 0.5 * np.log1p(-np.minimum(x * x, 1.0)) if m else 0.0)
    out[:, 0] = np.exp(size)
    if top > m:
        out[:, 1] = np.sqrt(2 * m + 3) * x * out[:, 0]
    for n in range(m + 2, top + 1):
        a = np.sqrt((4 * n * n - 1) / (n * n - m * m))
        b = np.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1))
        out[:, n - m] = a * (x * out[:, n - m - 1] - b * out[:, n - m - 2])
    return out


def quadrature(lats: Sequence[float]) -> np.ndarray:
    """Weights of the latitudes, of sum 2, exact for polynomials in sin(lat) of a degree below their number."""
    x = np.sin(np.radians(np.asarray(lats, float)))
    table = legendre(x, 0, len(x) - 1)
    right = np.zeros(len(x))
    right[0] = 2 * table[0, 0] if len(x) else 0.0
    return np.linalg.lstsq(table.T, right, rcond=None)[0]


@dataclass(frozen=True)
class Lattice:
    """Latitudes by longitudes (degrees), longitudes evenly around the globe; ``order``: where the cells lie, row by row."""

    lats: np.ndarray
    lons: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(grid: DataFrame, names: np.ndarray) -> Lattice:
        """The lattice of a grid (cell, lat, lon) whose cells in order are ``names``; ValueError if it is none."""
        if grid.count() > MOST_NUMBERS:
            raise ValueError("the grid is too large for a row")
        got = grid.select(F.col("cell").cast("long"), F.col("lat").cast("double"), F.pmod(F.col("lon").cast("double"), F.lit(360.0))).toArrow()
        cell, lat, lon = (got.column(k).to_numpy() for k in range(3))
        lats, lons = np.unique(lat)[::-1], np.unique(lon)
        place = np.searchsorted(-lats, -lat) * len(lons) + np.searchsorted(lons, lon)
        if len(cell) != len(lats) * len(lons) or len(np.unique(place)) != len(cell) or len(np.unique(cell)) != len(cell):
            raise ValueError("the cells are no lattice of latitudes by longitudes")
        if not np.allclose(np.diff(lons), 360 / len(lons), atol=1e-6):
            raise ValueError("the longitudes do not lie evenly around the globe")
        by_cell = np.argsort(cell)
        if len(names) != len(cell) or (cell[by_cell] != names).any():
            raise ValueError("field and grid have different cells")
        return Lattice(lats, lons, np.argsort(place[by_cell]))


class Transform:
    """Analysis on a lattice to degree ``top`` (triangular truncation)."""

    def __init__(self, at: Lattice, top: int):
        if top < 0 or 2 * top >= len(at.lons):
            raise ValueError(f"{len(at.lons)} longitudes do not tell the waves to {top} apart")
        self.at, self.top = at, top
        x, w = np.sin(np.radians(at.lats)), quadrature(at.lats)
        self.tables = []
        for m in range(top + 1):
            p = legendre(x, m, top)
            if np.abs(2 * np.pi * (p * w[:, None]).T @ p - np.eye(p.shape[1])).max() > 1e-6:
                raise ValueError(f"{len(at.lats)} latitudes do not tell degrees to {top} apart")
            self.tables.append(p * w[:, None])

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """Coefficients (rows, n, m) of rows of values by cell."""
        n_lat, n_lon, top = len(self.at.lats), len(self.at.lons), self.top
        waves = np.fft.rfft(rows[:, self.at.order].reshape(-1, n_lat, n_lon), axis=2)[:, :, : top + 1] * (2 * np.pi / n_lon)
        waves *= np.exp(-1j * np.arange(top + 1) * np.radians(self.at.lons[0]))
        out = np.zeros((len(rows), top + 1, top + 1), complex)
        for m in range(top + 1):
            out[:, m:, m] = waves[:, :, m] @ self.tables[m]
        return out


class Synthesis:
    """Values at latitudes by longitudes, row by row, of coefficients to degree ``top``."""

    def __init__(self, lats: Sequence[float], lons: Sequence[float], top: int):
        x = np.sin(np.radians(np.asarray(lats, float)))
        self.top, self.tables = top, [legendre(x, m, top).T for m in range(top + 1)]
        m = np.arange(top + 1)[:, None] * np.radians(np.asarray(lons, float))
        twice = np.where(np.arange(top + 1) > 0, 2.0, 1.0)[:, None]
        self.cos, self.sin = twice * np.cos(m), -twice * np.sin(m)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        waves = np.stack([c[:, m:, m] @ self.tables[m] for m in range(self.top + 1)], axis=2)
        return (waves.real @ self.cos + waves.imag @ self.sin).reshape(len(c), -1)


def analyse(field: DataFrame, grid: DataFrame, top: int) -> DataFrame:
    """(t, n, m, re, im): the coefficients of every time of a field on a lattice, m from 0 to n, n to ``top``."""
    r = rows_of(field)
    if not r.n:
        return field.sparkSession.createDataFrame([], COEFFICIENTS)
    at = Lattice.of(grid, r.names)
    Transform(at, top)  # raises here what the tasks would raise
    n, m = np.tril_indices(top + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transform = Transform(at, top)
        for batch in batches:
            if batch.num_rows:
                c = transform(matrix_of(batch.column(1)))[:, n, m]
                t = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), len(n))
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.tile(n.astype(np.int32), len(c))), pa.array(np.tile(m.astype(np.int32), len(c))), pa.array(c.real.ravel()), pa.array(c.imag.ravel())], names=["t", "n", "m", "re", "im"])

    with small_batches(field.sparkSession, len(r.names)):
        return r.table.mapInArrow(run, COEFFICIENTS)


def synthesise(coefficients: DataFrame, lats: Sequence[float], lons: Sequence[float]) -> DataFrame:
    """(t, cell, value) on latitudes by longitudes, cells counted row by row. Coefficients that are not there are 0."""
    top = coefficients.agg(F.max("n").alias("n")).first().n
    if top is None:
        return coefficients.sparkSession.createDataFrame([], "t long, cell long, value double")
    if (top + 1) * (top + 2) // 2 > MOST_NUMBERS:
        raise ValueError("too many coefficients for a row")
    by_time = coefficients.groupBy(F.col("t").cast("long").alias("t")).agg(*[F.collect_list(F.struct("n", "m", "re", "im")[c]).alias(c) for c in ("n", "m", "re", "im")])  # (top + 1)(top + 2) / 2 a time
    cells = len(lats) * len(lons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Synthesis(lats, lons, top)
        for batch in batches:
            for k in range(batch.num_rows):
                n, m, re, im = (batch.column(j)[k].values.to_numpy(zero_copy_only=False) for j in range(1, 5))
                c = np.zeros((1, top + 1, top + 1), complex)
                c[0, n, m] = re + 1j * im
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cells, batch.column(0)[k].as_py())), pa.array(np.arange(cells)), pa.array(made(c)[0])], names=["t", "cell", "value"])

    return by_time.mapInArrow(run, "t long, cell long, value double")


def regrid(field: DataFrame, grid: DataFrame, lats: Sequence[float], lons: Sequence[float], top: int) -> DataFrame:
    """A field truncated at degree ``top`` and put on latitudes by longitudes, cells counted row by row, in one pass."""
    r = rows_of(field)
    if not r.n:
        return field.sparkSession.createDataFrame([], "t long, cell long, value double")
    at = Lattice.of(grid, r.names)
    Transform(at, top)
    cells = len(lats) * len(lons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transform, made = Transform(at, top), Synthesis(lats, lons, top)
        for batch in batches:
            step = max(1, (1 << 21) // (cells + (top + 1) ** 2))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                value = made(transform(matrix_of(part.column(1))))
                t = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), cells)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.tile(np.arange(cells), len(value))), pa.array(value.ravel())], names=["t", "cell", "value"])

    with small_batches(field.sparkSession, len(r.names)):
        return r.table.mapInArrow(run, "t long, cell long, value double")


def power(coefficients: DataFrame) -> DataFrame:
    """(n, power): the mean over times of the squared coefficients of each degree; summed over n the mean square of the field times 4 pi."""
    twice = F.when(F.col("m") > 0, 2.0).otherwise(1.0)
    each = coefficients.groupBy("t", "n").agg(F.sum(twice * (F.pow("re", 2) + F.pow("im", 2))).alias("p"))
    return each.groupBy("n").agg(F.avg("p").alias("power"))
