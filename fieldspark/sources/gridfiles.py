"""What readers and writers of gridded files share: rows by runs of times, and files of runs of times.

A format tells, for a variable of a file, its times, the coordinates of its cells and the values of a run of times
(``Opened``). A source gives rows (time, cell, lat, lon, value): raw numbers of the time variable, cells counted row by
row over the dimensions after it, and coordinates of each cell. The driver reads headers and times only. A partition
is a run of times of one file, some megabytes of it; times outside the options ``first`` and ``last`` are skipped before
any of their bytes is read. (Options, since Spark keeps what it pushes into a Python source with the table and not with
the plan: two filters on one table in one query would both get the later one's rows.)

Files are opened by path, or by any URI that Arrow's file systems know, so they may lie wherever all executors can read.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .experiments import Variable
from .store import numbered, small_batches, stored

SCHEMA = "time double, cell long, lat double, lon double, value double"
#: Bytes of a partition, and values made into rows at a time.
PARTITION_BYTES, ROWS = 32 << 20, 1 << 18


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def opened(path: str) -> pa.NativeFile:
    where, inner = located(path)
    return where.open_input_file(inner)


class Opened(ABC):
    """A variable of an open file; ValueError where the file has none such."""

    #: Bytes of a time, times that lie together, and what the numbers of the time variable mean.
    row_bytes: int
    together: int = 1
    units: str | None
    calendar: str

    def __init__(self, path: str, name: str):
        self.path, self.name, self.file = path, name, opened(path)

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    @abstractmethod
    def times(self) -> np.ndarray: ...

    @abstractmethod
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Latitude and longitude of every cell."""

    @abstractmethod
    def values(self, first: int, count: int) -> np.ndarray:
        """Values (count x cells) of times from ``first`` on; NaN where there is none."""


def spread(lat: np.ndarray, lat_axes: list[int], lon: np.ndarray, lon_axes: list[int], shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of every cell of ``shape``, row by row, of ones that lie along some of its axes."""
    out = []
    for x, axes in ((lat, lat_axes), (lon, lon_axes)):
        own = np.ones(len(shape), int)
        own[axes] = [shape[a] for a in axes]
        out.append(np.broadcast_to(np.transpose(x, np.argsort(axes)).reshape(own), shape).ravel().astype(np.float64))
    return out[0], out[1]


@dataclass
class Run(InputPartition):
    """Times first .. first + count - 1 of a file."""

    path: str
    first: int
    count: int


class Reader(DataSourceReader):
    def __init__(self, kind: type[Opened], paths: list[str], name: str, first: float, last: float, size: int):
        self.kind, self.paths, self.name, self.first, self.last, self.size = kind, paths, name, first, last, size

    def partitions(self) -> Sequence[Run]:
        out = []
        for path in self.paths:
            with self.kind(path, self.name) as f:
                t = f.times()
                most = max(f.together, self.size // max(1, f.row_bytes) // f.together * f.together)
                at = np.flatnonzero((t >= self.first) & (t <= self.last))
                for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
                    k, end = int(run[0]), int(run[-1]) + 1
                    while k < end:  # cut where what lies together ends
                        to = min(end, k // f.together * f.together + most)
                        out.append(Run(path, k, to - k))
                        k = to
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        with self.kind(partition.path, self.name) as f:
            lat, lon = f.places()
            cells = len(lat)
            t = f.times()[partition.first : partition.first + partition.count]
            step = max(f.together, ROWS // max(cells, 1) // f.together * f.together)
            for k in range(0, partition.count, step):
                x = f.values(partition.first + k, min(step, partition.count - k)).ravel()
                for a in range(0, len(x), 1 << 20):  # a time of very many cells
                    at = np.arange(a, min(len(x), a + (1 << 20)))
                    c = at % cells
                    yield pa.RecordBatch.from_arrays([pa.array(t[k + at // cells]), pa.array(c), pa.array(lat[c]), pa.array(lon[c]), pa.array(x[at], mask=np.isnan(x[at]))], names=["time", "cell", "lat", "lon", "value"])


class Source(DataSource):
    """Options: path (several are separated by commas), variable, and first, last, partitionBytes."""

    kind: type[Opened]

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        o = self.options
        return Reader(self.kind, [p for p in o["path"].split(",") if p], o["variable"], float(o.get("first", "-inf")), float(o.get("last", "inf")), int(o.get("partitionBytes", PARTITION_BYTES)))


def read(spark: SparkSession, source: type[Source], paths: list[str], name: str, first: float | None = None, last: float | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows (time, cell, lat, lon, value) of a variable in files that each hold some of its times, from ``first`` to ``last``."""
    spark.dataSource.register(source)
    ends = {k: str(v) for k, v in (("first", first), ("last", last)) if v is not None}
    return spark.read.format(source.name()).options(variable=name, partitionBytes=partition_bytes, **ends).load(",".join(paths))


def variable(spark: SparkSession, source: type[Source], paths: list[str], name: str, base_year: int = 1) -> Variable:
    """A variable with its units and calendar for ``experiments.load`` and ``convert``; files must agree on them."""
    found = set()
    for p in paths:
        with source.kind(p, name) as f:
            found.add((f.units, f.calendar))
    if len(found) != 1:
        raise ValueError("the files count time in different units")
    units, calendar = found.pop()
    return Variable(read(spark, source, paths, name), units, calendar, base_year)


class Layout(ABC):
    """How a file of ``times`` records of a value for each of the places ``lat``, ``lon`` is written, front to back."""

    suffix: str

    def __init__(self, name: str, units: str, calendar: str, fill: float, lat: np.ndarray, lon: np.ndarray, times: int):
        self.name, self.units, self.calendar, self.fill, self.lat, self.lon, self.times = name, units, calendar, fill, lat, lon, times

    @abstractmethod
    def head(self) -> bytes: ...

    @abstractmethod
    def record(self, time: float, values: np.ndarray) -> bytes: ...

    def tail(self, times: list[float]) -> bytes:
        return b""


def write(rows: DataFrame, layout: type[Layout], folder: str, name: str, units: str, calendar: str = "standard", times_a_file: int = 120, fill: float = 1e20) -> list[str]:
    """Writes rows (time, lat, lon, value) as files of a run of times each, stations along ``cell``; gives their paths.

    Times and places are numbered in their order; a task writes whole files, each under another name until it is
    complete, so that a task that is run again leaves no half file under the file's name. Every file holds all places;
    gaps and NULL become the fill value. A time and place twice raises ValueError.
    """
    spark = rows.sparkSession
    placed = stored(rows.select(F.col("time").cast("double").alias("time"), F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("place"), F.col("value").cast("double").alias("value")), "rows")
    if placed.groupBy("time", "place").count().where("count > 1").limit(1).count():
        raise ValueError("a time and place comes twice")
    cells, times = (stored(numbered(placed, key, name_), name_) for key, name_ in (("place", "cell"), ("time", "k")))
    n, n_times = cells.count(), times.count()
    if n > 1 << 26:
        raise ValueError("too many places for a record")
    at = cells.orderBy("cell").select("place.lat", "place.lon").toArrow()
    sent = spark.sparkContext.broadcast((at.column(0).to_numpy(), at.column(1).to_numpy()))  # of checked size
    by_time = placed.join(cells, "place").groupBy("time").agg(F.collect_list("cell").alias("cells"), F.collect_list(F.coalesce("value", F.lit(fill))).alias("values"))  # a record each
    by_file = by_time.join(times, "time").select(F.floor(F.col("k") / times_a_file).alias("file"), "k", "time", "cells", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, inner = located(folder)
        out = path = half = file = made = None
        done: list[float] = []

        def closed() -> pa.RecordBatch:
            out.write(made.tail(done))
            out.close()
            where.move(half, path)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}-{file:06d}.{layout.suffix}"])], names=["path"])

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(0)[k].as_py() != file:
                    if out:
                        yield closed()
                    file, done = batch.column(0)[k].as_py(), []
                    path = f"{inner}/{name}-{file:06d}.{layout.suffix}"
                    half = f"{path}.{uuid.uuid4().hex}"
                    made = layout(name, units, calendar, fill, *sent.value, min(times_a_file, n_times - file * times_a_file))
                    out = where.open_output_stream(half)
                    out.write(made.head())
                record = np.full(n, fill)
                record[batch.column(3)[k].values.to_numpy()] = batch.column(4)[k].values.to_numpy()
                done.append(batch.column(2)[k].as_py())
                out.write(made.record(done[-1], record))
        if out:
            yield closed()

    where, inner = located(folder)
    where.create_dir(inner)
    made = by_file.repartition(max(1, -(-n_times // times_a_file)), "file").sortWithinPartitions("file", "k").mapInArrow(run, "path string")
    with small_batches(spark, 2 * n):
        return sorted(r.path for r in made.collect())  # a name for each file
