"""Variables of an experiment as fields and grids, from tables with coordinates, and as one folder of Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import decode, months
from ..functions.numeric import clean
from .fields import load_field, save_field
from .store import numbered


@dataclass
class Variable:
    """Rows (time, lat, lon, value) of a variable, a row for each time and place.

    Each place is a cell, whatever grid it lies on: latitude and longitude may be those of a regular grid, of an
    irregular one or of stations. ``units`` and ``calendar`` say what a numeric time means; without units the time is
    a number of months already.
    """

    rows: DataFrame
    units: str | None = None
    calendar: str = "standard"
    base_year: int = 1
    fill: float | None = None


def load(variable: Variable) -> tuple[DataFrame, DataFrame]:
    """The field (t in months, cell, value) and the grid (cell, lat, lon); fill values are NULL.

    Cells are numbered by latitude, then longitude. A table without one of the four columns raises ValueError.
    """
    rows = variable.rows
    if missing := [c for c in ("time", "lat", "lon", "value") if c not in rows.columns]:
        raise ValueError(f"the table has no column {missing[0]}")
    t = F.col("time").cast("long")
    if variable.units:
        year, month, _, _ = decode(F.col("time"), variable.units, variable.calendar)
        t = months(year, month, variable.base_year)
    placed = rows.select(t.alias("t"), F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("place"), clean(F.col("value"), variable.fill).alias("value"))
    cells = numbered(placed, "place", "cell")
    return placed.join(cells, "place").select("t", "cell", "value"), cells.select("cell", "place.lat", "place.lon")


def load_all(variables: dict[str, Variable]) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {name: load(v) for name, v in variables.items()}


def convert(variables: dict[str, Variable], folder: str) -> None:
    """Each variable as a folder of its own: field and grid, written once and read many times."""
    for name, (field, grid) in load_all(variables).items():
        save_field(field, f"{folder}/{name}", grid)


def reload(spark: SparkSession, folder: str, names: list[str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {n: (load_field(spark, f"{folder}/{n}")[0], spark.read.parquet(f"{folder}/{n}/grid")) for n in names}


def flat_arrays(df: DataFrame, t: str, values: str, lat: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """Field and grid of rows with one array of values a time and arrays of each station's latitude and longitude."""
    long = df.select(F.col(t).cast("long").alias("t"), F.posexplode(F.arrays_zip(F.col(values).alias("v"), F.col(lat).alias("a"), F.col(lon).alias("o"))).alias("cell", "x"))
    long = long.select("t", F.col("cell").cast("long").alias("cell"), F.col("x.v").alias("value"), F.col("x.a").cast("double").alias("lat"), F.col("x.o").cast("double").alias("lon"))
    grid = long.groupBy("cell").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return long.select("t", "cell", clean(F.col("value")).alias("value")), grid


def gridded_arrays(df: DataFrame, t: str, values: str, lats: list[float], lons: list[float]) -> tuple[DataFrame, DataFrame]:
    """Field and grid of rows with the values of a latitude by longitude grid, row by row, in one array.

    An array of another length raises ValueError.
    """
    if df.where(F.size(values) != len(lats) * len(lons)).limit(1).count():
        raise ValueError("the values do not fit the grid")
    long = df.select(F.col(t).cast("long").alias("t"), F.posexplode(values).alias("cell", "value")).select("t", F.col("cell").cast("long").alias("cell"), clean(F.col("value")).alias("value"))
    n = len(lons)
    at = lambda xs, i: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (i + 1).cast("int"))
    cell = F.col("id")
    grid = df.sparkSession.range(len(lats) * n).select(cell.alias("cell"), at(lats, F.floor(cell / n)).alias("lat"), at(lons, cell % n).alias("lon"))
    return long, grid
