"""Masks, grids, weights and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean, lat_weight
from ..sources.store import numbered

ENSO_BOX = (-5.0, 5.0, 240.0, 290.0)
PDO_BOX = (20.0, 70.0, 110.0, 250.0)


def valid_cells(field: DataFrame, fill: float | None = None) -> DataFrame:
    """(cell, valid): valid where every time has a finite value that is not the fill value."""
    return field.groupBy("cell").agg(F.min(clean(F.col("value"), fill).isNotNull()).alias("valid"))


def composite_mask(masks: DataFrame) -> DataFrame:
    """(cell, masked) from (t, cell, masked): masked where any time is."""
    return masks.groupBy("cell").agg(F.max("masked").alias("masked"))


def compress(field: DataFrame, fill: float | None = None) -> DataFrame:
    """Only cells that are valid at every time."""
    return field.join(valid_cells(field, fill).where("valid"), "cell", "left_semi")


def apply_mask(field: DataFrame, cells: DataFrame) -> DataFrame:
    """Only the cells of a mask table."""
    return field.join(cells.select("cell"), "cell", "left_semi")


def landsea_fill(field: DataFrame, masked: DataFrame) -> DataFrame:
    """Masked cells set to 0, not dropped."""
    flags = masked.select("cell").withColumn("__m", F.lit(True))
    return field.join(flags, "cell", "left").select("t", "cell", F.when(F.col("__m"), 0.0).otherwise(F.col("value")).alias("value"))


def flat_cell(ilat: Column, ilon: Column, nlon: int, ilev: Column | None = None, nlat: int = 1) -> Column:
    """Row-major number of a cell."""
    level = ilev if ilev is not None else F.lit(0)
    return ((level * nlat + ilat) * nlon + ilon).cast("long")


def inflate(field: DataFrame, grid: DataFrame) -> DataFrame:
    """All cells of the grid at each time of the field; cells without values get NULL.

    The product of times and cells is the size of the result itself.
    """
    return field.select("t").distinct().crossJoin(grid.select("cell")).join(field, ["t", "cell"], "left").select("t", "cell", "value")


def coordinate_grid(grid: DataFrame, keys: list[str], cells: DataFrame | None = None) -> DataFrame:
    """Coordinates of every cell, or of the given cells; an unknown key raises KeyError."""
    if missing := [k for k in keys if k not in grid.columns]:
        raise KeyError(missing[0])
    out = grid.select("cell", *keys)
    return out if cells is None else out.join(cells.select("cell"), "cell", "left_semi")


def dim_coords(grid: DataFrame, key: str) -> DataFrame:
    """(index, coord): the distinct coordinates of a dimension in their order, with their index."""
    return numbered(grid.select(F.col(key).alias("coord")), "coord", "index")


def subset_time(field: DataFrame, first: int, last: int) -> DataFrame:
    """Samples first .. last - 1, renumbered from 0."""
    return field.where(F.col("t").between(first, last - 1)).withColumn("t", F.col("t") - first)


def subset_times(field: DataFrame, times: list[int]) -> DataFrame:
    """Samples of a list, renumbered by their place in it; a time may come twice, one that is not there raises IndexError."""
    spark = field.sparkSession
    want = spark.createDataFrame(list(enumerate(times)), "at long, t long")
    if want.select("t").join(field.select("t").distinct(), "t", "left_anti").limit(1).count():
        raise IndexError("a time that the field has not")
    return field.join(want, "t").drop("t").withColumnRenamed("at", "t").select(*field.columns)


def box(grid: DataFrame, lat_lon: tuple[float, float, float, float]) -> DataFrame:
    """Cells inside a box, edges included."""
    a, b, c, d = lat_lon
    return grid.where(F.col("lat").between(a, b) & F.col("lon").between(c, d))


def area_weight_lat(field: DataFrame, grid: DataFrame, root: bool = True) -> DataFrame:
    weights = grid.select("cell", lat_weight(F.col("lat"), root).alias("__w"))
    return field.join(weights, "cell").select("t", "cell", (F.col("value") * F.col("__w")).alias("value"))


def area_weight_old(field: DataFrame, grid: DataFrame) -> DataFrame:
    weights = grid.select("cell", F.sqrt(F.cos(F.radians("lat"))).alias("__w"))
    return field.join(weights, "cell").select("t", "cell", (F.col("value") * F.col("__w")).alias("value"))


def area_weight_cell(field: DataFrame, grid: DataFrame, root: bool = True) -> DataFrame:
    """Weights by share of the total area of the grid's cells."""
    total = grid.agg(F.sum("cell_area").alias("__total"))
    share = F.col("cell_area") / F.col("__total")
    weights = grid.join(F.broadcast(total)).select("cell", (F.sqrt(share) if root else share).alias("__w"))  # one row
    return field.join(weights, "cell").select("t", "cell", (F.col("value") * F.col("__w")).alias("value"))


def _edges(centres: DataFrame, n: int, clamp: float | None) -> DataFrame:
    """(line, i, edge) of coordinate centres (line, i, x), i in 0 .. n - 1 along each line.

    A centre goes to the places up to two beside it, so that a place has all it needs in one group: lines may be of
    any length and no window holds one.
    """
    beside = F.explode(F.array(*[F.struct((F.col("i") + k).alias("i"), F.lit(-k).alias("off"), "x") for k in range(-2, 3)]))
    near = centres.select("line", beside.alias("p")).select("line", "p.*").groupBy("line", "i").agg(*[F.max(F.when(F.col("off") == k, F.col("x"))).alias(f"x{k + 2}") for k in range(-2, 3)])
    x = lambda k: F.col(f"x{k + 2}")
    raw = lambda k: x(k + 1) - x(k)

    def step(k: int):
        d = F.when(raw(k) > 300, raw(k + 1) if k < 1 else None).when(raw(k) < -300, raw(k - 1)).otherwise(raw(k))
        return d if clamp is None else F.greatest(F.least(d, F.lit(clamp)), F.lit(-clamp))

    ahead = F.when(F.col("i") < n - 1, F.struct(F.col("i"), (x(0) - step(0) / 2).alias("edge")))
    behind = F.when(F.col("i") >= n - 2, F.struct((F.col("i") + 1).alias("i"), (x(0) + F.coalesce(step(-1), step(0)) / 2).alias("edge")))
    return near.where("x2 is not null").select("line", F.explode(F.array_compact(F.array(ahead, behind))).alias("e")).select("line", "e.*")


def bounds(centres: DataFrame, clamp: float | None = None) -> DataFrame:
    """(i, edge) for i in 0 .. n of coordinate centres (i, x), i from 0.

    The first n - 1 edges lie half the spacing before their centre, the last two half the spacing after the
    second last and the last. A spacing beyond 300 (a date-line wrap) is replaced by the next one, one below -300
    by the previous one; spacings are clamped for latitudes.
    """
    last = centres.agg(F.max("i").alias("i")).first().i
    return _edges(centres.select(F.lit(0).alias("line"), F.col("i").cast("long").alias("i"), "x"), 0 if last is None else last + 1, clamp).select("i", "edge")


def bounds_2d(centres: DataFrame) -> DataFrame:
    """(i, j, lat_edge, lon_edge) for i in 0 .. n, j in 0 .. m of a lattice of centres (i, j, lat, lon).

    Latitudes change along i and are bounded along it for each j, longitudes along j for each i; the line past the
    last of the other axis repeats the last. A lattice with holes raises ValueError.
    """
    size = centres.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.countDistinct("i", "j").alias("n"), F.count("*").alias("rows")).first()
    if not size.rows:
        return centres.sparkSession.createDataFrame([], "i long, j long, lat_edge double, lon_edge double")
    n, m = size.i + 1, size.j + 1
    if size.n != n * m or size.rows != n * m:
        raise ValueError("the lattice has holes or repeated places")
    lat = _edges(centres.select(F.col("j").alias("line"), F.col("i").cast("long").alias("i"), F.col("lat").alias("x")), n, 90.0)
    lon = _edges(centres.select(F.col("i").alias("line"), F.col("j").cast("long").alias("i"), F.col("lon").alias("x")), m, None)
    again = lambda last: F.explode(F.when(F.col("line") == last, F.array(F.lit(last).cast("long"), F.lit(last + 1).cast("long"))).otherwise(F.array(F.col("line").cast("long"))))
    lat = lat.select("i", again(m - 1).alias("j"), F.col("edge").alias("lat_edge"))
    lon = lon.select(again(n - 1).alias("__i"), F.col("i").alias("j"), F.col("edge").alias("lon_edge")).select(F.col("__i").alias("i"), "j", "lon_edge")
    return lat.join(lon, ["i", "j"])


def regrid(field: DataFrame, weights: DataFrame) -> DataFrame:
    """Sparse weights (cell, new_cell, w): each new cell is the weighted sum of old ones."""
    return field.join(weights, "cell").groupBy("t", "new_cell").agg(F.sum(F.col("w") * F.col("value")).alias("value")).select("t", F.col("new_cell").alias("cell"), "value")


def area_mean(field: DataFrame, grid: DataFrame) -> DataFrame:
    """Area-weighted mean at each time, over cells with a value."""
    w = F.when(F.col("value").isNotNull(), F.col("cell_area"))
    return field.join(grid.select("cell", "cell_area"), "cell").groupBy("t").agg(F.try_divide(F.sum(F.col("value") * w), F.sum(w)).alias("value"))


def box_mean(field: DataFrame, grid: DataFrame, lat_lon: tuple[float, float, float, float] = ENSO_BOX) -> DataFrame:
    """Plain mean at each time over the cells of a box."""
    return field.join(box(grid, lat_lon).select("cell"), "cell", "left_semi").groupBy("t").agg(F.avg("value").alias("value"))
