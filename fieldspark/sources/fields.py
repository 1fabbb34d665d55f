"""Fields from the provided tables, from array rows, and to and from Parquet."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clean
from .store import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The date column of each table that monthly fields come from.
DATES = {"orders": "o_orderdate", "lineitem": "l_shipdate"}


def month_index(date: Column, base_year: int) -> Column:
    return ((F.year(date) - base_year) * 12 + F.month(date) - 1).cast("long")


def span(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """First year of a table's dates, and the months from its January to the last date: what monthly fields cover."""
    date = F.col(DATES[name])
    got = table(spark, sf_dir, name).agg(F.min(F.year(date)).alias("y"), F.max(F.year(date) * 12 + F.month(date)).alias("m")).first()
    return (got.y, got.m - got.y * 12) if got.y is not None else (1, 0)


def months(spark: SparkSession, sf_dir: str, name: str = "orders") -> int:
    return span(spark, sf_dir, name)[1]


def densify(field: DataFrame, steps: int, fill: float | None = 0.0) -> DataFrame:
    """All (t, cell) for t in 0 .. steps - 1 and the field's cells: each cell brings its own sequence of steps."""
    if steps < 1:
        return field.limit(0)
    cells = field.select("cell").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("t"), "cell")
    out = cells.join(field, ["t", "cell"], "left")
    return out.select("t", "cell", F.coalesce("value", F.lit(fill)).alias("value") if fill is not None else "value")


def _days(spark: SparkSession, sf_dir: str):
    """First day of the events, as a date, and the number of days to the last."""
    got = table(spark, sf_dir, "events").agg(F.min(F.col("ts").cast("date")).alias("a"), F.max(F.col("ts").cast("date")).alias("b")).first()
    return (got.a, (got.b - got.a).days + 1) if got.a else (None, 0)


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily sums of event values by type; the cell is the type's rank in alphabetical order."""
    first, days = _days(spark, sf_dir)
    e = table(spark, sf_dir, "events").select(F.datediff("ts", F.lit(first).cast("date")).cast("long").alias("t"), "event_type", "value")
    summed = e.groupBy("t", "event_type").agg(F.sum("value").alias("value"))
    return densify(with_cells(summed, "event_type"), days)


def events_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """means of event values by six hours and type; gaps stay NULL."""
    first, days = _days(spark, sf_dir)
    hours = (F.datediff("ts", F.lit(first).cast("date")) * 24 + F.hour("ts")).cast("long")
    e = table(spark, sf_dir, "events").select(F.floor(hours / 6).alias("t"), "event_type", "value")
    return densify(with_cells(e.groupBy("t", "event_type").agg(F.avg("value").alias("value")), "event_type"), 4 * days, None)


def with_cells(df: DataFrame, name: str) -> DataFrame:
    """Numbers the few values of a name column by their order."""
    return df.join(numbered(df, name, "cell"), name).select("t", "cell", "value")


def orders_by(spark: SparkSession, sf_dir: str, cell: str) -> DataFrame:
    """F3 (cell='n_regionkey') and F4 (cell='n_nationkey'): monthly order totals in millions."""
    year, steps = span(spark, sf_dir, "orders")
    o = table(spark, sf_dir, "orders").select("o_custkey", month_index(F.col("o_orderdate"), year).alias("t"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    summed = joined.groupBy("t", F.col(cell).cast("long").alias("cell")).agg((F.sum("o_totalprice") / 1e6).alias("value"))
    return densify(summed, steps)


def orders_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_by(spark, sf_dir, "n_regionkey")


def orders_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_by(spark, sf_dir, "n_nationkey")


def orders_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member, t, cell, value): monthly order totals by region, one member for each order priority (its first digit)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", month_index(F.col("o_orderdate"), span(spark, sf_dir, "orders")[0]).alias("t"), "o_totalprice", F.substring("o_orderpriority", 1, 1).cast("int").alias("member"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("member", "t", F.col("n_regionkey").cast("long").alias("cell")).agg((F.sum("o_totalprice") / 1e6).alias("value"))


def lineitem_snation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """monthly revenue in millions by the supplier's nation."""
    year, steps = span(spark, sf_dir, "lineitem")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", month_index(F.col("l_shipdate"), year).alias("t"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    summed = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("t", F.col("s_nationkey").cast("long").alias("cell")).agg((F.sum("v") / 1e6).alias("value"))
    return densify(summed, steps)


def from_arrays(df: DataFrame, t: str, values: str) -> DataFrame:
    """A field from rows that hold all cells of one time in an array; the cell is the place in it."""
    return df.select(F.col(t).cast("long").alias("t"), F.posexplode(values).alias("cell", "value")).select("t", F.col("cell").cast("long").alias("cell"), clean(F.col("value")).alias("value"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a sample for each vector."""
    return from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def nation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry of F4 and F5: cell, lat, lon, cell_area."""
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("cell"), (k * 5 - 60).cast("double").alias("lat"), F.pmod(F.lit(420) - k * 15, F.lit(360)).cast("double").alias("lon"), (k % 7 + 1).cast("double").alias("cell_area"))


def with_cell_area(grid: DataFrame, areas: DataFrame) -> DataFrame:
    """Areas (cell, cell_area) joined onto a grid."""
    return grid.drop("cell_area").join(areas.select("cell", "cell_area"), "cell", "left")


def months_since(number: Column, base_year: int) -> tuple[Column, Column]:
    """Year and month of months counted from January of a base year, which may be 0 or before: plain integers, the day is 1."""
    return (F.floor(number / 12) + base_year).cast("long"), (F.pmod(number, F.lit(12)) + 1).cast("long")


def save_field(field: DataFrame, path: str, grid: DataFrame | None = None, ops: tuple[str, ...] = (), by: str | None = None) -> None:
    """Writes a field, its grid and its history; an existing one is replaced."""
    writer = field.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/field")
    if grid is not None:
        grid.write.mode("overwrite").parquet(f"{path}/grid")
    meta = field.sparkSession.createDataFrame([(json.dumps({"ops": list(ops)}),)], "value string")
    meta.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_field(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, ...]]:
    ops = json.loads(spark.read.text(f"{path}/meta").first()[0])["ops"]
    return spark.read.parquet(f"{path}/field"), tuple(ops)
