"""Resampling, running means, anomalies, trends and lags. All of them need the rows of a cell together, so a
field that is repartitioned by cell once keeps one exchange through a chain of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pearson

#: Named yearly averages of monthly data: samples skipped at the start.
SHIFTS = {"ann_std": 0, "ann_spr": 4, "ann_fall": 10}


def by_cell(field: DataFrame) -> DataFrame:
    return field.repartition("cell")


def resample_avg(field: DataFrame, k: int, n: int, shift: int = 0) -> DataFrame:
    """Means of consecutive blocks of k of n samples, after skipping ``shift``; first_t is a block's first sample."""
    if shift < 0:
        raise ValueError("shift must not be negative")
    last = shift + k * ((n - shift) // k)
    block = F.floor((F.col("t") - shift) / k).cast("long")
    return field.where(F.col("t").between(shift, last - 1)).groupBy(block.alias("block"), "cell").agg(F.min("t").alias("first_t"), F.avg("value").alias("value"))


def resample_named(field: DataFrame, name: str, n: int) -> DataFrame:
    return field.select(F.col("t").alias("block"), "cell", F.col("t").alias("first_t"), "value") if name == "none" else resample_avg(field, 12, n, SHIFTS[name])


def run_mean(field: DataFrame, w: int, n: int) -> DataFrame:
    """Centred mean of w samples with the edges reflected (edge sample repeated); an even w leans forward."""
    half = w // 2
    places = F.array(F.col("t"), F.when(F.col("t") < half, -1 - F.col("t")), F.when(F.col("t") >= n - half, 2 * n - 1 - F.col("t")))
    whole = field.select(F.explode(F.filter(places, lambda p: p.isNotNull())).alias("t"), "cell", "value")
    over = Window.partitionBy("cell").orderBy("t").rowsBetween(-((w - 1) // 2), half)
    return whole.withColumn("value", F.avg("value").over(over)).where(F.col("t").between(0, n - 1))


def run_mean_trim(field: DataFrame, w: int, n: int, year_len: int = 1) -> DataFrame:
    """Running mean without the edges, in whole years; no reflected sample reaches what is kept."""
    year_len = max(1, year_len)
    trim = math.ceil((w // 2) / year_len) * year_len
    if n < w or n <= 2 * trim:
        raise ValueError("too few samples for the window")
    over = Window.partitionBy("cell").orderBy("t").rowsBetween(-((w - 1) // 2), w // 2)
    return field.withColumn("value", F.avg("value").over(over)).where(F.col("t").between(trim, n - 1 - trim))


def climatology(field: DataFrame, year_len: int) -> DataFrame:
    """Mean by cell and phase."""
    return field.groupBy("cell", F.pmod("t", F.lit(year_len)).alias("phase")).agg(F.avg("value").alias("climo"))


def anomaly(field: DataFrame, year_len: int, climo: DataFrame | None = None) -> DataFrame:
    """Deviation from the mean by phase, or from a given climatology."""
    year_len = max(1, year_len)
    phase = F.pmod("t", F.lit(year_len))
    if climo is not None:
        joined = field.withColumn("phase", phase).join(climo, ["cell", "phase"])
        return joined.select("t", "cell", (F.col("value") - F.col("climo")).alias("value"))
    return field.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("cell", phase)))


def detrend(field: DataFrame) -> DataFrame:
    """Residual of the least-squares line in t of each cell."""
    over = Window.partitionBy("cell")
    t = F.when(F.col("value").isNotNull(), F.col("t").cast("double"))
    fit = F.regr_intercept("value", t).over(over) + F.regr_slope("value", t).over(over) * F.col("t")
    return field.withColumn("value", F.col("value") - fit)


def lag_pair(field: DataFrame, lag: int) -> DataFrame:
    """x0 = x(t), x1 = x(t + lag)."""
    over = Window.partitionBy("cell").orderBy("t")
    return field.select("t", "cell", F.col("value").alias("x0"), F.lead("value", lag).over(over).alias("x1"), F.lead("t", lag).over(over).alias("t1")).where("t1 is not null").drop("t1")


def persistence(field: DataFrame, lag: int) -> DataFrame:
    """Skill by cell of taking x(t) as the forecast of x(t + lag): r and ce."""
    pairs = lag_pair(field, lag)
    return pairs.groupBy("cell").agg(pearson(F.col("x0"), F.col("x1")).alias("r"), (1 - F.try_divide(F.sum(F.pow(F.col("x1") - F.col("x0"), 2)), F.var_pop("x1") * F.count("x1"))).alias("ce"))


def years_of(field: DataFrame, base_year: int, per_year: int) -> DataFrame:
    """Calendar year of each sample after the first year."""
    return field.select("t").distinct().where(F.col("t") >= per_year).select("t", (F.floor(F.col("t") / per_year) + base_year).cast("long").alias("year"))
