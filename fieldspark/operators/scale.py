"""Standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .spatial import area_weight_lat
from .temporal import anomaly, by_cell, detrend


def field_factor(field: DataFrame) -> DataFrame:
    """One row: 1 / sqrt of the sum over cells of their sample variance."""
    return field.groupBy("cell").agg(F.var_samp("value").alias("v")).agg(ratio(F.lit(1.0), F.sqrt(F.sum("v"))).alias("factor"))


def standardize_field(field: DataFrame, factor: DataFrame | float | None = None) -> DataFrame:
    """The whole field times one factor: its own, a given number, or another field's."""
    if isinstance(factor, (int, float)):
        return field.withColumn("value", F.col("value") * F.lit(float(factor)))
    one = field_factor(field) if factor is None else factor
    return field.join(F.broadcast(one)).select("t", "cell", (F.col("value") * F.col("factor")).alias("value"))  # one row


def unstandardize(field: DataFrame, factor: DataFrame) -> DataFrame:
    return field.join(F.broadcast(factor)).select("t", "cell", ratio(F.col("value"), F.col("factor")).alias("value"))  # one row


def standardize_series(field: DataFrame) -> DataFrame:
    """(x - mean) / sample deviation of each cell."""
    over = Window.partitionBy("cell")
    return field.withColumn("value", ratio(F.col("value") - F.avg("value").over(over), F.stddev_samp("value").over(over)))


def prepare(field: DataFrame, grid: DataFrame, year_len: int = 12, done: tuple[str, ...] = ()) -> tuple[DataFrame, tuple[str, ...]]:
    """Anomaly, detrending and area weights, each skipped if it stands in the history; one exchange by cell."""
    field = by_cell(field)
    for name, step in (("anomaly", lambda f: anomaly(f, year_len)), ("detrend", detrend), ("area_weight", lambda f: area_weight_lat(f, grid))):
        if name not in done:
            field, done = step(field), (*done, name)
    return field, done


class Stages:
    """Named stages of a field (all lazy); the last one is current, and any can be gone back to."""

    def __init__(self, field: DataFrame, name: str = "orig"):
        self.kept, self.at = {name: field}, name

    def put(self, name: str, field: DataFrame) -> DataFrame:
        self.kept[name], self.at = field, name
        return field

    @property
    def current(self) -> DataFrame:
        return self.kept[self.at]

    def reset(self, name: str) -> DataFrame:
        """Makes a stage current again; an unknown one raises KeyError."""
        if name not in self.kept:
            raise KeyError(name)
        self.at = name
        return self.current


def prepare_stages(field: DataFrame, grid: DataFrame, year_len: int = 12) -> Stages:
    """As ``prepare``, with every stage kept by name."""
    stages = Stages(by_cell(field))
    stages.put("anomaly", anomaly(stages.current, year_len))
    stages.put("detrended", detrend(stages.current))
    stages.put("area_weighted", area_weight_lat(stages.current, grid))
    return stages
