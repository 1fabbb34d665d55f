"""State vectors of several variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import numbered
from .linalg import eof, project, reconstruct


def concat(fields: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """State (t, feature, value) and spans (var, start, stop) of fields with the same times, in the given order.

    A field's cells are numbered by their order; different numbers of times raise ValueError.
    """
    spark = next(iter(fields.values())).sparkSession
    start, states, spans, times = 0, [], [], set()
    for var, field in fields.items():
        ids = numbered(field, "cell", "feature", start)
        size = field.agg(F.countDistinct("t").alias("t"), F.countDistinct("cell").alias("cell")).first()
        times.add(size.t)
        states.append(field.join(ids, "cell").select("t", "feature", "value"))
        spans.append((var, start, start + size.cell))
        start += size.cell
    if len(times) > 1:
        raise ValueError("the fields have different numbers of times")
    state = states[0]
    for more in states[1:]:
        state = state.unionByName(more)
    return state, spark.createDataFrame(spans, "var string, start long, stop long")


def select_var(state: DataFrame, spans: DataFrame, var: str) -> DataFrame:
    """One variable's field out of a state or a forecast, extra columns included."""
    own = spans.where(F.col("var") == var)
    return state.join(F.broadcast(own), (F.col("feature") >= F.col("start")) & (F.col("feature") < F.col("stop"))).withColumn("cell", F.col("feature") - F.col("start")).drop("var", "start", "stop", "feature")


def as_field(state: DataFrame) -> DataFrame:
    return state.withColumnRenamed("feature", "cell")


def state_eofs(state: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    return eof(as_field(state), k)


def to_modes(state: DataFrame, loadings: DataFrame) -> DataFrame:
    return project(as_field(state), loadings)


def to_features(pcs: DataFrame, loadings: DataFrame, factors: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Back to features; with factors (var, factor) each variable is un-standardised."""
    out = reconstruct(pcs, loadings).withColumnRenamed("cell", "feature")
    if factors is None:
        return out
    own = spans.join(factors, "var")
    return out.join(F.broadcast(own), (F.col("feature") >= F.col("start")) & (F.col("feature") < F.col("stop"))).select("t", "feature", F.try_divide(F.col("value"), F.col("factor")).alias("value"))
