"""Composed jobs: verification of a perfect-model forecast, of an ensemble, and long integrations as index series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensemble, linalg, verify
from ..operators.spatial import ENSO_BOX, PDO_BOX, apply_mask, box

INDICES = ("glob_mean", "enso", "pdo")


def weights(grid: DataFrame, index: str, field: DataFrame | None = None) -> DataFrame:
    """(cell, w) of an index: areas, the box's cells, or the leading mode of the box. An unknown index raises KeyError."""
    if index == "glob_mean":
        return grid.select("cell", F.col("cell_area").alias("w"))
    if index == "enso":
        return box(grid, ENSO_BOX).select("cell", F.lit(1.0).alias("w"))
    if index == "pdo":
        loadings, _ = linalg.eof(apply_mask(field, box(grid, PDO_BOX)), 1)
        return loadings.select("cell", F.col("loading").alias("w"))
    raise KeyError(index)


def index_series(field: DataFrame, w: DataFrame, index: str) -> DataFrame:
    """(t, value): a normalised mean, or for the leading mode the plain product."""
    joined = field.join(w, "cell").groupBy("t").agg(F.sum(F.col("value") * F.col("w")).alias("s"), F.sum("w").alias("n"))
    return joined.select("t", (F.col("s") if index == "pdo" else F.try_divide("s", "n")).alias("value"))


def modes_index(pcs: DataFrame, loadings: DataFrame, w: DataFrame, index: str) -> DataFrame:
    """As index_series for a field in modes: the weights go through the basis once, the grid is never rebuilt."""
    factor = loadings.join(w, "cell").groupBy("mode").agg(F.sum(F.col("loading") * F.col("w")).alias("f"), F.sum("w").alias("n"))
    f = F.col("f") if index == "pdo" else F.try_divide(F.col("f"), F.col("n"))
    return pcs.join(factor.select("mode", f.alias("f")), "mode").groupBy("t").agg(F.sum(F.col("value") * F.col("f")).alias("value"))


def paired(forecast: DataFrame, truth: DataFrame, lead: int, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """(t, …, f, o): the forecast made at t and the truth at t + lead."""
    later = truth.withColumn("t", F.col("t") - lead).withColumnRenamed("value", "o")
    return forecast.withColumnRenamed("value", "f").join(later, list(keys))


def renumbered(pairs: DataFrame, first: int) -> DataFrame:
    return pairs.withColumn("t", F.col("t") - first)


def perfect_forecast(pcs: DataFrame, forecast: DataFrame, loadings: DataFrame, grid: DataFrame, field: DataFrame, lead: int, n: int, first: int = 0, iterations: int = 10_000, name: tuple[str, str] = ("field", "none")) -> DataFrame:
    """Rows of the verification table for each index, and one of area-weighted field means with no bounds.

    pcs and forecast are (t, mode, value) of the truth and of the forecast with ``lead``; n samples from ``first``
    have a truth.
    """
    rows = []
    for index in INDICES:
        w = weights(grid, index, field)
        truth, ahead = modes_index(pcs, loadings, w, index), modes_index(forecast, loadings, w, index)
        model = renumbered(paired(ahead, truth, lead), first)
        persisted = renumbered(paired(truth, truth, lead), first)
        rows.append(verify.verification_table(model, persisted, n, iterations, (*name, index)))
    cells = verify.skill(paired(linalg.reconstruct(forecast, loadings), linalg.reconstruct(pcs, loadings), lead, ("t", "cell")))
    same = linalg.reconstruct(pcs, loadings)
    persisted = verify.skill(paired(same, same, lead, ("t", "cell")))
    means = pcs.sparkSession.createDataFrame([(*name, "spatial_gm")], "variable string, average string, scalar string")
    for prefix, frame in (("", cells), ("auto1_", persisted)):
        for metric, column in (("r", "lac"), ("ce", "ce")):
            means = means.join(F.broadcast(verify.weighted_mean(frame, grid, column).withColumnRenamed(column, f"{prefix}{metric}")))  # one row
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).unionByName(means, allowMissingColumns=True)


def ensemble_report(members: DataFrame, truth: DataFrame, n: int, iterations: int = 1000) -> dict[str, DataFrame]:
    """Calibration ratio, rank histogram and reliability with bounds of a standardised index."""
    out = {"calibration": ensemble.calibration(members, truth), "rank_histogram": ensemble.rank_histogram(members, truth)}
    for kind in ("upper", "lower"):
        probs = ensemble.event_probability(members, truth, kind)
        out[f"reliability_{kind}"] = ensemble.reliability(probs).join(ensemble.reliability_bounds(probs, n, iterations), "bin")
    return out


def long_index(integration: DataFrame, loadings: DataFrame, w: DataFrame, index: str) -> DataFrame:
    """(member, t, value): an index of the yearly means of a long integration (member, unit, sample, mode, last, mean)."""
    factor = loadings.join(w, "cell").groupBy("mode").agg(F.sum(F.col("loading") * F.col("w")).alias("f"), F.sum("w").alias("n"))
    f = F.col("f") if index == "pdo" else F.try_divide(F.col("f"), F.col("n"))
    return integration.join(factor.select("mode", f.alias("f")), "mode").groupBy("member", F.col("unit").alias("t")).agg(F.sum(F.col("mean") * F.col("f")).alias("value"))


def standardized_by(series: DataFrame, truth: DataFrame) -> DataFrame:
    """A series in units of the truth's sample deviation."""
    std = truth.agg(F.stddev_samp("value").alias("__s"))
    return series.join(F.broadcast(std)).withColumn("value", F.try_divide("value", "__s")).drop("__s")  # one row


__all__ = ["INDICES", "ensemble_report", "index_series", "long_index", "modes_index", "paired", "perfect_forecast", "standardized_by", "weights"]
