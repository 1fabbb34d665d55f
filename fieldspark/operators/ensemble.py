"""Ensemble diagnostics. Forecasts are (member, t, value), references (t, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import draw, ratio, uniform
from ..sources.store import small_batches, stored

#: Different probabilities (members and one) that tasks may get.
MOST_STEPS = 1 << 20

# Lower edges of the ten probability bins, as doubles.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def member_stats(fields: DataFrame) -> DataFrame:
    """Mean and sample deviation over members by (t, cell)."""
    return fields.groupBy("t", "cell").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def calibration(forecast: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean squared error of the ensemble mean over the mean ensemble variance: one row."""
    e = forecast.groupBy("t").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).join(reference.withColumnRenamed("value", "o"), "t")
    return e.agg(ratio(F.avg(F.pow(F.col("m") - F.col("o"), 2)), F.avg("v")).alias("ratio"))


def calibration_by_cell(forecast: DataFrame, reference: DataFrame) -> DataFrame:
    """As calibration for each cell of (member, t, cell, value)."""
    e = forecast.groupBy("t", "cell").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).join(reference.withColumnRenamed("value", "o"), ["t", "cell"])
    return e.groupBy("cell").agg(ratio(F.avg(F.pow(F.col("m") - F.col("o"), 2)), F.avg("v")).alias("ratio"))


def rank_histogram(forecast: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts of the ranks that occur: 1 + members not above the reference."""
    below = F.sum(F.when(F.col("value") <= F.col("o"), 1).otherwise(0)) + 1
    return forecast.join(reference.withColumnRenamed("value", "o"), "t").groupBy("t").agg(below.alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))


def event(value: Column, kind: str) -> Column:
    if kind not in ("upper", "lower"):
        raise ValueError(f"unknown event: {kind}")
    return value >= 0.5 if kind == "upper" else value <= -0.5


def event_probability(forecast: DataFrame, reference: DataFrame, kind: str) -> DataFrame:
    """(t, p, occurred)."""
    p = forecast.groupBy("t").agg(F.avg(F.when(event(F.col("value"), kind), 1.0).otherwise(0.0)).alias("p"))
    return p.join(reference.select("t", event(F.col("value"), kind).alias("occurred")), "t")


def bin_of(p: Column) -> Column:
    out = F.lit(-1)
    for edge in EDGES:
        out = out + F.when(p >= F.lit(edge), 1).otherwise(0)
    return out


def reliability(probs: DataFrame) -> DataFrame:
    """(bin, hit_rate, mean_p, n) for all ten bins; NULL where a bin is empty."""
    got = probs.groupBy(bin_of(F.col("p")).alias("bin")).agg(F.avg(F.when(F.col("occurred"), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("p").alias("mean_p"), F.count("*").alias("n"))
    every = probs.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", "hit_rate", "mean_p", F.coalesce("n", F.lit(0)).alias("n"))


def reliability_bounds(probs: DataFrame, n: int, iterations: int = 1000, seed: int = 11) -> DataFrame:
    """(bin, lower, upper): consistency bounds around the mean of resampled hit rates; NULL if any draw leaves the bin empty.

    n probabilities are drawn with replacement, events from them. All that a draw needs is the histogram of the
    different probabilities, one more than members at most: samples are numbered in the order of their probability,
    so a drawn number is looked up in its steps, and no row is made for a draw and sample.
    """
    steps = probs.groupBy("p").agg(F.count("*").alias("m")).orderBy("p").limit(MOST_STEPS + 1).collect()
    if len(steps) > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS} different probabilities")
    p, ends = np.array([r.p for r in steps], float), np.cumsum([r.m for r in steps])
    bins = np.searchsorted(EDGES, p, "right") - 1
    k = F.sequence(F.lit(0), F.lit(n - 1))
    drawn = probs.sparkSession.range(iterations).select(F.transform(k, lambda k: (draw(seed, F.col("id"), k) % n).cast("int")).alias("at"), F.transform(k, lambda k: uniform(seed + 1, F.col("id"), k)).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, u in zip(batch.column(0), batch.column(1), strict=True):
                own = np.searchsorted(ends, at.values.to_numpy(), "right")
                fine = own < len(p)  # fewer probabilities than n: the rest are none
                own, u = own[fine], u.values.to_numpy()[fine]
                size = np.bincount(bins[own], minlength=10)
                hits = np.bincount(bins[own], u < p[own], minlength=10)
                some = np.flatnonzero(size)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(hits[some] / size[some])], names=["bin", "h"])

    with small_batches(probs.sparkSession, 2 * n):
        got = stored(drawn.mapInArrow(run, "bin int, h double"), "rates")
    q = F.percentile("h", F.array(F.lit(0.025), F.lit(0.975)))
    by = got.groupBy("bin").agg(F.avg("h").alias("m"), q.alias("q"), F.count("*").alias("n")).where(F.col("n") == iterations)
    every = probs.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return every.join(by, "bin", "left").select("bin", (F.col("m") - F.col("q")[0]).alias("lower"), (F.col("q")[1] - F.col("m")).alias("upper"))
