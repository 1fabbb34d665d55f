"""Skill by cell, significance, trials, bootstrap bounds and the verification table. Pairs are (t, cell, f, o)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import draw, pearson, ratio
from ..sources.store import small_batches, stored

METRICS = ("r", "ce")


def mse_of(f: Column, o: Column) -> Column:
    return F.avg(F.pow(o - f, 2))


def ce_of(f: Column, o: Column) -> Column:
    """1 - sum of squared errors / sum of squared deviations of o; NULL where o does not vary."""
    return 1 - ratio(F.sum(F.pow(o - f, 2)), F.var_pop(o) * F.count(o))


def skill(pairs: DataFrame, by: str = "cell") -> DataFrame:
    """lac (local anomaly correlation), mse and ce of each group in one aggregate."""
    f, o = F.col("f"), F.col("o")
    return pairs.groupBy(by).agg(pearson(f, o).alias("lac"), mse_of(f, o).alias("mse"), ce_of(f, o).alias("ce"))


def n_eff(pairs: DataFrame, two: bool = True) -> DataFrame:
    """Effective number of samples from the lag-1 correlations r1 of both series (or of f alone)."""
    over = Window.partitionBy("cell").orderBy("t")
    p = pairs.select("cell", "f", "o", F.lead("f").over(over).alias("f1"), F.lead("o").over(over).alias("o1"))
    a, b = pearson(F.col("f"), F.col("f1")), pearson(F.col("o"), F.col("o1"))
    r = p.groupBy("cell").agg((a * (b if two else 1)).alias("rr"), F.count("*").alias("n"))
    return r.select("cell", (F.col("n") * ratio(1 - F.col("rr"), 1 + F.col("rr"))).alias("n_eff"))


def significance(pairs: DataFrame) -> DataFrame:
    """(cell, lac, n_eff, signif): |r| < 0.5 against 2 / sqrt(n_eff), else Fisher's z against 2 / sqrt(n_eff - 3)."""
    s = skill(pairs).select("cell", "lac").join(n_eff(pairs), "cell")
    r, n = F.col("lac"), F.col("n_eff")
    z = 0.5 * F.log(ratio(1 + r, 1 - r))
    large = F.when(n > 3, F.abs(z) > 2 / F.sqrt(n - 3)).otherwise(F.lit(False))
    return s.withColumn("signif", F.when(F.abs(r) < 0.5, F.when(n > 0, F.abs(r) > 2 / F.sqrt(n)).otherwise(False)).otherwise(large))


def trial_forecast(trials: DataFrame, loadings: DataFrame, samples: int) -> DataFrame:
    """(t, cell, value) of trials (trial, s, mode, value): modes to cells, trials stacked in time."""
    joined = trials.join(loadings, "mode")
    return joined.groupBy("trial", "s", "cell").agg(F.sum(F.col("value") * F.col("loading")).alias("value")).select((F.col("trial") * samples + F.col("s")).alias("t"), "cell", "value")


def trial_obs(obs: DataFrame, starts: DataFrame, tau: int, samples: int) -> DataFrame:
    """For each trial (trial, start) the observations start + tau .. + samples - 1, stacked in time."""
    want = starts.select("trial", "start", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("s"))
    want = want.select((F.col("trial") * samples + F.col("s")).alias("__t"), (F.col("start") + tau + F.col("s")).alias("t"))
    return obs.join(want, "t").select(F.col("__t").alias("t"), "cell", "value")


def t_critical(spark: SparkSession, freedom: int, p: float = 0.05) -> float:
    """Two-sided critical value of Student's t, from the library that Spark brings along."""
    t = spark.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution(float(freedom))
    return float(t.inverseCumulativeProbability(1 - p / 2))


def trial_skill(pairs: DataFrame, samples: int, trials: int) -> DataFrame:
    """Means over trials of the skill in each trial, the t statistic of the correlations, and whether it is significant."""
    each = pairs.groupBy("cell", F.floor(F.col("t") / samples).alias("trial")).agg(pearson(F.col("f"), F.col("o")).alias("r"), ce_of(F.col("f"), F.col("o")).alias("ce"))
    t = ratio(F.avg("r") * F.sqrt(F.count("r")), F.stddev_samp("r"))
    out = each.groupBy("cell").agg(F.avg("r").alias("lac"), F.avg("ce").alias("ce"), t.alias("t_stat"))
    return out.withColumn("signif", F.abs("t_stat") >= t_critical(pairs.sparkSession, trials - 1))


#: Bytes of the matrix of counts that tasks hold at a time.
COUNT_BYTES = 64 << 20
MOMENTS = 10
BOUNDS = tuple(f"{m}_{c}" for m in METRICS for c in ("mean", "low", "high"))


def draw_counts(spark: SparkSession, iterations: int, n: int, seed: int, first: int = 0) -> np.ndarray:
    """How often each of n samples is drawn in iterations first .. first + iterations - 1, n draws each; 4 bytes a count at most."""
    drawn = spark.range(first, first + iterations).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (draw(seed, F.col("id"), k) % n).cast("int")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                counts = np.bincount(batch.column(1)[k].values.to_numpy(), minlength=n).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([counts.tobytes()], pa.binary())], names=["id", "counts"])

    out = np.empty((iterations, n), np.float32)
    with small_batches(spark, n):
        for r in drawn.mapInArrow(run, "id long, counts binary").toLocalIterator():
            out[r.id - first] = np.frombuffer(r.counts, np.float32)
    return out


def _moments(t: np.ndarray, f: np.ndarray, o: np.ndarray, n: int) -> np.ndarray:
    """Moments by sample (MOMENTS x n) of pairs that both are there, and of o where it is; deviations from the means."""
    has_o = np.isfinite(o)
    both = np.isfinite(f) & has_o
    error = np.where(both, o - f, 0.0)
    x = np.where(both, f - (f[both].mean() if both.any() else 0.0), 0.0)
    o = np.where(has_o, o - (o[has_o].mean() if has_o.any() else 0.0), 0.0)
    y = np.where(both, o, 0.0)
    rows = np.stack([both, x, y, x * x, y * y, x * y, error * error, has_o, o, o * o]).astype(np.float64)
    out = np.zeros((MOMENTS, n))
    np.add.at(out.T, t, rows.T)
    return out


def _scores(sums: np.ndarray) -> np.ndarray:
    """r and ce (2 x draws) from summed moments (MOMENTS x draws); NaN where a side does not vary."""
    n, x, y, xx, yy, xy, ee, m, o, oo = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy, vo = xx - x * x / n, yy - y * y / n, oo - o * o / m
        r = np.where((vx > 1e-13 * xx) & (vy > 1e-13 * yy), (xy - x * y / n) / np.sqrt(vx * vy), np.nan)
        return np.stack([r, np.where(vo > 1e-13 * oo, 1 - ee / vo, np.nan)])


def bootstraps(series: DataFrame, n: int, iterations: int = 10_000, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` and BOUNDS: the bootstrap means and the 2.5 and 97.5 percentiles of r and ce, of one draw of times for all groups.

    series: (by, t, f, o), t in 0 .. n - 1. A resample only counts how often each time comes, so its sums are the
    product of a matrix of counts, draws by times, with the times' moments: no row is made for a draw. Tasks hold
    at most COUNT_BYTES of counts; more draws than that take more passes, whose scores meet by group.
    """
    spark = series.sparkSession
    pack = F.struct(F.col("t").cast("int").alias("t"), F.col("f").cast("double").alias("f"), F.col("o").cast("double").alias("o"))
    groups = stored(series.where(F.col("t").between(0, n - 1)).groupBy(*by).agg(F.collect_list(pack).alias("p")).where(F.size("p") > 0).select(*by, *[F.col(f"p.{c}").alias(f"__{c}") for c in "tfo"]), "series")  # a group's own times
    keys = ", ".join(f"`{c}` {groups.schema[c].dataType.simpleString()}" for c in by)
    passes, step = [], max(1, COUNT_BYTES // (4 * max(n, 1)))
    for first in range(0, iterations, step):
        counts = spark.sparkContext.broadcast(draw_counts(spark, min(step, iterations - first), n, seed, first))  # COUNT_BYTES at most

        def run(batches: Iterator[pa.RecordBatch], counts=counts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for k in range(batch.num_rows):
                    t, f, o = (batch.column(len(by) + j)[k].values.to_numpy(zero_copy_only=False).astype(np.float64) for j in range(3))
                    m = _moments(t.astype(np.int64), f, o, n)
                    found.append(np.concatenate([_scores(m @ counts.value[a : a + 1024].T.astype(np.float64)) for a in range(0, len(counts.value), 1024)], axis=1).tobytes())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(found, pa.binary())], names=[*by, "scores"])

        with small_batches(spark, 3 * n + 2 * step):
            scored = groups.mapInArrow(run, f"{keys}, scores binary" if by else "scores binary")
            passes.append(scored if step >= iterations else stored(scored, "scores"))
    if len(passes) == 1:
        each = passes[0].withColumn("scores", F.array("scores"))
    else:
        each = reduce(DataFrame.union, passes).groupBy(*by).agg(F.collect_list("scores").alias("scores"))  # a group's own draws

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for scores in batch.column(len(by)):
                x = np.concatenate([np.frombuffer(b.as_buffer(), np.float64).reshape(2, -1) for b in scores.values], axis=1)
                row = []
                for m in x:
                    own = m[~np.isnan(m)]
                    row += [own.mean(), *np.percentile(own, [2.5, 97.5])] if len(own) else [None] * 3
                out.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *[pa.array([r[j] for r in out], pa.float64()) for j in range(len(BOUNDS))]], names=[*by, *BOUNDS])

    own = ", ".join(f"{c} double" for c in BOUNDS)
    with small_batches(spark, 2 * iterations):
        return stored(each.mapInArrow(bounds, f"{keys}, {own}" if by else own), "bounds")


def bootstrap(series: DataFrame, n: int, metric: str = "r", iterations: int = 10_000, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """The bootstrap mean and the percentiles (mean, low, high) of r or ce: one row, or one for each group of ``by``."""
    if metric not in METRICS:
        raise KeyError(metric)
    got = bootstraps(series, n, iterations, seed, by)
    return got.select(*by, *[F.col(f"{metric}_{c}").alias(c) for c in ("mean", "low", "high")])


def verification_table(series: DataFrame, persistence: DataFrame, n: int, iterations: int, keys: tuple[str, str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each group of ``by``) with three keys and r, ce and their persistence twins, each with its bounds."""
    out = series.sparkSession.createDataFrame([keys], "variable string, average string, scalar string")
    if by:
        out = series.select(*by).distinct().crossJoin(F.broadcast(out))
    for name, frame in (("", series), ("auto1_", persistence)):
        b = bootstraps(frame, n, iterations, by=by).select(*by, *[F.col(f"{m}_{c}").alias(f"{name}{m}{s}") for m in METRICS for c, s in (("mean", ""), ("low", "_low"), ("high", "_high"))])
        out = out.join(b, list(by), "left") if by else out.join(F.broadcast(b), how="left")  # one row each
    return out


def weighted_mean(skill_: DataFrame, grid: DataFrame, column: str) -> DataFrame:
    """Area-weighted mean of a metric over the cells that have it."""
    w = F.when(F.col(column).isNotNull(), F.col("cell_area"))
    return skill_.join(grid.select("cell", "cell_area"), "cell").agg(ratio(F.sum(F.col(column) * w), F.sum(w)).alias(column))
