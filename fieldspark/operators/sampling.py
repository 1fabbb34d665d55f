"""Random train and test splits that do not leak across lags."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import draw


def test_starts(field: DataFrame, n: int, size: float | int, lags: list[int] | None = None, seed: int = 1) -> DataFrame:
    """Start samples of the test set, drawn without replacement from those whose lags exist."""
    lags, last = lags or [], max(lags or [0])
    if isinstance(size, float):
        if size * max(1, len(lags)) > 0.75:
            raise ValueError("the test set would take too much of the samples")
        size = math.ceil((n - last) * size)
    times = field.select("t").distinct().where(F.col("t") < n - last)
    return times.orderBy(draw(seed, F.col("t")), "t").limit(size)


def split(field: DataFrame, n: int, size: float | int, lags: list[int] | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test samples (lag, start, t), training times (t), and pairs (lag, t, t1) inside the training set."""
    lags = lags or []
    starts = test_starts(field, n, size, lags, seed)
    each = F.explode(F.array(*[F.lit(x) for x in [0, *lags]]))
    test = starts.select(each.alias("lag"), F.col("t").alias("start")).withColumn("t", F.col("start") + F.col("lag"))
    used = test.select("t").distinct()
    ahead = used
    for lag in lags:
        ahead = ahead.union(used.select((F.col("t") - lag).alias("t")))
    train = field.select("t").distinct().join(ahead.distinct(), "t", "left_anti")
    pairs = train.select(F.explode(F.array(*[F.lit(x) for x in lags or [0]])).alias("lag"), "t").withColumn("t1", F.col("t") + F.col("lag"))
    return test, train, pairs.join(train.select(F.col("t").alias("t1")), "t1", "left_semi").select("lag", "t", "t1")
