"""Hold-out resampling of linear inverse models: many models of one state, each fitted without some blocks of times.

One pass over the state leaves, for each block of times, the sums of products at lag 0 and at the lag of the model, by
the block of the earlier and of the later sample of a pair. A trial's sums are the totals less those of the pairs that
touch a block that it holds out, so its model costs its own blocks only and no second pass; pairs across the edge of
a block that is held out are held out too. Models and held-out forecasts are made in tasks, a trial to a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import draw
from ..sources.store import small_batches, stored
from .linalg import matrix_of, paired, rows_of

#: Modes whose matrices travel, one or two to a block of times.
MOST_MODES = 1000


def held_blocks(spark: SparkSession, blocks: int, share: float, trials: int, seed: int = 3) -> DataFrame:
    """(trial, block, first): a run of blocks for each trial, ``share`` of all, from a drawn first one."""
    m = math.ceil(blocks * share)
    if not 0 < m < blocks:
        raise ValueError("a trial needs blocks to hold out and blocks to keep")
    first = (draw(seed, F.col("id")) % (blocks - m + 1)).cast("long")
    return spark.range(trials).select(F.col("id").alias("trial"), first.alias("first"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k")).select("trial", (F.col("first") + F.col("k")).alias("block"), "first")


def block_sums(state: DataFrame, lag: int, size: int, first: int = 0) -> DataFrame:
    """(a, b, n, sums): for pairs t, t + lag in blocks a and b their number and, as bytes, sum x x' and sum y x'.

    state: (t, mode, value), complete; block: (t - first) div size.
    """
    r = rows_of(state, "t", "mode")
    k = len(r.names)
    if k > MOST_MODES:
        raise ValueError(f"{k} modes are too many")
    block = lambda c: F.floor((c - first) / size).cast("long")
    pairs = paired(r, lag).select(block(F.col("key")).alias("a"), block(F.col("key") + lag).alias("b"), "x", "y")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(j).to_numpy() for j in range(2))
            x, y = matrix_of(batch.column(2)), matrix_of(batch.column(3))
            for p in set(zip(a.tolist(), b.tolist())):
                at = (a == p[0]) & (b == p[1])
                own = np.stack([x[at].T @ x[at], y[at].T @ x[at]])
                if p in sums:
                    sums[p][0] += int(at.sum())
                    sums[p][1] += own
                elif len(sums) < 64:
                    sums[p] = [int(at.sum()), own]
                else:  # rows come in no order: what is held stays small
                    yield _row({p: [int(at.sum()), own]})
        yield _row(sums)

    ddl = "a long, b long, n long, sums binary"
    with small_batches(state.sparkSession, 2 * k):
        return stored(_added(pairs.mapInArrow(part, ddl), ("a", "b")), "blocks")


def _row(sums: dict) -> pa.RecordBatch:
    keys = [pa.array([p[j] for p in sums], pa.int64()) for j in range(2)]
    return pa.RecordBatch.from_arrays([*keys, pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1].tobytes() for v in sums.values()], pa.binary())], names=["a", "b", "n", "sums"])


def _added(table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Numbers and sums added up by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0, None
        row = lambda: pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in at], pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=[*by, "n", "sums"])
        for batch in batches:
            for k in range(batch.num_rows):
                key = tuple(batch.column(j)[k].as_py() for j in range(len(by)))
                own = np.frombuffer(batch.column(len(by) + 1)[k].as_buffer(), np.float64)
                if key != at:
                    if at is not None:
                        yield row()
                    at, n, total = key, 0, np.zeros_like(own)
                n += batch.column(len(by))[k].as_py()
                total = total + own
        if at is not None:
            yield row()

    return table.select(*by, "n", "sums").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, ", ".join(f"{c} long" for c in by) + ", n long, sums binary")


def refits(sums: DataFrame, held: DataFrame) -> DataFrame:
    """(trial, n, g): for each trial the pairs that it keeps and its model G as bytes, from ``block_sums`` and (trial, block)."""
    own = held.select("trial", "block").distinct()
    touched = own.join(sums, own.block == sums.a).union(own.join(sums, (own.block == sums.b) & (sums.a != sums.b))).select("trial", "a", "b", "n", "sums").dropDuplicates(["trial", "a", "b"])
    total = _added(sums.withColumn("trial", F.lit(0).cast("long")), ("trial",)).select(F.col("n").alias("all_n"), F.col("sums").alias("all_sums"))
    less = own.select("trial").distinct().join(_added(touched, ("trial",)), "trial", "left").join(F.broadcast(total))  # one row of 2 k x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, g = [], []
            for k in range(batch.num_rows):
                whole = np.frombuffer(batch.column(4)[k].as_buffer(), np.float64)
                out = np.frombuffer(batch.column(2)[k].as_buffer(), np.float64) if batch.column(2)[k].is_valid else 0.0
                side = math.isqrt(len(whole) // 2)
                c0, c1 = (whole - out).reshape(2, side, side)
                g.append((c1 @ np.linalg.pinv(c0, hermitian=True)).tobytes())
                n.append(batch.column(3)[k].as_py() - (batch.column(1)[k].as_py() or 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(g, pa.binary())], names=["trial", "n", "g"])

    return less.select("trial", "n", "sums", "all_n", "all_sums").mapInArrow(run, "trial long, n long, g binary")


def entries(models: DataFrame) -> DataFrame:
    """(trial, i, j, g) of the models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trial, g in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(g.as_buffer(), np.float64)
                i, j = np.divmod(np.arange(len(own)), math.isqrt(len(own)))
                yield pa.RecordBatch.from_arrays([pa.array([trial.as_py()] * len(own)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own)], names=["trial", "i", "j", "g"])

    return models.select("trial", "g").mapInArrow(run, "trial long, i int, j int, g double")


def held_forecasts(state: DataFrame, models: DataFrame, held: DataFrame, size: int, leads: list[int], first: int = 0) -> DataFrame:
    """(trial, lead, s, mode, value): forecasts of each trial's model from the samples it held out, s counted from its first."""
    r = rows_of(state, "t", "mode")
    x = r.table.select(F.floor((F.col("key") - first) / size).cast("long").alias("block"), (F.col("key") - first).alias("at"), "x")
    starts = x.join(held, "block").join(models.select("trial", "g"), "trial").select("trial", (F.col("at") - F.col("first") * size).alias("s"), "x", "g")
    names = r.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                now = batch.column(2)[k].values.to_numpy()
                g = np.frombuffer(batch.column(3)[k].as_buffer(), np.float64).reshape(len(now), -1)
                out = np.stack([np.linalg.matrix_power(g, lead) @ now for lead in leads])
                n = out.size
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * n), pa.array(np.repeat(leads, len(now)).astype(np.int32)), pa.array([batch.column(1)[k].as_py()] * n), pa.array(np.tile(names, len(leads))), pa.array(out.ravel())], names=["trial", "lead", "s", "mode", "value"])

    with small_batches(state.sparkSession, len(names) * (len(names) + 1)):
        return starts.mapInArrow(run, "trial long, lead int, s long, mode long, value double")
