"""The linear inverse model: calibration, forecasts, modes and integration with noise.

States are (t, mode, value). Covariances are summed by the tasks, the algebra on modes by modes runs on the
driver, forecasts are a join and an aggregate, and integrations run some members to a task, segment by segment of time.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import stored
from .linalg import MOST, block_sum, canonical, collected, matrix_of, paired, rows_of, to_coo


@dataclass
class Model:
    g: np.ndarray
    lag: int
    lin: np.ndarray | None = None
    q_values: np.ndarray | None = None
    q_vectors: np.ndarray | None = None
    negative: int = 0
    rescale: float | None = None

    @property
    def l_is_real(self) -> bool:
        return self.lin is not None and bool(np.allclose(np.imag(self.lin), 0))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return to_coo(spark, self.g)

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {k: None if v is None else [np.real(v).tolist(), np.imag(v).tolist()] for k, v in (("g", self.g), ("lin", self.lin), ("q_values", self.q_values), ("q_vectors", self.q_vectors))}
        text = json.dumps({**parts, "lag": self.lag, "negative": self.negative, "rescale": self.rescale})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        d = json.loads(spark.read.text(path).first()[0])
        back = {k: None if d[k] is None else (np.array(d[k][0]) + 1j * np.array(d[k][1]) if np.any(d[k][1]) else np.array(d[k][0])) for k in ("g", "lin", "q_values", "q_vectors")}
        return cls(lag=d["lag"], negative=d["negative"], rescale=d["rescale"], **back)


def decays(g: np.ndarray, lag: int) -> bool:
    """Whether no rate of a mode of G is zero or above."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return not (np.real(np.log(np.linalg.eigvals(g)) / lag) >= 0).any()


def fit(state: DataFrame, lag: int = 1, noise: bool = False, max_negative: int = 5, tau1: DataFrame | None = None, settle: bool = False) -> Model:
    """G from x(t + lag) and x(t); with ``noise`` also L and the noise covariance's eigenpairs.

    tau1: states that follow those of ``state`` with the same t after ``lag``, where they come from elsewhere; other
    modes or another number of samples raise ValueError. Both covariances come from one pass over the pairs.
    settle: if a mode does not decay, C(0) is the mean of the covariances of starts and of ends, and a warning says so:
    for a left eigenvector u of G its eigenvalue is u C(lag) u / u C(0) u, which is then 1 at most (Cauchy and Schwarz).
    A model that does not decay raises ValueError.
    """
    x = rows_of(state, "t", "mode")
    m = len(x.names)
    if m > MOST:
        raise ValueError(f"{m} modes are too many for the driver; reduce the state first")
    if tau1 is None:
        pairs = paired(x, lag)
    else:
        y = rows_of(tau1, "t", "mode")
        if (x.n, x.names.tolist()) != (y.n, y.names.tolist()):
            raise ValueError("the two states have different shapes")
        pairs = x.table.join(y.table.select("key", F.col("x").alias("y")), "key").select("key", "x", "y")

    parts = 2 + settle

    def products(batch):
        a, b = matrix_of(batch.column(1)), matrix_of(batch.column(2))
        return np.concatenate([b.T @ a, a.T @ a, *[b.T @ b] * settle, np.full((1, m), float(len(a)))])

    sums = collected(block_sum(pairs, products, (parts * m + 1, m)), (parts * m + 1, m), 2 * m)
    ct, c0, n = sums[:m], sums[m : 2 * m], sums[-1, 0]
    g = ct @ np.linalg.pinv(c0)
    if settle and not decays(g, lag):
        warnings.warn(f"a mode grows by {np.abs(np.linalg.eigvals(g)).max():.4f}: C(0) is taken of starts and ends", stacklevel=2)
        c0 = (c0 + sums[2 * m : 3 * m]) / 2
        g = ct @ np.linalg.pinv(c0)
    if not decays(g, lag):
        raise ValueError("the model is not stable: some mode does not decay")
    model = Model(g, lag)
    return fit_noise(model, c0 / (n - 1), max_negative) if noise else model


def fit_noise(model: Model, c0: np.ndarray, max_negative: int = 5) -> Model:
    values, vectors = np.linalg.eig(model.g)
    if np.isrealobj(values) and (values <= 0).any():
        raise ValueError("an eigenvalue is real and not positive: its logarithm does not exist")
    lin = vectors @ np.diag(np.log(values) / model.lag) @ np.linalg.pinv(vectors)
    if np.abs(np.imag(lin)).max() <= 1e-12 * np.abs(lin).max():
        lin = np.real(lin)
    q = -(lin @ c0 + c0 @ lin.conj().T)
    if np.abs(q - q.conj().T).max() > 1e-10 * np.abs(q).max():
        raise ValueError("the noise covariance is not Hermitian")
    q_values, q_vectors = np.linalg.eigh((q + q.conj().T) / 2)
    q_values, q_vectors = q_values[::-1], q_vectors[:, ::-1]
    if np.isrealobj(q_vectors):
        q_vectors = canonical(q_vectors)
    negative = int((q_values < 0).sum())
    if negative > max_negative:
        raise ValueError("too many negative eigenvalues of the noise covariance")
    scale = None
    if negative:
        good = q_values > 0
        scale = float(q_values.sum() / q_values[good].sum())
        q_values, q_vectors = q_values[good] * scale, q_vectors[:, good]
    model.lin, model.q_values, model.q_vectors, model.negative, model.rescale = lin, q_values, q_vectors, negative, scale
    return model


#: Entries of the powers that every task may get.
SENT_ENTRIES = 1 << 22


def powers(spark: SparkSession, g: np.ndarray, leads: list[int]) -> DataFrame:
    """(lead, i, j, g) of integer powers of G."""
    i, j = np.divmod(np.arange(g.size), max(len(g), 1))
    parts = [pa.table({"lead": pa.array(np.full(g.size, lead, np.int32)), "i": pa.array(i), "j": pa.array(j), "g": pa.array(np.linalg.matrix_power(g, lead).ravel())}) for lead in leads]
    return spark.createDataFrame(pa.concat_tables(parts)) if parts else spark.createDataFrame([], "lead int, i long, j long, g double")


def forecast(state: DataFrame, g: np.ndarray, leads: list[int]) -> DataFrame:
    """(lead, t, mode, value): G^lead x(t)."""
    p = powers(state.sparkSession, g, leads)
    small = g.size * len(leads) <= SENT_ENTRIES  # else both sides are dealt by mode
    joined = state.join(F.broadcast(p) if small else p, state.mode == p.j)
    return joined.groupBy("lead", "t", F.col("i").alias("mode")).agg(F.sum(F.col("g") * F.col("value")).alias("value"))


def save_by_lead(forecasts: DataFrame, path: str) -> None:
    """A folder for each lead; existing ones are replaced."""
    forecasts.write.mode("overwrite").partitionBy("lead").parquet(path)


def eigen_modes(spark: SparkSession, model: Model) -> DataFrame:
    """(mode, re, im, efold, period) of the decay rates, slowest first."""
    rate = np.log(np.linalg.eigvals(model.g).astype(complex)) / model.lag
    rate = rate[np.lexsort((-rate.imag, -rate.real))]
    return spark.createDataFrame([(k, float(r.real), float(r.imag), float(-1 / r.real), float(2 * np.pi / abs(r.imag)) if abs(r.imag) > 1e-12 else None) for k, r in enumerate(rate)], "mode int, re double, im double, efold double, period double")


def orthogonal(v: np.ndarray) -> np.ndarray:
    """A complex vector turned and scaled so that its real part has norm 1, is orthogonal to the imaginary part and not longer."""
    a, b = np.real(v), np.imag(v)
    theta = -0.5 * np.arctan2(2 * a @ b, a @ a - b @ b)
    best = min((v * np.exp(1j * t) for t in (theta, theta + np.pi / 2)), key=lambda x: np.linalg.norm(x.real))
    if np.linalg.norm(best.real) == 0:
        raise ValueError("the vector has no two independent parts")
    return best / np.linalg.norm(best.real)


def orthogonal_modes(spark: SparkSession, model: Model) -> DataFrame:
    """(mode, aa, ab, bb): products of the parts of the turned eigenvectors of G, real ones taken with the next; modes by modes."""
    values, vectors = np.linalg.eig(model.g)
    real = np.isrealobj(vectors)
    made = [orthogonal(vectors[:, k] + (1j * vectors[:, (k + 1) % vectors.shape[1]] if real else 0)) for k in range(vectors.shape[1]) if real or np.abs(vectors[:, k].imag).max() > 1e-12]
    return spark.createDataFrame([(k, float(v.real @ v.real), float(v.real @ v.imag), float(v.imag @ v.imag)) for k, v in enumerate(made)], "mode int, aa double, ab double, bb double")


def noise_modes(spark: SparkSession, model: Model, loadings: DataFrame) -> DataFrame:
    """Noise patterns on cells: basis times the scaled eigenvectors of the noise covariance."""
    m = np.real(model.q_vectors * model.q_values)
    own = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "cell long, mode int, loading double")
    from .linalg import chain

    return chain(loadings, own)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser: two multiplications that leave no visible pattern in counters."""
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x7FEB352D)
    x = (x ^ x >> np.uint32(15)) * np.uint32(0x846CA68B)
    return x ^ x >> np.uint32(16)


def normals(seed: int, members: np.ndarray | int, unit: int, samples: int, first: int, steps: int, k: int) -> np.ndarray:
    """Standard normal numbers (steps x members x samples x k, or for one member steps x samples x k) by counters: the
    same for any split of the work, and in SQL.

    Two 32-bit words name the stream of a member, a unit of time and a sample; a counter of step, mode and part
    runs through it; Box and Muller's formula makes a normal number of two parts.
    """
    word = lambda x: np.atleast_1d(np.asarray(x)).astype(np.uint64).astype(np.uint32)
    one = scrambled(scrambled(word(seed) + np.uint32(0x9E3779B9)) + word(members))
    two = scrambled(scrambled(word(unit) + np.uint32(0x85EBCA6B)) + word(np.arange(samples)))
    counter = word(np.arange(first * k * 2, (first + steps) * k * 2)).reshape(steps, 1, 1, k, 2)
    x = scrambled(scrambled(counter + one[:, None, None, None]) ^ two[:, None, None])
    u = (x.astype(np.float64) + 0.5) / 4294967296.0
    out = np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1])
    return out if np.ndim(members) else out[:, 0]


def integrate(model: Model, x: np.ndarray, members: np.ndarray, first: int, length: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last midpoints and means of units first .. first + length - 1, and state and midpoint after them.

    x: state and midpoint before (2 x members x samples x modes). A step goes from x to x + L x dt + E sqrt(Q dt) n;
    the reported state is the midpoint, and a unit's mean takes the one before its first step along.
    """
    dt = 1.0 / steps
    push = model.q_vectors * np.sqrt(model.q_values * dt)
    kind = complex if np.iscomplexobj(model.lin) or np.iscomplexobj(push) else float
    now, mid = (x if kind is complex else x.real).astype(kind)
    drift = model.lin.T * dt
    some = max(1, 1_000_000 // max(1, now.shape[0] * now.shape[1] * push.shape[1]))
    ends, means = [], []
    for unit in range(first, first + length):
        total = np.real(mid).copy()
        for step in range(steps):
            if step % some == 0:
                kicks = normals(seed, members, unit, now.shape[1], step, min(some, steps - step), push.shape[1]) @ push.T
            new = now + now @ drift + kicks[step % some]
            mid = (now + new) / 2
            now = new
            total += np.real(mid)
        ends.append(np.real(mid).copy())
        means.append(total / (steps + 1))
    return np.array(ends), np.array(means), now, mid


#: Units of time after which states are written, so that a lost member goes on from there.
SEGMENT = 100


def ensemble(spark: SparkSession, model: Model, x0: np.ndarray, members: int, length: int = 1, steps: int = 1440, seed: int = 0, segment: int = SEGMENT) -> DataFrame:
    """(member, unit, sample, mode, last, mean) of integrations from x0, each member with its own stream of noise.

    Members go through a segment of units together with those of their task and hand their states over in a stored
    table, from which the next segment starts: a task that is lost repeats one segment of its members.
    """
    x0 = np.atleast_2d(x0)
    start = np.stack([x0, x0]).astype(complex).tobytes()
    state = spark.range(0, members, 1, max(1, min(64, members // 8))).select(F.col("id").alias("member"), F.lit(0).alias("unit"), F.lit(start).alias("state"))
    parts = []
    for first in range(0, length, segment):
        units = min(segment, length - first)

        def run(batches: Iterator[pa.RecordBatch], first=first, units=units) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = batch.column(0).to_numpy()
                    x = np.stack([np.frombuffer(b.as_buffer(), complex).reshape(2, *x0.shape) for b in batch.column(1)], axis=1)
                    ends, means, now, mid = integrate(model, x, own, first, units, steps, seed)
                    last = [np.stack([now[k], mid[k]]).astype(complex).tobytes() for k in range(len(own))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([first] * len(own), pa.int32()), pa.array(last, pa.binary()), pa.array([ends[:, k].tobytes() for k in range(len(own))], pa.binary()), pa.array([means[:, k].tobytes() for k in range(len(own))], pa.binary())], names=["member", "unit", "state", "ends", "means"])

        done = stored(state.select("member", "state").mapInArrow(run, "member long, unit int, state binary, ends binary, means binary"), "segment")
        parts.append(done)
        state = done.select("member", "state")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends, means = (np.frombuffer(batch.column(c)[k].as_buffer(), np.float64).reshape(-1, *x0.shape) for c in (2, 3))
                unit, sample, mode = np.indices(ends.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ends.size, batch.column(0)[k].as_py(), np.int32)), *[pa.array((a.ravel() + b).astype(np.int32)) for a, b in ((unit, batch.column(1)[k].as_py() + 1), (sample, 0), (mode, 0))], pa.array(ends.ravel()), pa.array(means.ravel())], names=["member", "unit", "sample", "mode", "last", "mean"])

    return reduce(DataFrame.union, parts).select("member", "unit", "ends", "means").mapInArrow(opened, "member int, unit int, sample int, mode int, last double, mean double")


def cross_forecast(model: Model, own: list[str], other: list[str], features: DataFrame, loadings: DataFrame) -> DataFrame:
    """Lead-1 forecast of another experiment's features in this model's basis; the variables must come in one order."""
    if own != other:
        raise ValueError("the variables of the two states differ")
    from .state import to_features, to_modes

    ahead = forecast(to_modes(features, loadings), model.g, [1])
    return to_features(ahead.drop("lead"), loadings)


__all__ = ["Model", "canonical", "cross_forecast", "eigen_modes", "ensemble", "fit", "fit_noise", "forecast", "integrate", "noise_modes", "orthogonal", "powers"]
