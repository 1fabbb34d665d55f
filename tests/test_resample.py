import numpy as np
import pytest

from fieldspark.operators import lim, resample

K, N, SIZE = 4, 203, 10


def state(spark, first=0):
    rng = np.random.default_rng(4)
    g = np.diag([0.9, 0.7, 0.6, 0.5]) + 0.05 * rng.standard_normal((K, K))
    x = [rng.standard_normal(K)]
    for _ in range(N - 1):
        x.append(g @ x[-1] + rng.standard_normal(K))
    rows = [(t + first, k, float(x[t][k])) for t in range(N) for k in range(K)]
    return spark.createDataFrame(rows, "t long, mode long, value double").repartition(5), np.array(x)


@pytest.mark.parametrize("lag,first", [(1, 0), (3, 7), (12, 0), (25, 0)])
def test_models_equal_refits(spark, lag, first):
    """Also where a lag spans more than a block, and with blocks that lie apart."""
    df, x = state(spark, first)
    held = [(0, 0), (0, 1), (1, 19), (1, 20), (2, 7), (2, 12), (3, 99)]  # the last holds out nothing that is there
    table = spark.createDataFrame(held, "trial long, block long")
    got = {}
    models = resample.refits(resample.block_sums(df, lag, SIZE, first), table)
    for r in resample.entries(models).collect():
        got.setdefault(r.trial, np.zeros((K, K)))[r.i, r.j] = r.g
    n = {r.trial: r.n for r in models.collect()}
    assert set(got) == {0, 1, 2, 3}
    for trial, g in got.items():
        out = {b for k, b in held if k == trial}
        pairs = [t for t in range(N - lag) if t // SIZE not in out and (t + lag) // SIZE not in out]
        x0, x1 = x[pairs], x[[t + lag for t in pairs]]
        assert n[trial] == len(pairs)
        assert np.allclose(g, x1.T @ x0 @ np.linalg.pinv(x0.T @ x0), atol=1e-10)
    if lag == 1:
        assert np.allclose(got[3], lim.fit(df).g, atol=1e-10)


def test_held_out_forecasts(spark):
    df, x = state(spark)
    held = resample.held_blocks(spark, 21, 0.1, 30)
    runs = {}
    for r in held.collect():
        runs.setdefault((r.trial, r.first), []).append(r.block)
    assert len(runs) == 30 and all(sorted(b) == [f, f + 1, f + 2] and f + 2 < 21 for (_, f), b in runs.items()) and len({f for _, f in runs}) > 8
    models = resample.refits(resample.block_sums(df, 1, SIZE), held)
    g = {r.trial: np.frombuffer(r.g).reshape(K, K) for r in models.collect()}
    got = resample.held_forecasts(df, models, held, SIZE, [1, 5]).collect()
    starts = {trial: first for trial, first in runs}
    assert len(got) == sum(K * 2 * sum(t // SIZE in b for t in range(N)) for b in runs.values())
    for r in got[::7]:
        want = np.linalg.matrix_power(g[r.trial], r.lead) @ x[starts[r.trial] * SIZE + r.s]
        assert abs(want[r.mode] - r.value) < 1e-10


def test_shares_that_leave_nothing(spark):
    for blocks, share in ((5, 1.0), (1, 0.1), (5, 0.0)):
        with pytest.raises(ValueError):
            resample.held_blocks(spark, blocks, share, 3)
