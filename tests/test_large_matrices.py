"""Products by tiles and modes of flat spectra."""

import numpy as np
import pytest

from fieldspark.operators import linalg


def field(spark, x):
    n, m = x.shape
    return spark.createDataFrame([(t, c * 2 + 1, float(x[t, c])) for t in range(n) for c in range(m)], "t long, cell long, value double").repartition(4)


def dense(df, m, names):
    out = np.full((m, m), np.nan)
    at = {n: k for k, n in enumerate(names)}
    rows = df.collect()
    assert len(rows) == m * m
    for r in rows:
        out[at[r.i], at[r.j]] = r.s
    return out


@pytest.mark.parametrize("side", [4, 7, 23, 64])
def test_tiles_equal_the_whole(spark, side):
    x = np.random.default_rng(2).standard_normal((50, 23))
    f = field(spark, x)
    assert np.allclose(dense(linalg.gram(f, whole=0, side=side), 23, range(23)), x.T @ x, atol=1e-12)
    names = [c * 2 + 1 for c in range(23)]
    got = dense(linalg.lag_covariance(f, 3, whole=0, side=side), 23, names)
    assert np.allclose(got, x[3:].T @ x[:-3], atol=1e-12)
    assert np.allclose(got, dense(linalg.lag_covariance(f, 3), 23, names), atol=1e-12)


def test_many_features(spark):
    """Three thousand features: more than a task holds whole; all entries are there and some are looked at."""
    m = 3000
    rows = spark.range(6).selectExpr("id as key", f"transform(sequence(0, {m - 1}), j -> cast(((j * 31 + id * 17 + 5) * (j + 3 * id + 1)) % 101 - 50 as double)) as x")
    x = np.array([r.x for r in rows.orderBy("key").collect()])
    got = linalg._tiles(rows.selectExpr("x", "x as y"), m, True, linalg.SIDE)
    assert got.count() == m * m and got.select("i", "j").distinct().count() == m * m
    want = x.T @ x
    for r in got.where("(i * 3001 + j) % 100003 = 7").collect():
        assert r.s == want[r.i, r.j]
    sums = got.selectExpr("sum(s) a", "sum(s * (i + 2 * j)) b").first()
    assert np.isclose(sums.a, want.sum()) and np.isclose(sums.b, (want * (np.arange(m)[:, None] + 2 * np.arange(m))).sum())


def flat(n, m, high=1.0, low=0.98, seed=1):
    rng = np.random.default_rng(seed)
    u, v = (np.linalg.qr(rng.standard_normal((k, m)))[0] for k in (n, m))
    return (u * np.linspace(high, low, m)) @ v.T, v


def rows(spark, x):
    made = spark.createDataFrame([(t, [float(a) for a in r]) for t, r in enumerate(x)], "key long, x array<double>").repartition(2)
    return linalg.Rows(linalg.stored(made, "rows"), np.arange(x.shape[1]), len(x))


def test_flat_spectrum_converges(spark):
    """Singular values from 1.00 to 0.98: residuals hold, and so do values and vectors."""
    x, v = flat(220, 200)
    values, basis = linalg._leading(rows(spark, x), 5, exact=0)
    want = np.linspace(1.0, 0.98, 200)[:5] ** 2
    assert np.abs(values - want).max() < 1e-8
    assert np.linalg.norm(x.T @ (x @ basis) - basis * values, axis=0).max() < 1e-8
    assert np.abs(np.abs((basis * v[:, :5]).sum(axis=0)) - 1).max() < 1e-6


def test_modes_that_do_not_settle_raise(spark):
    x, _ = flat(220, 200)
    with pytest.raises(ValueError, match="do not settle"):
        linalg._leading(rows(spark, x), 5, exact=0, over=2, passes=2)


def test_rank_and_equal_values(spark):
    x = np.zeros((40, 60))
    x[:4, :4] = np.diag([3.0, 3.0, 3.0, 1.0])
    values, basis = linalg._leading(rows(spark, x), 6, exact=0, over=3)
    assert np.allclose(values, [9, 9, 9, 1, 0, 0], atol=1e-7)
    assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-10)
