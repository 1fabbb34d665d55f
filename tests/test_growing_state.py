"""The joint state of tables in which a mode grows by least squares, against NumPy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.jobs import queries as jobs
from fieldspark.operators import lim
from fieldspark.sources import fields

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Tables whose order totals grow by a tenth a month; of their joint state loadings, states, G, L and the noise's eigenpairs."""
    at = tmp_path_factory.mktemp("grown")
    for name in os.listdir(SF):
        if name != "orders.parquet":
            (at / name).symlink_to(f"{SF}/{name}")
    month = fields.month_index(F.col("o_orderdate"), 1995)
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_totalprice", F.col("o_totalprice") * F.exp(0.1 * month)).write.parquet(f"{at}/orders.parquet")
    parts = []
    for f, name in ((fields.orders_nation, "orders"), (fields.lineitem_snation, "lineitem")):
        n = fields.months(spark, str(at), name)
        got = {(r.t, r.cell): r.value for r in f(spark, str(at)).collect()}
        x = np.array([[got[t, c] for c in sorted({c for _, c in got})] for t in range(n)])
        x = np.array([x[t - 2 : t + 3].mean(0) for t in range(2, n - 2)])
        x -= x.mean(0)
        parts.append(x / np.sqrt(x.var(0, ddof=1).sum()))
    x = np.concatenate([p[: min(map(len, parts))] for p in parts], axis=1)
    load = np.linalg.svd(x, full_matrices=False)[2][: jobs.LEADING].T
    load *= np.sign(load[np.abs(load).argmax(0), range(load.shape[1])])
    z = x @ load
    a, b = z[:-1], z[1:]
    assert np.abs(np.linalg.eigvals(b.T @ a @ np.linalg.inv(a.T @ a))).max() > 1.01
    c0 = (a.T @ a + b.T @ b) / 2
    g = b.T @ a @ np.linalg.inv(c0)
    values, vectors = np.linalg.eig(g)
    assert np.abs(values).max() < 1
    lin = vectors @ np.diag(np.log(values.astype(complex))) @ np.linalg.inv(vectors)
    c0 /= len(a) - 1
    q = -(lin @ c0 + c0 @ lin.conj().T)
    q_values, q_vectors = np.linalg.eigh((q + q.conj().T) / 2)
    q_values, q_vectors = q_values[::-1], q_vectors[:, ::-1]
    good = q_values > 0
    return str(at), load, z, g, lin, q_values[good] * q_values.sum() / q_values[good].sum(), q_vectors[:, good]


def test_settled_model(spark):
    """All modes of a growing state decay by the covariance of starts and ends; without it they raise."""
    x = np.random.default_rng(3).standard_normal((40, 3)) + np.exp(0.1 * np.arange(40))[:, None]
    s = spark.createDataFrame([(t, k, float(v)) for t, row in enumerate(x) for k, v in enumerate(row)], "t long, mode long, value double")
    with pytest.raises(ValueError, match="not stable"):
        lim.fit(s)
    with pytest.warns(UserWarning, match="grows"):
        got = lim.fit(s, settle=True).g
    a, b = x[:-1], x[1:]
    assert np.allclose(got, b.T @ a @ np.linalg.inv((a.T @ a + b.T @ b) / 2)) and np.abs(np.linalg.eigvals(got)).max() < 1
    with pytest.raises(ValueError, match="not stable"):  # a mode that stays has no model either way
        lim.fit(s.where("mode = 0").withColumn("value", F.lit(1.0)), settle=True)
    # where all modes decay, nothing changes
    fine = spark.createDataFrame([(t, 0, float(v)) for t, v in enumerate(0.8 ** np.arange(20))], "t long, mode long, value double")
    assert np.array_equal(lim.fit(fine, settle=True).g, lim.fit(fine).g)


def test_ensemble(spark, grown):
    at, _, z, g, lin, q_values, q_vectors = grown
    ends = jobs.ens_1yr_state(spark, at).collect()
    assert len(ends) == 12 * jobs.LEADING and {r.members for r in ends} == {jobs.MEMBERS_RUN}
    # the midpoint before the last one of the unit's steps: powers of I + L dt
    step = np.eye(jobs.LEADING) + lin / jobs.STEPS
    last = np.linalg.matrix_power(step, jobs.STEPS - 1)
    ahead = np.real((last + last @ step) / 2 @ z[-12:].T).T
    push = q_vectors * np.sqrt(q_values)
    spread, power = np.zeros((jobs.LEADING, jobs.LEADING)), np.eye(jobs.LEADING)
    for _ in range(jobs.STEPS):
        spread = spread + np.real(power @ push @ push.conj().T @ power.conj().T) / jobs.STEPS
        power = power @ step
    std = np.sqrt(np.diag(spread))
    for r in ends:
        assert abs(r.mean - ahead[r.sample, r.mode]) < 5 * std[r.mode] / np.sqrt(jobs.MEMBERS_RUN) + 1e-3 * std.max()
        assert 0.7 < r.std / std[r.mode] < 1.4


def test_model_with_noise(spark, grown):
    at, _, _, _, lin, q_values, _ = grown
    got = jobs.lim_fit_Q_state(spark, at).collect()
    assert len(got) == jobs.LEADING**2 and {(r.i, r.j) for r in got} == set(np.ndindex(jobs.LEADING, jobs.LEADING))
    for r in got:
        assert abs(lin[r.i, r.j] - complex(r.re, r.im)) < 1e-5 * np.abs(lin).max()
        assert r.q is None and r.i >= len(q_values) or abs(r.q - q_values[r.i]) < 1e-5 * q_values[0]


def test_noise_patterns(spark, grown):
    at, load, _, _, _, q_values, q_vectors = grown
    got = {(r.cell, r.mode): r.loading for r in jobs.noise_modes_state(spark, at).collect()}
    want = np.real(load @ (q_vectors * q_values))
    assert len(got) == want.size > 25 * len(q_values)  # the cells of both variables
    pattern = np.array([[got[c, k] for k in range(len(q_values))] for c in range(len(load))])
    assert np.allclose(np.abs(pattern), np.abs(want), atol=1e-6)  # six decimals
