"""Queries over all cells, against NumPy."""

import hashlib

import numpy as np
import pytest

from fieldspark.jobs import queries as jobs
from fieldspark.sources import fields

SF = "/root/testdata/sf0.01"


def table(df, i, j, v):
    rows = df.select(i, j, v).collect()
    return {(r[0], r[1]): r[2] for r in rows}


@pytest.fixture(scope="module")
def brute(spark):
    """Smoothed, centred field (time by cell), loadings (cell by mode), states and G."""
    got = table(fields.lineitem_snation(spark, SF), "t", "cell", "value")
    n = fields.months(spark, SF, "lineitem")
    x = np.array([[got[t, c] for c in range(25)] for t in range(n)])
    x = np.array([x[t - 2 : t + 3].mean(0) for t in range(2, n - 2)])
    x -= x.mean(0)
    load = np.linalg.svd(x, full_matrices=False)[2][: jobs.LEADING].T
    load *= np.sign(load[np.abs(load).argmax(0), range(load.shape[1])])
    s = x @ load
    return x, load, s, (s[1:].T @ s[:-1]) @ np.linalg.inv(s[:-1].T @ s[:-1])


def test_model_of_all_cells(spark, brute):
    x, load, s, g = brute
    got = table(jobs.lim_fit_G_state(spark, SF), "i", "j", "re")
    assert len(got) == jobs.LEADING**2 and all(abs(v - g[k]) < 2e-6 for k, v in got.items())
    for name, j, want in (("lim_forecast_state", "cell", s @ (g @ g).T @ load.T), ("xfcast_state", "feature", s @ g.T @ load.T)):
        got = table(jobs.QUERIES[name](spark, SF), "t", j, "value")
        assert len(got) == x.size and {c for _, c in got} == set(range(25))
        assert all(abs(v - want[t - 2, c]) <= 1e-6 + 1e-9 * np.abs(want).max() for (t, c), v in got.items())
    rate = np.log(np.linalg.eigvals(g).astype(complex))
    assert np.allclose(sorted(r.re for r in jobs.lim_modes_state(spark, SF).collect()), sorted(rate.real), atol=2e-6)


def test_bounds_of_all_cells(spark):
    n, draws = fields.months(spark, SF) - 12, jobs.DRAWS
    assert draws == 10_000
    at = np.array([int(hashlib.md5(f"7:{i}:{k}".encode()).hexdigest()[:8], 16) % n for i in range(draws) for k in range(n)]).reshape(draws, n)
    pairs = {(r.cell, r.t): (r.f, r.o) for r in jobs._pairs(spark, SF).collect()}
    value = {(r.cell, r.t): r.value for r in jobs._anomalies(spark, SF).collect()}
    got = {(r.cell, r.metric): r for r in jobs.boot_ci(spark, SF).collect()}
    rows = {r.cell: r for r in jobs.verif_table(spark, SF).collect()}
    assert set(got) == {(c, m) for c in range(5) for m in ("r", "ce")} and set(rows) == set(range(5))
    for c in range(5):
        f, o = np.array([pairs[c, t] for t in range(n)]).T[:, at]
        month = np.array([value[c, t + 11] for t in range(n)])[at]
        for p, x in (("", f), ("auto1_", month)):
            a, b = x - x.mean(1, keepdims=True), o - o.mean(1, keepdims=True)
            for m, v in (("r", (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))), ("ce", 1 - ((o - x) ** 2).sum(1) / (b * b).sum(1))):
                want = [v.mean(), *np.quantile(v, [0.025, 0.975])]
                assert p or np.allclose([got[c, m].mean, got[c, m].low, got[c, m].high], want, atol=2e-6)
                assert np.allclose([rows[c][f"{p}{m}{e}"] for e in ("", "_low", "_high")], want, atol=2e-6)
        assert rows[c].scalar == f"cell{c}"


def test_noise_of_the_joint_state(spark):
    """L, the noise covariance and an ensemble of ten modes of two variables, from the fields on."""
    parts = []
    for f, name in ((fields.orders_nation, "orders"), (fields.lineitem_snation, "lineitem")):
        got, n = table(f(spark, SF), "t", "cell", "value"), fields.months(spark, SF, name)
        x = np.array([[got[t, c] for c in range(25)] for t in range(n)])
        x = np.array([x[t - 2 : t + 3].mean(0) for t in range(2, n - 2)])
        x -= x.mean(0)
        parts.append(x / np.sqrt(x.var(0, ddof=1).sum()))
    x = np.concatenate([p[: min(map(len, parts))] for p in parts], axis=1)
    load = np.linalg.svd(x, full_matrices=False)[2][: jobs.LEADING].T
    load *= np.sign(load[np.abs(load).argmax(0), range(load.shape[1])])
    z = x @ load
    c0 = z[:-1].T @ z[:-1]
    g = z[1:].T @ z[:-1] @ np.linalg.inv(c0)
    values, vectors = np.linalg.eig(g)
    lin = vectors @ np.diag(np.log(values.astype(complex))) @ np.linalg.inv(vectors)
    c0 = c0 / (len(z) - 2)
    q = -(lin @ c0 + c0 @ lin.conj().T)
    q_values, q_vectors = np.linalg.eigh((q + q.conj().T) / 2)
    q_values, q_vectors = q_values[::-1], q_vectors[:, ::-1]
    good = q_values > 0
    q_kept = q_values[good] * q_values.sum() / q_values[good].sum()
    got = jobs.lim_fit_Q_state(spark, SF).collect()
    assert len(got) == jobs.LEADING**2
    for r in got:
        assert abs(lin[r.i, r.j] - complex(r.re, r.im)) < 1e-5 * np.abs(lin).max()
        assert r.q is None and r.i >= len(q_kept) or abs(r.q - q_kept[r.i]) < 1e-5 * q_kept[0]
    # patterns: their Gram matrix does not depend on the signs of the eigenvectors
    modes = table(jobs.noise_modes_state(spark, SF), "cell", "mode", "loading")
    pattern = np.array([[modes[c, k] for k in range(len(q_kept))] for c in range(50)])
    want = np.real(load @ (q_vectors[:, good] * q_kept))
    assert np.allclose(np.abs(pattern), np.abs(want), atol=1e-4 * np.abs(want).max())
    # the mean over members follows the decay from each start; the spread is that of the noise
    ends = jobs.ens_1yr_state(spark, SF).collect()
    assert len(ends) == 12 * jobs.LEADING and {r.members for r in ends} == {jobs.MEMBERS_RUN}
    spread = c0 - np.real(g @ c0 @ g.T) + np.real((q_vectors[:, good] * q_kept) @ q_vectors[:, good].conj().T - q) * 0.5
    for r in ends:
        ahead = (np.linalg.matrix_power(g, 1) @ z[len(z) - 12 + r.sample])[r.mode]
        assert abs(r.mean - ahead) < 6 * r.std / np.sqrt(jobs.MEMBERS_RUN) + 0.02 * np.abs(z).max()
        assert 0.5 < r.std / np.sqrt(max(spread[r.mode, r.mode], 1e-12)) < 2 or r.std < 0.1 * np.sqrt(spread.max())
