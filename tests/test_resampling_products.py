"""Bootstraps, consistency bounds and segments against plain loops."""

import hashlib

import numpy as np
import pytest

from fieldspark.operators import ensemble, lim, verify

N = 30


def drawn(seed, i, n, k=None):
    return np.array([int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:8], 16) for j in range(n)])


def brute(f, o, n, iterations, seed=7):
    rows = []
    for i in range(iterations):
        at = drawn(seed, i, n) % n
        x, y = f[at], o[at]
        ok = ~np.isnan(x) & ~np.isnan(y)
        own = y[~np.isnan(y)]
        r = np.corrcoef(x[ok], y[ok])[0, 1] if ok.sum() > 1 and x[ok].std() > 1e-12 and y[ok].std() > 1e-12 else np.nan
        rows.append((r, 1 - ((y - x)[ok] ** 2).sum() / (own.var() * len(own)) if len(own) and own.var() > 0 else np.nan))
    out = []
    for m in np.array(rows).T:
        m = m[~np.isnan(m)]
        out += [m.mean(), *np.percentile(m, [2.5, 97.5])] if len(m) else [None] * 3
    return out


def test_bootstrap_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(5)
    o = rng.standard_normal((4, N)) + 1e4
    f = o + rng.standard_normal((4, N))
    f[1, 3] = o[1, 9] = f[1, 20] = np.nan
    f[2] = 5.0  # does not vary
    o[3, :] = -2.5
    value = lambda x: None if np.isnan(x) else float(x)
    rows = [(f"g{c}", c, t, value(f[c, t]), value(o[c, t])) for c in range(4) for t in range(N) if (c, t) != (0, 7)] + [("g9", 9, 99, 1.0, 2.0)]
    f[0, 7] = o[0, 7] = np.nan
    df = spark.createDataFrame(rows, "name string, cell long, t long, f double, o double").repartition(3)
    whole = {r.cell: r for r in verify.bootstraps(df, N, 200, by=("name", "cell")).collect()}
    assert set(whole) == {0, 1, 2, 3}  # the last group has no time in range
    for c, r in whole.items():
        want = brute(f[c], o[c], N, 200)
        got = [r[k] for k in verify.BOUNDS]
        assert r.name == f"g{c}" and all(a is None and b is None or abs(a - b) < 1e-7 * max(1.0, abs(b) * 1e-3) for a, b in zip(got, want)), (c, got, want)
    monkeypatch.setattr(verify, "COUNT_BYTES", 4 * N * 33)  # seven passes
    again = {r.cell: r for r in verify.bootstraps(df, N, 200, by=("name", "cell")).collect()}
    assert all(x is y or abs(x - y) < 1e-12 * max(1.0, abs(x)) for c in whole for x, y in zip(whole[c][2:], again[c][2:]))
    one = verify.bootstrap(df.where("cell = 1").drop("cell", "name"), N, "ce", 200).collect()
    assert len(one) == 1 and abs(one[0].low - whole[1].ce_low) < 1e-12
    with pytest.raises(KeyError):
        verify.bootstrap(df, N, "mse")


def test_no_row_for_a_draw(spark):
    rows = spark.range(40).selectExpr("id as t", "sin(id) as f", "cos(id * 2) as o")
    counts = verify.draw_counts(spark, 25, 40, 7, first=3)
    assert counts.shape == (25, 40) and (counts.sum(axis=1) == 40).all()
    assert np.array_equal(counts[4], np.bincount(drawn(7, 7, 40) % 40, minlength=40))
    plan = verify.bootstraps(rows, 40, 50)._jdf.queryExecution().toString()
    assert "Explode" not in plan and "generate" not in plan.lower()


def test_consistency_bounds_against_loops(spark):
    rng = np.random.default_rng(6)
    p = rng.integers(0, 5, 60) / 4
    df = spark.createDataFrame([(t, float(x), bool(rng.random() < x)) for t, x in enumerate(p)], "t long, p double, occurred boolean")
    got = {r.bin: (r.lower, r.upper) for r in ensemble.reliability_bounds(df, 60, 150).collect()}
    steps, rates = np.sort(p), {}
    for i in range(150):
        own = steps[drawn(11, i, 60) % 60]
        hit = drawn(12, i, 60) / 2**32 < own
        bins = np.searchsorted(ensemble.EDGES, own, "right") - 1
        for b in set(bins.tolist()):
            rates.setdefault(b, []).append(hit[bins == b].mean())
    for b in range(10):
        if len(rates.get(b, [])) == 150:
            low, high = np.percentile(rates[b], [2.5, 97.5])
            assert np.allclose(got[b], (np.mean(rates[b]) - low, high - np.mean(rates[b])))
        else:
            assert got[b] == (None, None)


def test_segments_hand_their_states_over(spark):
    """Any cut into segments, and any split of members, gives the same numbers; so does a plain loop."""
    g = np.array([[0.8, 0.1], [-0.2, 0.7]])
    model = lim.Model(g, 1)
    model.lin, model.q_values, model.q_vectors = np.array([[-0.3, 0.2], [-0.4, -0.5]]), np.array([0.5, 0.2]), np.array([[0.8, -0.6], [0.6, 0.8]])
    x0 = np.array([[1.0, 2.0], [0.5, -1.0]])
    key = lambda r: (r.member, r.unit, r.sample, r.mode)
    whole = {key(r): r for r in lim.ensemble(spark, model, x0, members=9, length=7, steps=20).collect()}
    parts = {key(r): r for r in lim.ensemble(spark, model, x0, members=9, length=7, steps=20, segment=3).collect()}
    assert len(whole) == 9 * 7 * 4 and whole.keys() == parts.keys()
    assert all(abs(whole[k].last - parts[k].last) < 1e-13 and abs(whole[k].mean - parts[k].mean) < 1e-13 for k in whole)
    x, mid = x0.copy(), x0.copy()
    for unit in range(7):
        total, noise = mid.copy(), lim.normals(0, 5, unit, 2, 0, 20, 2)
        for step in range(20):
            new = x + x @ model.lin.T / 20 + noise[step] @ (model.q_vectors * np.sqrt(model.q_values / 20)).T
            x, mid = new, (x + new) / 2
            total += mid
        for s in range(2):
            for k in range(2):
                r = whole[5, unit + 1, s, k]
                assert abs(r.last - mid[s, k]) < 1e-12 and abs(r.mean - total[s, k] / 21) < 1e-12
