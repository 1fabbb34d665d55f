"""Operators against NumPy, invariants and error cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import ensemble, lim, linalg, sampling, scale, spatial, state, temporal, verify
from fieldspark.sources import fields


def field(spark, x):
    """A field from an array of times by cells."""
    x = np.asarray(x, float)
    return spark.createDataFrame([(t, c, float(x[t, c])) for t in range(x.shape[0]) for c in range(x.shape[1])], "t long, cell long, value double")


def array(df, shape=None, by="cell"):
    rows = df.collect()
    shape = shape or (max(r.t for r in rows) + 1, max(r[by] for r in rows) + 1)
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.t, r[by]] = np.nan if r.value is None else r.value
    return out


def ar(n=3000, g=((0.9, 0.05, 0.0), (0.0, 0.7, 0.1), (0.0, 0.0, 0.5)), seed=0):
    g, rng = np.array(g), np.random.default_rng(seed)
    x = np.zeros((n, len(g)))
    for t in range(1, n):
        x[t] = g @ x[t - 1] + rng.standard_normal(len(g))
    return g, x


def test_seasonal_and_line(spark):
    t = np.arange(48)[:, None]
    x = 10 * np.arange(2) + 3 * (t % 12) + 0.5 * t
    a = array(temporal.anomaly(field(spark, x), 12))
    assert np.allclose(a, 6 * (t // 12 - 1.5) + np.zeros(2))
    assert np.allclose(array(temporal.detrend(field(spark, 2.0 * np.arange(20)[:, None] + 1 + np.arange(2)))), 0)
    assert [temporal.resample_named(field(spark, x), k, 48).select("block").distinct().count() for k in temporal.SHIFTS] == [4, 3, 3]
    with pytest.raises(ValueError):
        temporal.resample_avg(field(spark, x), 12, 48, -1)


@pytest.mark.parametrize("w", [1, 3, 4, 5, 12])
def test_running_means(spark, w):
    x = (np.arange(13.0) ** 2)[:, None]
    padded = np.pad(x[:, 0], w, mode="symmetric")
    want = [padded[w + i - (w - 1) // 2 : w + i + w // 2 + 1].mean() for i in range(13)]
    assert np.allclose(array(temporal.run_mean(field(spark, x), w, 13))[:, 0], want)
    trimmed = temporal.run_mean_trim(field(spark, x), w, 13).collect()
    assert all(math.isclose(r.value, want[r.t]) for r in trimmed) and len(trimmed) == 13 - 2 * (w // 2)
    with pytest.raises(ValueError):
        temporal.run_mean_trim(field(spark, x), 14, 13)


def test_masks_and_grids(spark):
    x = np.arange(18.0).reshape(3, 6)
    x[1, 2] = np.nan
    x[2, 5] = np.inf
    f = field(spark, x)
    kept = spatial.compress(f)
    assert sorted({r.cell for r in kept.collect()}) == [0, 1, 3, 4]
    grid = spark.createDataFrame([(c, float(lat), float(lon), 1.0) for c, (lat, lon) in enumerate(zip([-60, -5, 0, 5, 20, 70], [240, 290, 110, 250, 239, 291]))], "cell long, lat double, lon double, cell_area double")
    full = array(spatial.inflate(kept, grid))
    assert np.isnan(full[:, [2, 5]]).all() and np.allclose(full[:, [0, 1, 3, 4]], x[:, [0, 1, 3, 4]])
    assert [r.cell for r in spatial.box(grid, spatial.ENSO_BOX).orderBy("cell").collect()] == [1, 3]
    with pytest.raises(KeyError):
        spatial.coordinate_grid(grid, ["depth"])
    w = array(spatial.area_weight_lat(field(spark, np.ones((1, 6))), grid))
    assert np.allclose(w[0] ** 2, np.cos(np.radians([60, 5, 0, 5, 20, 70])))


def test_bounds_wrap(spark):
    centres = [340.0, 350.0, 0.0, 10.0]
    df = spark.createDataFrame(list(enumerate(centres)), "i long, x double")
    got = [r.edge for r in spatial.bounds(df).orderBy("i").collect()]
    assert got == [335.0, 345.0, -5.0, 5.0, 15.0]


def test_standardize(spark):
    x = np.random.default_rng(1).standard_normal((30, 4)) * [1, 2, 3, 4]
    k = 1 / np.sqrt(x.var(axis=0, ddof=1).sum())
    f = field(spark, x)
    assert np.allclose(array(scale.standardize_field(f)), x * k)
    assert np.allclose(array(scale.unstandardize(scale.standardize_field(f), scale.field_factor(f))), x)
    flat = scale.standardize_series(field(spark, np.ones((3, 1)))).collect()
    assert all(r.value is None for r in flat)


def test_eofs(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 6)) @ np.diag([9, 6, 4, 2, 1, 0.5]) @ rng.standard_normal((6, 6))
    u, s, _ = np.linalg.svd(x.T, full_matrices=False)
    loadings, stats = linalg.eof(field(spark, x), 3)
    assert np.allclose([r.sval for r in stats.orderBy("mode").collect()], s[:3])
    assert np.allclose([r.var_expl for r in stats.orderBy("mode").collect()], s[:3] ** 2 / 40 / x.var(axis=0, ddof=1).sum())
    got = np.zeros((6, 3))
    for r in loadings.collect():
        got[r.cell, r.mode] = r.loading
    assert np.allclose(got, linalg.canonical(u[:, :3]))
    some, more = linalg.eof_randomized(field(spark, x), 3)
    assert np.allclose([r.sval for r in more.orderBy("mode").collect()], s[:3], rtol=1e-6)
    near = np.zeros((6, 3))
    for r in some.collect():
        near[r.cell, r.mode] = r.loading
    assert np.allclose(np.abs(near), np.abs(got), atol=1e-4)
    with pytest.raises(ValueError):
        linalg.project_checked(field(spark, x[:, :5]), loadings)


def as_state(spark, x):
    return field(spark, x).withColumnRenamed("cell", "mode")


def test_fit_forecast_and_noise(spark):
    g, x = ar()
    s = as_state(spark, x)
    model = lim.fit(s, noise=True)
    want = (x[1:].T @ x[:-1]) @ np.linalg.pinv(x[:-1].T @ x[:-1])
    assert np.allclose(model.g, want) and np.allclose(model.g, g, atol=0.05)
    f = lim.forecast(as_state(spark, x[:5]), model.g, [1, 4])
    assert np.allclose(array(f.where("lead = 4"), by="mode"), x[:5] @ np.linalg.matrix_power(want, 4).T)
    assert model.l_is_real
    c0 = x[:-1].T @ x[:-1] / (len(x) - 2)
    q = (model.q_vectors * model.q_values) @ model.q_vectors.conj().T
    assert np.allclose(model.lin @ c0 + c0 @ model.lin.conj().T + q, 0, atol=1e-8)
    modes = lim.eigen_modes(spark, model).orderBy("mode").collect()
    assert [r.re for r in modes] == sorted((r.re for r in modes), reverse=True)


def test_noise_errors_and_persistence(spark, tmp_path):
    with pytest.raises(ValueError):
        lim.fit(as_state(spark, 1.05 ** np.arange(40)[:, None] * np.ones(1)))
    _, x = ar(4000, ((0.5, 0.0), (0.0, -0.4)), 3)
    model = lim.fit(as_state(spark, x))
    with pytest.raises(ValueError):
        lim.fit_noise(model, np.eye(2))
    _, x = ar(1500)
    model = lim.fit(as_state(spark, x), noise=True)
    model.save(spark, str(tmp_path / "m"))
    back = lim.Model.load(spark, str(tmp_path / "m"))
    assert np.allclose(back.g, model.g) and np.allclose(back.lin, model.lin) and back.lag == 1


def test_ensembles_have_the_stationary_spread(spark):
    _, x = ar(4000)
    model = lim.fit(as_state(spark, x), noise=True)
    e = lim.ensemble(spark, model, np.zeros(3), members=60, length=12, steps=30)
    assert e.count() == 60 * 12 * 3
    std = {r["mode"]: r.s for r in e.where("unit > 8").groupBy("mode").agg(F.stddev_samp("last").alias("s")).collect()}
    assert all(abs(std[k] / x[:, k].std() - 1) < 0.35 for k in range(3))
    again = lim.ensemble(spark, model, np.zeros(3), members=2, length=1, steps=30).orderBy("member", "mode").collect()
    assert again == lim.ensemble(spark, model, np.zeros(3), members=2, length=1, steps=30).orderBy("member", "mode").collect()


def test_orthogonal_parts():
    rng = np.random.default_rng(5)
    for _ in range(50):
        v = lim.orthogonal(rng.standard_normal(4) + 1j * rng.standard_normal(4))
        a, b = v.real, v.imag
        assert abs(a @ a - 1) < 1e-9 and abs(a @ b) < 1e-9 and b @ b >= 1 - 1e-9


def test_skill(spark):
    rng = np.random.default_rng(6)
    f, o = rng.standard_normal((2, 50))
    o = o + f
    pairs = spark.createDataFrame([(t, 0, float(f[t]), float(o[t])) for t in range(50)] + [(t, 1, 1.0, 2.0) for t in range(50)], "t long, cell long, f double, o double")
    got = {r.cell: r for r in verify.skill(pairs).collect()}
    assert math.isclose(got[0].lac, np.corrcoef(f, o)[0, 1]) and math.isclose(got[0].ce, 1 - ((o - f) ** 2).sum() / ((o - o.mean()) ** 2).sum())
    assert got[1].lac is None and got[1].ce is None and got[1].mse == 1
    r1, r2 = np.corrcoef(f[:-1], f[1:])[0, 1], np.corrcoef(o[:-1], o[1:])[0, 1]
    n = {r.cell: r.n_eff for r in verify.n_eff(pairs).collect()}
    assert math.isclose(n[0], 50 * (1 - r1 * r2) / (1 + r1 * r2)) and n[1] is None
    with pytest.raises(KeyError):
        verify.bootstrap(pairs, 50, "rmse")
    b = verify.bootstrap(pairs.where("cell = 0"), 50, "r", 400).first()
    assert b.low < b.mean < b.high and abs(b.mean - got[0].lac) < 0.05


def test_reliability_edges(spark):
    p = [0.0, 0.1, 0.3, 0.6, 0.7, 0.9999, 1.0]
    df = spark.createDataFrame([(x,) for x in p], "p double").select(ensemble.bin_of(F.col("p")).alias("b"))
    assert [r.b for r in df.collect()] == [0, 1, 2, 5, 6, 9, 9]
    with pytest.raises(ValueError):
        ensemble.event(F.col("p"), "middle")


def test_split_does_not_leak(spark):
    f = field(spark, np.zeros((40, 1)))
    test, train, pairs = (d.collect() for d in sampling.split(f, 40, 0.2, [1, 3]))
    used = {r.t for r in test}
    assert len({r.start for r in test}) == math.ceil(37 * 0.2) and used <= set(range(40))
    kept = {r.t for r in train}
    assert not kept & used and all(t + k not in used for t in kept for k in (1, 3))
    assert {(r.lag, r.t, r.t1) for r in pairs} == {(k, t, t + k) for t in kept for k in (1, 3) if t + k in kept}
    with pytest.raises(ValueError):
        sampling.test_starts(f, 40, 0.4, [1, 3])


def test_state_vector(spark):
    parts = {n: field(spark, np.full((4, k), k)) for k, n in enumerate(("one", "two", "three"), 1)}
    s, spans = state.concat(parts)
    assert s.select("feature").distinct().count() == 6
    assert [(r.var, r.start, r.stop) for r in spans.collect()] == [("one", 0, 1), ("two", 1, 3), ("three", 3, 6)]
    assert np.allclose(array(state.select_var(s, spans, "two")), np.full((4, 2), 2))
    with pytest.raises(ValueError):
        state.concat({**parts, "short": field(spark, np.zeros((3, 1)))})


def test_fields_are_saved(spark, tmp_path):
    f = field(spark, np.arange(6.0).reshape(3, 2))
    for ops in (("anomaly",), ("anomaly", "detrend")):
        fields.save_field(f, str(tmp_path / "f"), grid=f.select("cell").distinct(), ops=ops, by="cell")
        back, done = fields.load_field(spark, str(tmp_path / "f"))
        assert done == ops and np.allclose(array(back), np.arange(6).reshape(3, 2))
    prepared, done = scale.prepare(f, spark.createDataFrame([(0, 0.0), (1, 60.0)], "cell long, lat double"), 1, ("anomaly", "detrend"))
    assert done == ("anomaly", "detrend", "area_weight") and np.allclose(array(prepared), np.arange(6).reshape(3, 2) * [1, np.sqrt(0.5)])


def test_one_exchange_by_cell(spark):
    f = fields.orders_nation(spark, "/root/testdata/sf0.001")
    plain = f.repartition("cell")
    chain = temporal.detrend(temporal.anomaly(plain, 12))
    count = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(cell")
    assert count(chain) == count(plain)
