"""Linear algebra on odd and long shapes, calendars, experiments, stages and the noise, against plain Python and NumPy."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import calendar
from fieldspark.operators import lim, linalg, scale, state
from fieldspark.sources import experiments, store


def field(spark, x, cells=None):
    cells = range(x.shape[1]) if cells is None else cells
    return spark.createDataFrame([(t, c, float(x[t, k])) for t in range(len(x)) for k, c in enumerate(cells)], "t long, cell long, value double")


def dense(df, i, j, v, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r[i], r[j]] = r[v]
    return out


@pytest.mark.parametrize("shape", [(40, 7), (7, 40), (30, 30)])
@pytest.mark.parametrize("exact", [linalg.EXACT, 0])
def test_eofs_of_both_shapes_and_ways(spark, shape, exact):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(shape) @ np.diag(0.8 ** np.arange(shape[1]))
    loadings, stats = linalg.eof(field(spark, x), 3, exact)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose([r.sval for r in stats.orderBy("mode").collect()], s[:3])
    assert np.allclose([r.var_expl for r in stats.orderBy("mode").collect()], s[:3] ** 2 / len(x) / x.var(0, ddof=1).sum())
    assert np.allclose(dense(loadings, "cell", "mode", "loading", (shape[1], 3)), linalg.canonical(v[:3].T), atol=1e-6)


def test_samples_with_gaps_raise(spark):
    """Cells must not be taken for each other, and gaps must not pass for numbers."""
    whole = field(spark, np.arange(12.0).reshape(4, 3))
    other = whole.withColumn("cell", F.when((F.col("t") == 1) & (F.col("cell") == 1), 9).otherwise(F.col("cell")))
    for bad in (other, whole.where("t > 0 or cell > 0"), whole.withColumn("value", F.when((F.col("t") == 2) & (F.col("cell") == 0), None).otherwise(F.col("value"))), whole.union(whole.limit(1)), whole.withColumn("value", F.when(F.col("t") == 2, float("nan")).otherwise(F.col("value")))):
        for call in (linalg.gram, lambda f: linalg.lag_covariance(f, 1), lambda f: linalg.eof(f, 1)):
            with pytest.raises(ValueError):
                call(bad)


def test_covariances_by_name(spark):
    x = np.random.default_rng(1).standard_normal((9, 3))
    got = {(r.i, r.j): r.s for r in linalg.lag_covariance(field(spark, x, [5, 11, 2]), 2).collect()}
    want = x[2:].T @ x[:-2]
    assert all(np.isclose(got[a, b], want[i, j]) for i, a in enumerate((5, 11, 2)) for j, b in enumerate((5, 11, 2)))
    assert np.allclose(dense(linalg.gram(field(spark, x, [5, 11, 2])), "i", "j", "s", (3, 3)), x[:, [2, 0, 1]].T @ x[:, [2, 0, 1]])


def test_stripes(spark, monkeypatch):
    monkeypatch.setattr(linalg, "STRIPE", 2)
    x = np.random.default_rng(1).standard_normal((6, 5))
    assert np.allclose(dense(linalg.gram(field(spark, x).repartition(3)), "i", "j", "s", (5, 5)), x.T @ x)


def test_explicit_later_states(spark):
    x = np.random.default_rng(3).standard_normal((400, 2))
    for t in range(1, 400):
        x[t] += x[t - 1] @ np.array([[0.8, 0.1], [0.0, 0.6]])
    s, t1 = (field(spark, y).withColumnRenamed("cell", "mode") for y in (x[:-2], x[2:]))
    assert np.allclose(lim.fit(s, 2, tau1=t1).g, (x[2:].T @ x[:-2]) @ np.linalg.inv(x[:-2].T @ x[:-2]))
    for other in (field(spark, x).withColumnRenamed("cell", "mode"), field(spark, x[2:, :1]).withColumnRenamed("cell", "mode")):
        with pytest.raises(ValueError):
            lim.fit(s, 2, tau1=other)


def test_numbers_follow_the_order(spark):
    names = [f"n{k:03d}" for k in np.random.default_rng(0).permutation(300)]
    got = store.numbered(spark.createDataFrame([(n,) for n in names * 2], "name string").repartition(7), "name", "k", 10)
    assert {r.name: r.k for r in got.collect()} == {n: 10 + i for i, n in enumerate(sorted(names))}
    s, spans = state.concat({"a": field(spark, np.ones((2, 3)), [7, 3, 5]), "b": field(spark, np.ones((2, 2)))})
    assert sorted({r.feature for r in s.collect()}) == [0, 1, 2, 3, 4] and [(r.start, r.stop) for r in spans.collect()] == [(0, 3), (3, 5)]


def dates(days, name):
    y, m, d = calendar.date_of(F.col("n"), name)
    return [(r[0], r[1], r[2]) for r in days.orderBy("n").select(y, m, d).collect()]


def test_calendars(spark):
    lengths = {"noleap": lambda y: [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31], "360_day": lambda y: [30] * 12, "standard": lambda y: [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]}
    for name, of in lengths.items():
        every = [(y, m + 1, d + 1) for y in range(-5, 12) for m, n in enumerate(of(y)) for d in range(n)]
        first = calendar.day_number(-5, 1, 1, name)
        assert calendar.day_number(0, 1, 1, name) == 0
        assert [calendar.day_number(*x, name) for x in every] == list(range(first, first + len(every)))
        assert dates(spark.range(first, first + len(every)).select(F.col("id").alias("n")), name) == every
    some = [1, 719163, 738000, 1000000]
    got = dates(spark.createDataFrame([(calendar.day_number(*datetime.date.fromordinal(k).timetuple()[:3], "standard"),) for k in some], "n long"), "standard")
    assert got == [datetime.date.fromordinal(k).timetuple()[:3] for k in some]


def test_units(spark):
    one = spark.createDataFrame([(36.5,), (-0.5,)], "n double")
    got = one.select(*calendar.decode(F.col("n"), "hours since 2000-02-28 12:00", "gregorian")).collect()
    assert [tuple(r) for r in got] == [(2000, 3, 1, 1800), (2000, 2, 28, 41400)]
    assert [tuple(r) for r in one.select(*calendar.decode(F.col("n"), "days since 0000-01-01", "365_day")).collect()] == [(0, 2, 6, 43200), (-1, 12, 31, 43200)]
    for units, name in (("fortnights since 2000-01-01", "standard"), ("days since today", "standard"), ("days since 2000-01-01", "lunar")):
        with pytest.raises(ValueError):
            calendar.decode(F.col("n"), units, name)


def test_experiments(spark, tmp_path):
    rows = [(t, lat, lon, -99.0 if (t, lat) == (1, 5.0) else t * 10 + lat + lon) for t in range(3) for lat, lon in ((5.0, 9.0), (-5.0, 1.0), (5.0, 2.0))]
    variable = experiments.Variable(spark.createDataFrame(rows, "time long, lat double, lon double, value double"), fill=-99.0)
    f, grid = experiments.load(variable)
    assert [(r.cell, r.lat, r.lon) for r in grid.orderBy("cell").collect()] == [(0, -5, 1), (1, 5, 2), (2, 5, 9)]
    assert np.allclose(dense(f, "t", "cell", "value", (3, 3)), [[-4, 7, 14], [6, np.nan, np.nan], [16, 27, 34]], equal_nan=True)
    with pytest.raises(ValueError):
        experiments.load(experiments.Variable(variable.rows.drop("lat")))
    experiments.convert({"v": variable}, str(tmp_path))
    back, _ = experiments.reload(spark, str(tmp_path), ["v"])["v"]
    assert sorted(map(str, back.collect())) == sorted(map(str, f.collect()))
    arrays = spark.createDataFrame([(1, [1.0, float("nan"), 3.0, 4.0])], "t long, v array<double>")
    long, grid = experiments.gridded_arrays(arrays, "t", "v", [0, 10], [5, 6])
    assert [(r.cell, r.value) for r in long.orderBy("cell").collect()] == [(0, 1), (1, None), (2, 3), (3, 4)]
    assert [(r.lat, r.lon) for r in grid.orderBy("cell").collect()] == [(0, 5), (0, 6), (10, 5), (10, 6)]
    with pytest.raises(ValueError):
        experiments.gridded_arrays(arrays, "t", "v", [0], [5])


def test_stages(spark):
    x = np.arange(24.0).reshape(12, 2) ** 2
    grid = spark.createDataFrame([(0, 10.0), (1, 60.0)], "cell long, lat double")
    stages = scale.prepare_stages(field(spark, x), grid, 3)
    assert stages.at == "area_weighted" and list(stages.kept) == ["orig", "anomaly", "detrended", "area_weighted"]
    assert np.allclose(dense(stages.reset("orig"), "t", "cell", "value", x.shape), x) and stages.at == "orig"
    with pytest.raises(KeyError):
        stages.reset("running_mean")


def test_noise_is_normal_and_independent_of_the_split():
    n = lim.normals(3, 5, 1, 4, 0, 5000, 3)
    assert n.shape == (5000, 4, 3) and abs(n.mean()) < 0.02 and abs(n.std() - 1) < 0.01 and abs((n**4).mean() - 3) < 0.15
    assert np.array_equal(n[700:1000], lim.normals(3, 5, 1, 4, 700, 300, 3))
    flat = np.concatenate([n.reshape(5000, -1), lim.normals(3, 6, 1, 4, 0, 5000, 3).reshape(5000, -1), lim.normals(3, 5, 2, 4, 0, 5000, 3).reshape(5000, -1)], axis=1)
    assert np.abs(np.corrcoef(flat.T) - np.eye(flat.shape[1])).max() < 0.07
    assert abs(np.corrcoef(n[:-1, 0, 0], n[1:, 0, 0])[0, 1]) < 0.05


def test_fields_hold_every_row(spark):
    """Sums over a field are those of its whole table."""
    from fieldspark.sources import fields

    sf = "/root/testdata/sf0.01"
    o, li, e = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "lineitem", "events"))
    total = lambda df: df.selectExpr("sum(value) s").first().s
    orders = o.selectExpr("sum(o_totalprice) / 1e6 s").first().s
    for f in (fields.orders_region, fields.orders_nation, fields.orders_members):
        assert np.isclose(total(f(spark, sf)), orders)
    assert np.isclose(total(fields.lineitem_snation(spark, sf)), li.selectExpr("sum(l_extendedprice * (1 - l_discount)) / 1e6 s").first().s)
    assert np.isclose(total(fields.events_daily(spark, sf)), e.selectExpr("sum(value) s").first().s)
    for name, f in (("orders", fields.orders_nation), ("lineitem", fields.lineitem_snation)):
        n, got = fields.months(spark, sf, name), f(spark, sf)
        assert got.count() == n * got.select("cell").distinct().count() and got.selectExpr("max(t) m").first().m == n - 1
