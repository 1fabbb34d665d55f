import numpy as np
import pytest

from fieldspark.operators import spectral


def made(spark, lats, lons, top, times=3, seed=1):
    """A field of random harmonics to degree ``top``, its grid with shuffled cell ids, and its coefficients."""
    rng = np.random.default_rng(seed)
    c = np.zeros((times, top + 1, top + 1), complex)
    for n in range(top + 1):
        c[:, n, : n + 1] = rng.standard_normal((times, n + 1)) + 1j * rng.standard_normal((times, n + 1))
        c[:, n, 0] = c[:, n, 0].real
    value = spectral.Synthesis(lats, lons, top)(c)
    ids = rng.permutation(len(lats) * len(lons)) * 3
    grid = [(int(ids[k]), float(lats[k // len(lons)]), float(lons[k % len(lons)])) for k in range(len(ids))]
    rows = [(t, int(ids[k]), float(value[t, k])) for t in range(times) for k in range(len(ids))]
    return spark.createDataFrame(rows, "t long, cell long, value double").repartition(3), spark.createDataFrame(grid, "cell long, lat double, lon double"), c, value


def gaussian(n):
    return np.degrees(np.arcsin(np.polynomial.legendre.leggauss(n)[0]))[::-1]


def test_legendre_functions_are_orthonormal():
    x, w = np.polynomial.legendre.leggauss(160)
    for m in (0, 1, 2, 40, 99, 150):
        p = spectral.legendre(x, m, 150)
        assert np.abs(2 * np.pi * (p * w[:, None]).T @ p - np.eye(p.shape[1])).max() < 1e-12
    assert np.allclose(spectral.legendre(x, 1, 2)[:, 1], np.sqrt(15 / (8 * np.pi)) * x * np.sqrt(1 - x * x))


@pytest.mark.parametrize("lats", [gaussian(32), 90 - 180 / 32 * (np.arange(32) + 0.5), np.linspace(90, -90, 65)], ids=["gaussian", "midpoints", "poles"])
def test_quadrature(lats):
    w, x = spectral.quadrature(lats), np.sin(np.radians(lats))
    for n in range(len(lats) // 2):
        assert abs((w * x**n).sum() - (2 / (n + 1) if n % 2 == 0 else 0)) < 1e-12


@pytest.mark.parametrize("lats,lons,top", [(gaussian(22), np.arange(44) * 360 / 44 + 3, 21), (np.linspace(90, -90, 45), np.arange(64) * 5.625, 21), (90 - 10 * (np.arange(18) + 0.5), np.arange(20) * 18.0, 8)], ids=["gaussian", "poles", "midpoints"])
def test_band_limited_input_comes_back(spark, lats, lons, top):
    field, grid, c, value = made(spark, lats, lons, top)
    got = spectral.analyse(field, grid, top)
    for r in got.collect():
        assert abs(c[r.t, r.n, r.m] - complex(r.re, r.im)) < 1e-10
    new_lats, new_lons = np.array([80.0, 3.0, -41.5]), np.array([0.0, 17.0, 200.0, 359.0])
    want = spectral.Synthesis(new_lats, new_lons, top)(c)
    for df in (spectral.regrid(field, grid, new_lats.tolist(), new_lons.tolist(), top), spectral.synthesise(got, new_lats.tolist(), new_lons.tolist())):
        rows = df.collect()
        assert len(rows) == want.size and max(abs(want[r.t, r.cell] - r.value) for r in rows) < 1e-10
    low = spectral.regrid(field, grid, new_lats.tolist(), new_lons.tolist(), 4).collect()
    cut = spectral.Synthesis(new_lats, new_lons, 4)(c[:, :5, :5])
    assert max(abs(cut[r.t, r.cell] - r.value) for r in low) < 1e-10
    total = sum(r.power for r in spectral.power(got).collect())
    assert np.isclose(total, np.mean([sum(abs(c[t, n, m]) ** 2 * (2 if m else 1) for n in range(top + 1) for m in range(n + 1)) for t in range(3)]))


def test_what_is_no_lattice(spark):
    field, grid, _, _ = made(spark, gaussian(8), np.arange(16) * 22.5, 7)
    for bad in (grid.where("cell > 0"), grid.union(spark.sql("select 9999L, 1.0D, 2.0D")), grid.selectExpr("cell", "lat", "lon * 0.9 as lon"), grid.selectExpr("cell + 1 as cell", "lat", "lon")):
        with pytest.raises(ValueError):
            spectral.analyse(field, bad, 3)
    for top in (8, -1):
        with pytest.raises(ValueError):
            spectral.analyse(field, grid, top)
    with pytest.raises(ValueError):
        spectral.analyse(field.where("t > 0 or cell > 0"), grid, 3)  # a hole
    none = spark.createDataFrame([], "t long, cell long, value double")
    assert spectral.analyse(none, grid, 3).count() == spectral.regrid(none, grid, [0.0], [0.0], 3).count() == 0
    assert spectral.synthesise(spectral.analyse(none, grid, 3), [0.0], [0.0]).count() == 0
