import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import spatial
from fieldspark.sources.nodes import Group


def test_nodes_are_replaced_while_read(spark, tmp_path):
    group = Group(spark, f"file://{tmp_path}/a/b")
    first = group.write("x", spark.range(10).toDF("v"))
    second = group.write("x", first.select((F.col("v") + 1).alias("v")))
    assert sorted(r.v for r in first.collect()) == list(range(10)) and sorted(r.v for r in second.collect()) == list(range(1, 11))
    bad = second.select(F.udf(lambda v: 1 // (v - 5), "long")("v").alias("v"))
    with pytest.raises(Exception, match="ZeroDivision"):
        group.write("x", bad)
    assert sorted(r.v for r in group.read("x").collect()) == list(range(1, 11))
    assert len(list((tmp_path / "a/b/x").glob("v-*"))) == 3
    group.clean("x")
    assert len(list((tmp_path / "a/b/x").glob("v-*"))) == 1 and group.read("x").count() == 10
    assert group.nodes() == ["x"] and Group(spark, f"file://{tmp_path}/a").groups() == ["b"]


def test_groups_and_nodes_of_one_name(spark, tmp_path):
    top = Group(spark, str(tmp_path))
    top.write("run", spark.range(3))
    inner = top.group("run")  # takes the node's place
    assert top.nodes() == [] and inner.nodes() == []
    assert inner.empty("y", "a long").count() == 0 and inner.read("y").columns == ["a"]
    with pytest.raises(ValueError, match="is a group"):
        top.write("run", spark.range(3))
    with pytest.raises(KeyError):
        top.read("nothing")


def _by_rule(x, d):
    n = len(x)
    out = np.zeros(n + 1)
    out[: n - 1] = x[: n - 1] - d / 2
    out[-2:] = x[-2:] + d[-2:] / 2
    return out


@pytest.mark.parametrize("n", [2, 3, 9, 500])
def test_long_axes_without_a_window(spark, n):
    x = (340 + 5.0 * np.arange(n) + (np.arange(n) % 3) * 0.5) % 360
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, x double").repartition(4)
    out = spatial.bounds(df)
    assert "Window" not in out._jdf.queryExecution().toString()
    raw = np.diff(x)
    d = np.array([raw[k + 1] if v > 300 and k + 1 < n - 1 else raw[k - 1] if v < -300 and k else v for k, v in enumerate(raw)])
    got = {r.i: r.edge for r in out.collect()}
    assert len(got) == n + 1 and np.allclose([got[k] for k in range(n + 1)], _by_rule(x, d))


def test_lattices(spark):
    n, m = 4, 6
    lat = np.array([[-80 + 50 * i + 0.3 * j for j in range(m)] for i in range(n)])
    lat[3] += 130  # a step of more than 90
    lon = np.array([[(341 + 7 * j + 2 * i) % 360 for j in range(m)] for i in range(n)], float)
    df = spark.createDataFrame([(i, j, float(lat[i, j]), float(lon[i, j])) for i in range(n) for j in range(m)], "i long, j long, lat double, lon double").repartition(3)
    got = {(r.i, r.j): (r.lat_edge, r.lon_edge) for r in spatial.bounds_2d(df).collect()}
    assert len(got) == (n + 1) * (m + 1)
    for j in range(m + 1):
        x = lat[:, min(j, m - 1)]
        want = _by_rule(x, np.clip(np.diff(x), -90, 90))
        assert np.allclose([got[i, j][0] for i in range(n + 1)], want)
    for i in range(n + 1):
        x = lon[min(i, n - 1)]
        raw = np.diff(x)
        d = np.array([raw[k - 1] if v < -300 else v for k, v in enumerate(raw)])
        assert np.allclose([got[i, j][1] for j in range(m + 1)], _by_rule(x, d))
    with pytest.raises(ValueError):
        spatial.bounds_2d(df.where("i > 0 or j > 0"))
    assert spatial.bounds_2d(df.limit(0)).count() == 0


def test_lists_of_times(spark):
    df = spark.createDataFrame([(t, c, t * 10.0 + c) for t in range(5) for c in range(2)], "t long, cell long, value double")
    got = {(r.t, r.cell): r.value for r in spatial.subset_times(df, [4, 0, 0]).collect()}
    assert got == {(k, c): t * 10.0 + c for k, t in enumerate([4, 0, 0]) for c in range(2)}
    with pytest.raises(IndexError):
        spatial.subset_times(df, [1, 5])
