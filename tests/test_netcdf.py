import struct

import numpy as np
import pytest

from fieldspark.sources import experiments, gridfiles, netcdf


def made(path, dims, variables, records=0, magic=2):
    """A file by hand: variables are (name, dims, attributes as (name, type, values), type, array)."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    wide = magic == 5
    count = lambda n: struct.pack(">Q" if wide else ">I", n)
    name = lambda x: count(len(x)) + pad(x.encode())
    listed = lambda tag, parts: struct.pack(">I", tag if parts else 0) + count(len(parts)) + b"".join(parts)

    def attributes(a):
        return listed(12, [name(k) + struct.pack(">I", t) + (count(len(v)) + pad(v.encode()) if t == 2 else count(len(v)) + pad(np.array(v, netcdf.TYPES[t]).tobytes())) for k, t, v in a])

    def head(begins):
        own = [name(n) + count(len(d)) + b"".join(count(x) for x in d) + attributes(a) + struct.pack(">I", t) + count(len(pad(x.reshape(-1)[: x.size // (records or 1) if by else x.size].tobytes()))) + struct.pack(">I" if magic == 1 else ">Q", b) for (n, d, a, t, x), b, by in zip(variables, begins, record)]
        return b"CDF" + bytes([magic]) + count(records) + listed(10, [name(n) + count(k) for n, k in dims]) + attributes([]) + listed(11, own)

    variables = [(n, d, a, t, np.asarray(x).astype(netcdf.TYPES[t])) for n, d, a, t, x in variables]
    record = [bool(d) and dims[d[0]][1] == 0 for _, d, _, _, _ in variables]
    at, begins = len(head([0] * len(variables))), {}
    body = b""
    for k, v in enumerate(variables):
        if not record[k]:
            begins[k] = at + len(body)
            body += pad(v[4].tobytes())
    start = at + len(body)
    single = sum(record) == 1
    for r in range(records):
        for k, v in enumerate(variables):
            if record[k]:
                if r == 0:
                    begins[k] = start + len(body) - (start - at)
                body += v[4][r : r + 1].tobytes() if single else pad(v[4][r : r + 1].tobytes())
    path.write_bytes(head([begins.get(k, start) for k in range(len(variables))]) + body)
    return str(path)


UNITS = [("units", 2, "days since 0001-01-01"), ("calendar", 2, "360_day")]


@pytest.mark.parametrize("magic", [1, 2, 5])
def test_regular_grid_packed_and_padded(spark, tmp_path, magic):
    x = np.arange(5 * 2 * 3).reshape(5, 2, 3)
    x[1, 0, 2] = -99
    path = made(tmp_path / "a.nc", [("time", 0), ("lat", 2), ("lon", 3)], [("lat", [1], [], 5, [10.0, -10.0]), ("lon", [2], [], 4, [0, 120, 240]), ("time", [0], UNITS, 6, [0, 30, 60, 90, 120]), ("v", [0, 1, 2], [("scale_factor", 6, [0.5]), ("add_offset", 6, [1.0]), ("_FillValue", 3, [-99])], 3, x), ("other", [0], [], 3, np.arange(5))], 5, magic)
    rows = netcdf.read(spark, [path], "v", partition_bytes=20)
    assert rows.rdd.getNumPartitions() == 5
    got = {(r.time, r.cell): (r.lat, r.lon, r.value) for r in rows.collect()}
    assert len(got) == 30
    for t in range(5):
        for i in range(2):
            for j in range(3):
                want = None if x[t, i, j] == -99 else x[t, i, j] * 0.5 + 1
                assert got[30.0 * t, i * 3 + j] == ([10.0, -10.0][i], 120.0 * j, want)


def test_one_record_variable_and_fixed_time(spark, tmp_path):
    """Times of a fixed size; a file whose number of records was never written; lat and lon by cell."""
    lat, lon = np.array([[1.0, 2, 3], [4, 5, 6]]), np.array([[7.0, 8, 9], [1, 2, 3]])
    x = np.arange(24.0).reshape(4, 2, 3)
    path = made(tmp_path / "fixed.nc", [("time", 4), ("y", 2), ("x", 3)], [("lat", [1, 2], [], 6, lat), ("lon", [1, 2], [], 6, lon), ("time", [0], UNITS, 4, [3, 1, 4, 2]), ("v", [0, 1, 2], [], 5, x)])
    got = {(r.time, r.lat, r.lon): r.value for r in netcdf.read(spark, [path], "v", partition_bytes=50).collect()}
    assert got == {(float([3, 1, 4, 2][t]), lat[i, j], lon[i, j]): x[t, i, j] for t in range(4) for i in range(2) for j in range(3)}
    path = made(tmp_path / "open.nc", [("time", 0), ("cell", 3)], [("lat", [1], [], 6, lat[0]), ("lon", [1], [], 6, lon[0]), ("time", [0], UNITS, 4, [1, 2, 3, 4]), ("v", [0, 1], [], 5, x[:, 0])], 4)
    raw = bytearray((tmp_path / "open.nc").read_bytes())
    raw[4:8] = b"\xff" * 4
    (tmp_path / "open.nc").write_bytes(raw)
    assert netcdf.header(path).records == 4 and netcdf.read(spark, [path], "v").count() == 12


def test_ends_skip_bytes(spark, tmp_path):
    """Only runs of times between the ends are planned; the rest of the file may even be damaged."""
    x = np.arange(100.0).reshape(50, 2)
    paths = [made(tmp_path / f"{k}.nc", [("time", 0 if k < 2 else 50), ("cell", 2)], [("lat", [1], [], 6, [0, 1]), ("lon", [1], [], 6, [0, 1]), ("time", [0], UNITS, 6, np.arange(50) + 50 * k), ("v", [0, 1], [], 6, x + 100 * k)], 50 if k < 2 else 0) for k in range(3)]
    rows = netcdf.read(spark, paths, "v", partition_bytes=160)
    assert rows.rdd.getNumPartitions() == 15
    few = netcdf.read(spark, paths, "v", 45, 51, 160)
    assert sorted(r.value for r in few.where("value > 91").collect()) == [*map(float, range(92, 104))]
    assert few.rdd.getNumPartitions() == 2
    assert few.where("time < 47").union(few.where("time > 50")).count() == 6
    assert [(p.path[-4:], p.first, p.count) for p in gridfiles.Reader(netcdf.NetcdfFile, paths, "v", 45, 51, 160).partitions()] == [("0.nc", 45, 5), ("1.nc", 0, 2)]
    (tmp_path / "2.nc").write_bytes((tmp_path / "2.nc").read_bytes()[:-700])  # the last values of the third file, whose times lie before them
    assert netcdf.read(spark, paths, "v", 99, 100).count() == 4
    with pytest.raises(Exception, match="ends within"):
        netcdf.read(spark, paths, "v", 120).collect()


def test_round_trip_in_files(spark, tmp_path):
    rows = [(30.0 * t, float(c % 3), float(c), None if c == t else t + c / 10) for t in range(11) for c in range(5) if (t, c) != (4, 4)]
    df = spark.createDataFrame(rows, "time double, lat double, lon double, value double").repartition(4)
    paths = netcdf.write(df, f"file://{tmp_path}/out", "v", "days since 0800-01-01", "360_day", 4)
    assert len(paths) == 3 and sorted(p.name for p in (tmp_path / "out").iterdir()) == [p.rsplit("/", 1)[1] for p in paths]
    assert [netcdf.header(p).records for p in paths] == [4, 4, 3]
    got = {(r.time, r.lat, r.lon): r.value for r in netcdf.read(spark, paths, "v").collect()}
    assert got == {**{(t, a, o): v for t, a, o, v in rows}, (120.0, 1.0, 4.0): None}
    field, grid = experiments.load(netcdf.variable(spark, paths, "v", 800))
    assert sorted({r.t for r in field.collect()}) == list(range(11)) and grid.count() == 5
    again = netcdf.write(df, f"file://{tmp_path}/out", "v", "days since 0800-01-01", "360_day", 4)
    assert again == paths and netcdf.read(spark, paths, "v").count() == 55
    with pytest.raises(ValueError, match="twice"):
        netcdf.write(df.union(df.limit(1)), str(tmp_path), "v", "days since 0001-01-01")


def test_what_is_no_variable(spark, tmp_path):
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(ValueError, match="no classic"):
        netcdf.header(str(tmp_path / "x.nc"))
    (tmp_path / "y.nc").write_bytes(b"CDF\x01\x00")
    with pytest.raises(ValueError, match="ends within its header"):
        netcdf.header(str(tmp_path / "y.nc"))
    good = [("lat", [1], [], 6, [0, 1]), ("lon", [1], [], 6, [0, 1]), ("time", [0], UNITS, 6, [1.0]), ("v", [0, 1], [], 6, [[1.0, 2.0]])]
    path = made(tmp_path / "z.nc", [("time", 1), ("cell", 2)], good)
    with pytest.raises(ValueError, match="no variable w"):
        netcdf.variable(spark, [path], "w")
    late = made(tmp_path / "late.nc", [("time", 1), ("cell", 2)], [*good[:3], ("v", [1, 0], [], 6, [[1.0], [2.0]])])
    with pytest.raises(ValueError, match="first dimension"):
        netcdf.NetcdfFile(late, "v")
    none = made(tmp_path / "none.nc", [("time", 0), ("cell", 2)], [*good[:2], ("time", [0], UNITS, 6, np.empty(0)), ("v", [0, 1], [], 6, np.empty((0, 2)))])
    assert netcdf.read(spark, [none], "v").count() == 0
