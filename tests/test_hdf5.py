import struct
import zlib

import numpy as np
import pytest

from fieldspark.sources import experiments, gridfiles, hdf5
from fieldspark.sources.hdf5 import _dataset, _message, _note, _object, _space


class Bytes:
    """A file in memory that grows; parts get addresses as they are added."""

    def __init__(self, start=0):
        self.raw = bytearray(b"\0" * start)

    def add(self, part):
        self.raw += b"\0" * (-len(self.raw) % 8)
        self.raw += part
        return len(self.raw) - len(part)


def chunk_tree(f, base, chunk, kept, leaf):
    """Chunks (offsets, bytes, mask) in a B-tree whose leaves hold ``leaf`` of them."""
    key = lambda c, raw=b"", mask=0: struct.pack(f"<II{len(c) + 1}Q", len(raw), mask, *c, 0)
    level, nodes = 0, [(o, f.add(raw) - base, raw, mask) for o, raw, mask in kept]
    while level == 0 or len(nodes) > 1:
        up = []
        for k in range(0, len(nodes), leaf):
            own = nodes[k : k + leaf]
            last = nodes[k + leaf][0] if k + leaf < len(nodes) else (own[-1][0][0] + chunk[0], *own[-1][0][1:])
            body = b"".join(key(o, raw, mask) + struct.pack("<Q", at) for o, at, raw, mask in own) + key(last)
            up.append((own[0][0], f.add(b"TREE" + struct.pack("<BBHQQ", 1, level, len(own), (1 << 64) - 1, (1 << 64) - 1) + body) - base, b"", 0))
        level, nodes = level + 1, up
    return nodes[0][1]


def new_style(path, x, chunk, filters=(), drop=(), start=512, leaf=2):
    """A file with a user's block, superblock 2, version 2 headers, link messages, chunks under two levels and filters."""
    f = Bytes(start)
    f.raw += b"\0" * 48

    def packed(part):
        raw, mask = part.tobytes(), 0
        for k, number in enumerate(filters):
            if number == hdf5.SHUFFLE:
                raw = np.frombuffer(raw, np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
            elif number == hdf5.CHECKSUM:
                raw += b"abcd"
            elif number == hdf5.DEFLATE:
                if part.flat[0] % 2:  # a chunk whose filter was skipped
                    mask |= 1 << k
                else:
                    raw = zlib.compress(raw)
        return raw, mask

    kept = []
    for i in range(0, x.shape[0], chunk[0]):
        for j in range(0, x.shape[1], chunk[1]):
            if (i, j) not in drop:
                part = np.zeros(chunk, x.dtype)
                own = x[i : i + chunk[0], j : j + chunk[1]]
                part[: own.shape[0], : own.shape[1]] = own
                kept.append(((i, j), *packed(part)))
    tree = chunk_tree(f, start, chunk, kept, leaf)
    kind = struct.pack("<B3BIHH", 0x10, 9, 0, 0, 4, 0, 32)  # big-endian integers
    pipeline = bytes([2, len(filters)]) + b"".join(struct.pack("<HHH", n, 0, 0) for n in filters)
    layout = struct.pack("<BBBQ", 3, 2, 3, tree) + struct.pack("<III", *chunk, 4)

    def v2(messages, kept_aside=b""):
        body = b"".join(struct.pack("<BHB", k, len(raw), 0) + raw for k, raw in messages)
        return f.add(b"OHDR" + bytes([2, 1]) + struct.pack("<H", len(body)) + body + b"sum!") - start

    space = bytes([2, 2, 0, 1]) + struct.pack("<QQ", *x.shape)
    extra = struct.pack("<BHB", 12, len(note := bytes([3, 0]) + struct.pack("<HHHB", 11, 12, 4, 0) + b"fill_value\0" + struct.pack("<B3BIHH", 0x10, 8, 0, 0, 8, 0, 64)[:12] + bytes([2, 0, 0, 0]) + struct.pack("<q", -9)), 0) + note
    block = f.add(b"OCHK" + extra + b"sum!") - start
    data = v2([(1, space), (3, kind), (5, bytes([3, 0x20]) + struct.pack("<I", 4) + struct.pack(">i", -9)), (8, layout), (11, pipeline), (16, struct.pack("<QQ", block, len(extra) + 8))])
    lay = lambda values: struct.pack("<BBQQ", 3, 1, f.add(values.astype("<f8").tobytes()) - start, 8 * values.size)
    one = lambda values, notes: f.add(_dataset(values.shape, lay(values), notes)) - start
    objects = {"v": data, "lat": one(np.arange(x.shape[1] // 2) * 1.0, {"index": 1}), "lon": one(np.arange(x.shape[1] // 2) * 2.0, {"index": 1}), "time": one(np.arange(x.shape[0]) * 10.0, {"units": "days since 0001-01-01"})}
    if x.shape[1] % 2 == 0:
        objects["lat"], objects["lon"] = one(np.arange(x.shape[1]) * 1.0, {}), one(np.arange(x.shape[1]) * 2.0, {})
    inner = v2([(6, bytes([1, 0, len(n)]) + n.encode() + struct.pack("<Q", at)) for n, at in objects.items()])
    root = v2([(2, bytes([0, 0]) + struct.pack("<QQ", (1 << 64) - 1, (1 << 64) - 1)), (6, bytes([1, 0, 4]) + b"data" + struct.pack("<Q", inner))])
    f.raw[start : start + 48] = hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", start, (1 << 64) - 1, len(f.raw), root) + b"sum!"
    path.write_bytes(f.raw)
    return str(path)


@pytest.mark.parametrize("filters", [(), (1,), (2, 1, 3)], ids=["plain", "deflate", "shuffle, deflate, checksum"])
def test_chunks_under_two_levels(spark, tmp_path, filters):
    x = np.random.default_rng(1).integers(0, 99, (23, 10)).astype(">i4")
    x[3, 4] = -9
    path = new_style(tmp_path / "a.h5", x, (4, 3), filters, drop={(8, 3)})
    want = x.astype(float)
    want[8:12, 3:6] = np.nan  # the chunk that was never written holds the fill value
    want[3, 4] = np.nan
    rows = hdf5.read(spark, [path], "data/v", partition_bytes=400)
    assert rows.rdd.getNumPartitions() == 3  # two chunks of rows each
    got = {(r.time, r.lat, r.lon): r.value for r in rows.collect()}
    assert got == {(10.0 * t, float(c), 2.0 * c): None if np.isnan(want[t, c]) else want[t, c] for t in range(23) for c in range(10)}
    with hdf5.Hdf5File(path, "/data/v") as f:
        assert {c.offsets for c in f.variable.chunks(9, 13)} == {(r, c) for r in (8, 12) for c in (0, 3, 6, 9)} - {(8, 3)}
        assert np.array_equal(f.values(5, 9), want[5:14], equal_nan=True)
    assert hdf5.read(spark, [path], "data/v", 90, 115).count() == 30


def test_round_trip_in_files(spark, tmp_path):
    rows = [(30.0 * t, float(c % 3), float(c), None if c == t else t + c / 10) for t in range(150) for c in range(5) if (t, c) != (4, 4)]
    df = spark.createDataFrame(rows, "time double, lat double, lon double, value double").repartition(4)
    paths = hdf5.write(df, f"file://{tmp_path}/out", "v", "days since 0800-01-01", "360_day", 70)
    assert len(paths) == 3 and sorted(p.name for p in (tmp_path / "out").iterdir()) == [p.rsplit("/", 1)[1] for p in paths]
    got = {(r.time, r.lat, r.lon): r.value for r in hdf5.read(spark, paths, "v", partition_bytes=800).collect()}
    assert got == {**{(t, a, o): v for t, a, o, v in rows}, (120.0, 1.0, 4.0): None}
    field, grid = experiments.load(hdf5.variable(spark, paths, "v", 800))
    assert sorted({r.t for r in field.collect()}) == list(range(150)) and grid.count() == 5
    with hdf5.Hdf5File(paths[0], "v") as f:
        assert (f.together, f.units, f.calendar) == (16, "days since 0800-01-01", "360_day") and len(list(f.variable.chunks(0, 70))) == 5
        assert [(p.first, p.count) for p in gridfiles.Reader(hdf5.Hdf5File, paths[:1], "v", 300, 30.0 * 40, 700).partitions()] == [(10, 6), (16, 16), (32, 9)]
    assert hdf5.write(df, f"file://{tmp_path}/out", "v", "days since 0800-01-01", "360_day", 70) == paths


def test_the_writer_keeps_to_the_format(tmp_path):
    """Addresses, alignment and sizes that other readers rely on."""
    made = hdf5.Hdf5Layout("v", "days since 0001-01-01", "standard", 1e20, np.arange(3.0), np.arange(3.0), 20)
    raw = made.head() + b"".join(made.record(t, np.full(3, t)) for t in range(20)) + made.tail(list(range(20)))
    assert raw[:8] == hdf5.SIGNATURE and struct.unpack_from("<Q", raw, 40)[0] == len(raw)
    root, btree, heap = struct.unpack_from("<Q", raw, 64)[0], *struct.unpack_from("<QQ", raw, 80)
    assert raw[root] == 1 and root % 8 == 0 and raw[btree : btree + 4] == b"TREE" and raw[heap : heap + 4] == b"HEAP"
    assert struct.unpack_from("<QQ", raw, root + 24) == (btree, heap)
    leaf = struct.unpack_from("<Q", raw, btree + 32)[0]
    assert raw[leaf : leaf + 4] == b"SNOD" and struct.unpack_from("<H", raw, leaf + 6)[0] == 4
    names = [raw[heap + 32 + struct.unpack_from("<Q", raw, leaf + 8 + 40 * k)[0] :].split(b"\0")[0] for k in range(4)]
    assert names == sorted(names) == [b"lat", b"lon", b"time", b"v"]
    (tmp_path / "a.h5").write_bytes(raw)
    with hdf5.Hdf5File(str(tmp_path / "a.h5"), "v") as f:
        assert f.values(15, 3).tolist() == [[t] * 3 for t in (15, 16, 17)] and f.times().tolist() == list(range(20))
        assert f.variable.attributes == {"fill_value": 1e20}


def test_what_is_not_read(spark, tmp_path):
    (tmp_path / "x.h5").write_bytes(b"CDF\x01" + b"\0" * 600)
    with pytest.raises(ValueError, match="no HDF5"):
        hdf5.Hdf5File(str(tmp_path / "x.h5"), "v")
    x = np.zeros((4, 4), ">i4")
    path = new_style(tmp_path / "f.h5", x, (2, 2), (32001,))
    with pytest.raises(ValueError, match="filter 32001"):
        hdf5.variable(spark, [path], "data/v")
    good = new_style(tmp_path / "g.h5", x, (2, 2))
    with pytest.raises(ValueError, match="no variable w"):
        hdf5.variable(spark, [good], "w")
    with pytest.raises(ValueError, match="no dataset"):
        hdf5.variable(spark, [good], "data")
    odd = new_style(tmp_path / "odd.h5", np.zeros((4, 5), ">i4"), (2, 2))
    with hdf5.Hdf5File(odd, "data/v") as f, pytest.raises(ValueError, match="fits no dimension"):
        f.places()
    assert _object([_message(1, _space(2))])[0] == 1 and len(_note("a", 1)) % 8 == 0
