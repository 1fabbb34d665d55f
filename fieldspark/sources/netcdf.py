"""NetCDF's classic file format (32 or 64-bit offsets, or 64-bit data) as a Spark source and sink.

Big-endian, from the public specification of the format; it needs no library. The variable's first dimension is time;
``lat`` and ``lon`` have a dimension each (a regular grid) or hold a value for each cell (an irregular grid, stations).
Records of a variable lie a stride apart, so a run of times is one range of bytes or, where much else lies between,
one for each record. Packed values are unpacked (scale_factor, add_offset) and fill values are NULL. See ``gridfiles``
for partitions and files.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import gridfiles
from .experiments import Variable
from .gridfiles import Layout, Opened, Source, opened, spread

# Fixed values of the format: types by number, tags of lists, the length of a file that is still being written.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE, STREAMING = 10, 11, 12, 0xFFFFFFFF
#: Values that stand for nothing where a variable names none, by type.
FILLS = {4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36}


@dataclass
class Var:
    name: str
    dims: list[int]
    attributes: dict
    kind: int
    size: int
    begin: int


@dataclass
class Header:
    records: int
    dims: list[tuple[str, int]]
    variables: dict[str, Var]
    attributes: dict = field(default_factory=dict)

    def shape(self, v: Var) -> tuple[int, ...]:
        return tuple(self.records if not self.dims[d][1] else self.dims[d][1] for d in v.dims)

    def is_record(self, v: Var) -> bool:
        return bool(v.dims) and not self.dims[v.dims[0]][1]

    @property
    def stride(self) -> int:
        """Bytes from one record to the next; a record variable that is alone is not padded."""
        own = [v for v in self.variables.values() if self.is_record(v)]
        if len(own) == 1:
            return int(np.prod(self.shape(own[0])[1:], dtype=np.int64)) * np.dtype(TYPES[own[0].kind]).itemsize
        return sum(v.size for v in own)


class _Cursor:
    """Reads a header piece by piece, fetching more of the file as it goes on."""

    def __init__(self, file, step: int = 64 << 10):
        self.file, self.step, self.data, self.at, self.wide = file, step, b"", 0, False

    def take(self, n: int) -> bytes:
        while len(self.data) < self.at + n:
            more = self.file.read_at(max(self.step, self.at + n - len(self.data)), len(self.data))
            if not more:
                raise ValueError("the file ends within its header")
            self.data += more
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def int4(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">Q", self.take(8))[0] if self.wide else self.int4()

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def items(self, tag: int) -> range:
        found, n = self.int4(), self.count()
        if found not in (0, tag) or (not found and n):
            raise ValueError("a list of the header has the wrong tag")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.items(ATTRIBUTE):
            name, kind, n = self.name(), self.int4(), self.count()
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode(errors="replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
        return out


def header(path: str) -> Header:
    """The header of a file; ValueError if it is none of this format."""
    with opened(path) as file:
        c = _Cursor(file)
        magic = c.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path} is no classic NetCDF file")
        c.wide = magic[3] == 5
        records = c.count()
        dims = [(c.name(), c.count()) for _ in c.items(DIMENSION)]
        attributes = c.attributes()
        variables = {}
        for _ in c.items(VARIABLE):
            name, own = c.name(), [c.count() for _ in range(c.count())]
            v = Var(name, own, c.attributes(), c.int4(), c.count(), struct.unpack(">I", c.take(4))[0] if magic[3] == 1 else struct.unpack(">Q", c.take(8))[0])
            variables[name] = v
        out = Header(0 if records in (STREAMING, (1 << 64) - 1) else records, dims, variables, attributes)
        if records in (STREAMING, (1 << 64) - 1) and out.stride:  # still being written: as many as the file holds
            first = min(v.begin for v in variables.values() if out.is_record(v))
            out.records = (file.size() - first) // out.stride
        for v in variables.values():
            if v.kind not in TYPES:
                raise ValueError(f"unknown type of {v.name}")
            # the header's size is unreliable past 4 GB: the shape decides
            n = int(np.prod(out.shape(v)[1 if out.is_record(v) else 0 :], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize
            v.size = n + -n % 4
        return out


def values(file, h: Header, v: Var, first: int = 0, count: int | None = None) -> np.ndarray:
    """Entries first .. first + count - 1 along the first dimension (all without a count), unpacked; nothing is NaN."""
    shape, kind = h.shape(v), np.dtype(TYPES[v.kind])
    count = (shape[0] if shape else 1) - first if count is None else count
    row = int(np.prod(shape[1:], dtype=np.int64))
    step = h.stride if h.is_record(v) else row * kind.itemsize
    if h.is_record(v) and step > 4 * row * kind.itemsize:  # records of much else lie between
        raw = b"".join(file.read_at(row * kind.itemsize, v.begin + (first + k) * step) for k in range(count))
        got = np.frombuffer(raw, kind)
    else:
        wanted = (count - 1) * step + row * kind.itemsize if count and row else 0
        raw = file.read_at(wanted, v.begin + first * step)
        if len(raw) < wanted:
            raise ValueError(f"the file ends within {v.name}")
        got = np.lib.stride_tricks.as_strided(np.frombuffer(raw, np.uint8), (count, row * kind.itemsize), (step, 1)).copy().view(kind) if wanted else np.empty(0, kind)
    if got.size != count * row:
        raise ValueError(f"the file ends within {v.name}")
    out = got.reshape(count, row).astype(np.float64)
    named = [x for key in ("_FillValue", "missing_value") for x in np.atleast_1d(v.attributes.get(key, []))]
    fills = [float(x) for x in named] or ([FILLS[v.kind]] if v.kind in FILLS else [])
    missing = np.isin(out, fills)
    out = out * float(np.atleast_1d(v.attributes.get("scale_factor", 1.0))[0]) + float(np.atleast_1d(v.attributes.get("add_offset", 0.0))[0])
    out[missing] = np.nan
    return out


class NetcdfFile(Opened):
    def __init__(self, path: str, name: str):
        super().__init__(path, name)
        h = self.header = header(path)
        if missing := [n for n in (name, "time", "lat", "lon") if n not in h.variables]:
            raise ValueError(f"{path} has no variable {missing[0]}")
        v, t = h.variables[name], h.variables["time"]
        if len(t.dims) != 1 or v.dims[:1] != t.dims:
            raise ValueError(f"time is not the first dimension of {name}")
        self.variable, self.row_bytes = v, int(np.prod(h.shape(v)[1:], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize
        self.units, self.calendar = t.attributes.get("units"), t.attributes.get("calendar", "standard")

    def times(self) -> np.ndarray:
        return values(self.file, self.header, self.header.variables["time"]).ravel()

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        h, v, parts = self.header, self.variable, []
        for n in ("lat", "lon"):
            c = h.variables[n]
            if any(d not in v.dims[1:] for d in c.dims):
                raise ValueError(f"{n} has a dimension that {v.name} has not")
            parts += [values(self.file, h, c).reshape(h.shape(c)), [v.dims[1:].index(d) for d in c.dims]]
        return spread(*parts, h.shape(v)[1:])

    def values(self, first: int, count: int) -> np.ndarray:
        return values(self.file, self.header, self.variable, first, count)


class NetcdfSource(Source):
    kind = NetcdfFile

    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"


def read(spark: SparkSession, paths: list[str], name: str, first: float | None = None, last: float | None = None, partition_bytes: int = gridfiles.PARTITION_BYTES) -> DataFrame:
    """Rows (time, cell, lat, lon, value) of a variable, for times from ``first`` to ``last``."""
    return gridfiles.read(spark, NetcdfSource, paths, name, first, last, partition_bytes)


def variable(spark: SparkSession, paths: list[str], name: str, base_year: int = 1) -> Variable:
    return gridfiles.variable(spark, NetcdfSource, paths, name, base_year)


# ---- writing -------------------------------------------------------------------------------------------------
def _name(x: str) -> bytes:
    raw = x.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _list(tag: int, parts: list[bytes]) -> bytes:
    return struct.pack(">II", tag if parts else 0, len(parts)) + b"".join(parts)


def _attributes(a: dict) -> bytes:
    parts = []
    for k, v in a.items():
        raw, kind, n = (v.encode(), 2, len(v.encode())) if isinstance(v, str) else (np.array(v, ">f8").tobytes(), 6, 1)
        parts.append(_name(k) + struct.pack(">II", kind, n) + raw + b"\0" * (-len(raw) % 4))
    return _list(ATTRIBUTE, parts)


def head(dims: list[tuple[str, int]], variables: list[tuple[str, list[int], dict, bool]], records: int) -> bytes:
    """A header with 64-bit offsets for variables of doubles (name, dims, attributes, by record)."""
    sizes = [8 * int(np.prod([dims[d][1] for d in own if dims[d][1]], dtype=np.int64)) for _, own, _, _ in variables]

    def made(begins: list[int]) -> bytes:
        parts = [_name(n) + struct.pack(f">I{len(own)}I", len(own), *own) + _attributes(a) + struct.pack(">IIQ", 6, min(s, 0xFFFFFFFC), b) for (n, own, a, _), s, b in zip(variables, sizes, begins, strict=True)]
        return b"CDF\x02" + struct.pack(">I", records) + _list(DIMENSION, [_name(n) + struct.pack(">I", s) for n, s in dims]) + _attributes({}) + _list(VARIABLE, parts)

    at = len(made([0] * len(variables)))
    begins = [0] * len(variables)
    for by_record in (False, True):
        for k, v in enumerate(variables):
            if v[3] == by_record:
                begins[k], at = at, at + sizes[k]
    return made(begins)


class NetcdfLayout(Layout):
    suffix = "nc"

    def head(self) -> bytes:
        variables = [("lat", [1], {"units": "degrees_north"}, False), ("lon", [1], {"units": "degrees_east"}, False), ("time", [0], {"units": self.units, "calendar": self.calendar}, True), (self.name, [0, 1], {"_FillValue": self.fill}, True)]
        return head([("time", 0), ("cell", len(self.lat))], variables, self.times) + self.lat.astype(">f8").tobytes() + self.lon.astype(">f8").tobytes()

    def record(self, time: float, values: np.ndarray) -> bytes:
        return np.concatenate([[time], values]).astype(">f8").tobytes()


def write(rows: DataFrame, folder: str, name: str, units: str, calendar: str = "standard", times_a_file: int = 120, fill: float = 1e20) -> list[str]:
    """Writes rows (time, lat, lon, value) as files of a run of times each, places along ``cell``; gives their paths."""
    return gridfiles.write(rows, NetcdfLayout, folder, name, units, calendar, times_a_file, fill)
