"""Variables in HDF5 files as a Spark source and sink: contiguous and chunked datasets, from the public format specification.

The driver walks superblock, groups, object headers and the index of chunks; a partition is a run of times, cut where
chunks end, and reads only the chunks it needs (the index is descended only where its keys meet the run). Datasets may
be compact, contiguous or chunked with a version 1 B-tree, of whole numbers or floats of either byte order, with the
deflate, shuffle and checksum filters. What newer writers add (other chunk indexes, dense groups, other filters)
raises ValueError and names it. ``lat`` and ``lon`` name the axis of the variable that they lie along in an attribute
``index``; without one they take the axis of their length. Values equal to an attribute ``fill_value``, ``_FillValue``
or ``missing_value`` are NULL. See ``gridfiles`` for partitions and files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import gridfiles
from .experiments import Variable
from .gridfiles import Layout, Opened, Source, spread

# Fixed values of the format: its signature, the numbers of messages and filters, and of no address.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, LINK_INFO, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, SYMBOLS = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = (1 << 64) - 1


def _u(raw: bytes, at: int, n: int) -> int:
    return int.from_bytes(raw[at : at + n], "little")


def type_of(raw: bytes) -> np.dtype | None:
    """The NumPy type of a datatype message; None for one that is no number or string of fixed length."""
    kind, order, size = raw[0] & 15, "<>"[raw[1] & 1], _u(raw, 4, 4)
    if kind == 0:
        return np.dtype(f"{order}{'iu'[not raw[1] & 8]}{size}")
    if kind == 1 and size in (2, 4, 8):
        return np.dtype(f"{order}f{size}")
    return np.dtype(f"S{size}") if kind == 3 else None


def shape_of(raw: bytes) -> tuple[int, ...]:
    at = 8 if raw[0] == 1 else 4
    return tuple(_u(raw, at + 8 * k, 8) for k in range(raw[1]))


def _attribute(raw: bytes) -> tuple[str, object]:
    version, sizes = raw[0], [_u(raw, 2 + 2 * k, 2) for k in range(3)]
    at, parts = 9 if version == 3 else 8, []
    for n in sizes:
        parts.append(raw[at : at + n])
        at += n + -n % 8 if version == 1 else n
    kind, shape = type_of(parts[1]), shape_of(parts[2])
    if kind is None:
        return parts[0].rstrip(b"\0").decode(), None
    x = np.frombuffer(raw, kind, int(np.prod(shape, dtype=np.int64)), at)
    value = x[0].rstrip(b"\0").decode(errors="replace") if kind.kind == "S" and len(x) else x.tolist() if shape else x[0].item()
    return parts[0].rstrip(b"\0").decode(), value


class Tree:
    """The groups and objects of a file, read where they are asked for."""

    def __init__(self, file, path: str):
        self.file, self.base = file, 0
        size, at = file.size(), 0
        while self.read(at, 8) != SIGNATURE:  # a user's block of 512, 1024, ... bytes may come first
            at = 512 if not at else at * 2
            if at >= size:
                raise ValueError(f"{path} is no HDF5 file")
        head = self.read(at, 128)
        old = head[8] < 2
        if (head[13:15] if old else head[9:11]) != b"\x08\x08":
            raise ValueError("offsets that are not of 8 bytes")
        if old:
            fields = 24 + 4 * head[8]
            self.base, self.root = at and _u(head, fields, 8), _u(head, fields + 40, 8)
        else:
            self.base, self.root = _u(head, 12, 8), _u(head, 36, 8)

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, self.base + at)

    def messages(self, at: int) -> list[tuple[int, bytes]]:
        """(number, content) of the messages of an object header."""
        head, out = self.read(at, 32), []
        if head[:4] == b"OHDR":
            flags = head[5]
            start = 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            n = _u(self.read(at + start, 8), 0, width)
            blocks, step = [(at + start + width, n)], 4 + 2 * bool(flags & 4)
            while blocks:
                start, n = blocks.pop(0)
                raw, k = self.read(start, n), 0
                while k + step <= n:
                    kind, size = raw[k], _u(raw, k + 1, 2)
                    out.append((kind, raw[k + step : k + step + size]))
                    if kind == CONTINUED:
                        blocks.append((_u(out[-1][1], 0, 8) + 4, _u(out[-1][1], 8, 8) - 8))  # without signature and checksum
                    k += step + size
            return out
        if head[0] != 1:
            raise ValueError("unknown version of an object header")
        blocks = [(at + 16, _u(head, 8, 4))]
        while blocks:
            start, n = blocks.pop(0)
            raw, k = self.read(start, n), 0
            while k + 8 <= n:
                kind, size = _u(raw, k, 2), _u(raw, k + 2, 2)
                out.append((kind, raw[k + 8 : k + 8 + size]))
                if kind == CONTINUED:
                    blocks.append((_u(out[-1][1], 0, 8), _u(out[-1][1], 8, 8)))
                k += 8 + size
        return out

    def members(self, at: int) -> Iterator[tuple[str, int]]:
        """(name, address) of the objects in a group."""
        for kind, raw in self.messages(at):
            if kind == SYMBOLS:
                heap = self.read(_u(raw, 8, 8), 32)
                names = self.read(_u(heap, 24, 8), _u(heap, 8, 8))
                for leaf in self._leaves(_u(raw, 0, 8)):
                    table = self.read(leaf, 8)
                    entries = self.read(leaf + 8, 40 * _u(table, 6, 2))
                    for k in range(0, len(entries), 40):
                        start = _u(entries, k, 8)
                        yield names[start : names.index(b"\0", start)].decode(), _u(entries, k + 8, 8)
            elif kind == LINK:
                flags, k = raw[1], 2
                hard = not flags & 8 or raw[k] == 0
                k += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                n, k = _u(raw, k, 1 << (flags & 3)), k + (1 << (flags & 3))
                if hard:
                    yield raw[k : k + n].decode(), _u(raw, k + n, 8)
            elif kind == LINK_INFO and _u(raw, 2 + 8 * (raw[1] & 1), 8) != NOWHERE:
                raise ValueError("groups whose links lie in a heap are not read")

    def _leaves(self, at: int) -> Iterator[int]:
        node = self.read(at, 24)
        level, n = node[5], _u(node, 6, 2)
        body = self.read(at + 24, 16 * n + 8)
        for k in range(n):
            child = _u(body, 8 + 16 * k, 8)
            yield from [child] if not level else self._leaves(child)

    def find(self, path: str) -> int:
        """Address of the object at a path; KeyError if there is none."""
        at = self.root
        for part in filter(None, path.split("/")):
            at = dict(self.members(at)).get(part)
            if at is None:
                raise KeyError(path)
        return at


@dataclass
class Chunk:
    offsets: tuple[int, ...]
    at: int
    size: int
    mask: int


class Dataset:
    def __init__(self, tree: Tree, path: str):
        self.tree, own = tree, tree.messages(tree.find(path))
        found = dict(own)
        if SPACE not in found or LAYOUT not in found:
            raise ValueError(f"{path} is no dataset")
        self.shape, self.kind = shape_of(found[SPACE]), type_of(found[TYPE])
        if self.kind is None or self.kind.kind == "S":
            raise ValueError(f"{path} holds no numbers")
        self.attributes = dict(_attribute(raw) for kind, raw in own if kind == ATTRIBUTE)
        self.filters = self._filters(found.get(FILTERS))
        layout = found[LAYOUT]
        if layout[0] != 3 and not (layout[0] == 4 and layout[1] < 2):
            raise ValueError(f"the layout of {path} has an unknown index of chunks")
        self.chunk, self.raw, self.address = None, None, NOWHERE
        if layout[1] == 0:
            self.raw = layout[4 : 4 + _u(layout, 2, 2)]
        elif layout[1] == 1:
            self.address = _u(layout, 2, 8)
        else:
            self.address = _u(layout, 3, 8)
            self.chunk = tuple(_u(layout, 11 + 4 * k, 4) for k in range(layout[2] - 1))
        self.empty = self._fill(found.get(FILL))
        self.fills = [float(x) for key in ("fill_value", "_FillValue", "missing_value") for x in np.atleast_1d(self.attributes[key] if self.attributes.get(key) is not None else [])]

    def _filters(self, raw: bytes | None) -> list[int]:
        out = []
        if raw:
            k = 8 if raw[0] == 1 else 2
            for _ in range(raw[1]):
                number = _u(raw, k, 2)
                named = raw[0] == 1 or number >= 256
                length, values = _u(raw, k + 2, 2) if named else 0, _u(raw, k + 4 + 2 * named, 2)
                k += 6 + 2 * named + (length + -length % 8 if raw[0] == 1 else length) + 4 * values + (4 * (values % 2) if raw[0] == 1 else 0)
                if number not in (DEFLATE, SHUFFLE, CHECKSUM):
                    raise ValueError(f"filter {number} is not known")
                out.append(number)
        return out

    def _fill(self, raw: bytes | None) -> float:
        """What places hold that no chunk was written for."""
        if not raw or raw[0] not in (1, 2, 3):
            return 0.0
        has, at = (raw[1] & 32, 2) if raw[0] == 3 else (raw[3] or raw[0] == 1, 4)
        n = _u(raw, at, 4) if has else 0
        return float(np.frombuffer(raw, self.kind, 1, at + 4)[0]) if n == self.kind.itemsize else 0.0

    def chunks(self, first: int, end: int) -> Iterator[Chunk]:
        """Chunks that hold rows first .. end - 1."""
        if self.address != NOWHERE:
            yield from self._chunks(self.address, first, end)

    def _chunks(self, at: int, first: int, end: int) -> Iterator[Chunk]:
        node = self.tree.read(at, 24)
        if node[:4] != b"TREE" or node[4] != 1:
            raise ValueError("the index of chunks is broken")
        level, n, width = node[5], _u(node, 6, 2), 16 + 8 * len(self.chunk)
        body = self.tree.read(at + 24, n * (width + 8) + width)
        row = [_u(body, k * (width + 8) + 8, 8) for k in range(n + 1)]
        for k in range(n):
            key = k * (width + 8)
            child = _u(body, key + width, 8)
            if level:
                if row[k] < end and row[k + 1] + self.chunk[0] > first:
                    yield from self._chunks(child, first, end)
            elif row[k] < end and row[k] + self.chunk[0] > first:
                yield Chunk(tuple(_u(body, key + 8 + 8 * d, 8) for d in range(len(self.chunk))), child, _u(body, key, 4), _u(body, key + 4, 4))

    def _plain(self, c: Chunk) -> np.ndarray:
        raw = self.tree.read(c.at, c.size)
        if len(raw) != c.size:
            raise ValueError("the file ends within a chunk")
        for k in reversed(range(len(self.filters))):
            if c.mask >> k & 1:
                continue
            if self.filters[k] == DEFLATE:
                raw = zlib.decompress(raw)
            elif self.filters[k] == CHECKSUM:
                raw = raw[:-4]
            else:
                n = self.kind.itemsize
                whole = len(raw) // n * n
                raw = np.frombuffer(raw, np.uint8, whole).reshape(n, -1).T.tobytes() + raw[whole:]
        return np.frombuffer(raw, self.kind, int(np.prod(self.chunk))).reshape(self.chunk)

    def rows(self, first: int = 0, count: int | None = None) -> np.ndarray:
        """Entries along the first dimension as (count, ...) floats; fill values are NaN."""
        count = (self.shape[0] if self.shape else 1) - first if count is None else count
        rest = self.shape[1:]
        size = int(np.prod(rest, dtype=np.int64)) * self.kind.itemsize
        if self.chunk is None:
            raw = self.raw[first * size : (first + count) * size] if self.raw is not None else b"" if self.address == NOWHERE else self.tree.read(self.address + first * size, count * size)
            if self.raw is None and self.address == NOWHERE:
                out = np.full((count, *rest), self.empty)
            elif len(raw) != count * size:
                raise ValueError("the file ends within a dataset")
            else:
                out = np.frombuffer(raw, self.kind).reshape(count, *rest).astype(np.float64)
        else:
            out = np.full((count, *rest), self.empty)
            for c in self.chunks(first, first + count):
                low = [max(0, first - c.offsets[0]), *[0] * len(rest)]
                high = [min(n, end - o) for n, end, o in zip(self.chunk, (first + count, *rest), c.offsets)]
                at = [slice(c.offsets[0] + low[0] - first, c.offsets[0] + high[0] - first), *[slice(o, o + h) for o, h in zip(c.offsets[1:], high[1:])]]
                out[tuple(at)] = self._plain(c)[tuple(slice(a, b) for a, b in zip(low, high))]
        out[np.isin(out, self.fills)] = np.nan
        return out


class Hdf5File(Opened):
    """``name`` may be a path: the group that holds the variable holds its coordinates."""

    def __init__(self, path: str, name: str):
        super().__init__(path, name)
        tree, group = Tree(self.file, path), name.rpartition("/")[0]
        try:
            self.variable, self.lat, self.lon, self.time = (Dataset(tree, p) for p in (name, *[f"{group}/{c}" for c in ("lat", "lon", "time")]))
        except KeyError as e:
            raise ValueError(f"{path} has no variable {e.args[0].lstrip('/')}") from None
        v = self.variable
        if len(self.time.shape) != 1 or v.shape[:1] != self.time.shape or self.time.attributes.get("index", 0) != 0:
            raise ValueError(f"time is not the first dimension of {name}")
        self.row_bytes, self.together = int(np.prod(v.shape[1:], dtype=np.int64)) * v.kind.itemsize, v.chunk[0] if v.chunk else 1
        self.units, self.calendar = self.time.attributes.get("units"), self.time.attributes.get("calendar") or "standard"

    def times(self) -> np.ndarray:
        return self.time.rows()

    def _axes(self, c: Dataset, taken: list[int]) -> list[int]:
        rest, index = self.variable.shape[1:], c.attributes.get("index")
        if len(c.shape) == len(rest) and len(rest) > 1:
            return list(range(len(rest)))
        fits = [index - 1] if isinstance(index, int) else [a for a in range(len(rest)) if (rest[a],) == c.shape and a not in taken] or [a for a in taken if (rest[a],) == c.shape]
        if len(c.shape) != 1 or not fits or not 0 <= fits[0] < len(rest) or (rest[fits[0]],) != c.shape:
            raise ValueError("a coordinate fits no dimension")
        return fits[:1]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        lat = self._axes(self.lat, [])
        return spread(self.lat.rows(), lat, self.lon.rows(), self._axes(self.lon, lat), self.variable.shape[1:])

    def values(self, first: int, count: int) -> np.ndarray:
        return self.variable.rows(first, count).reshape(count, -1)


class Hdf5Source(Source):
    kind = Hdf5File

    @classmethod
    def name(cls) -> str:
        return "hdf5_grid"


def read(spark: SparkSession, paths: list[str], name: str, first: float | None = None, last: float | None = None, partition_bytes: int = gridfiles.PARTITION_BYTES) -> DataFrame:
    """Rows (time, cell, lat, lon, value) of a variable, for times from ``first`` to ``last``."""
    return gridfiles.read(spark, Hdf5Source, paths, name, first, last, partition_bytes)


def variable(spark: SparkSession, paths: list[str], name: str, base_year: int = 1) -> Variable:
    return gridfiles.variable(spark, Hdf5Source, paths, name, base_year)


# ---- writing: one group of datasets of doubles, in the oldest version of each structure ------------------------
def _message(kind: int, raw: bytes) -> bytes:
    raw += b"\0" * (-len(raw) % 8)
    return struct.pack("<HHB3x", kind, len(raw), 0) + raw


def _object(messages: list[bytes]) -> bytes:
    return struct.pack("<BxHII4x", 1, len(messages), 1, sum(map(len, messages))) + b"".join(messages)


def _space(*shape: int) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)


DOUBLE = struct.pack("<B3BIHHBBBBI", 0x11, 0x20, 0x3F, 0, 8, 0, 64, 52, 11, 0, 52, 1023)
INTEGER = struct.pack("<B3BIHH", 0x10, 8, 0, 0, 8, 0, 64)


def _note(name: str, value: str | int | float) -> bytes:
    raw = value.encode() + b"\0" if isinstance(value, str) else struct.pack("<q" if isinstance(value, int) else "<d", value)
    kind = struct.pack("<B3BI", 0x13, 0, 0, 0, len(raw)) if isinstance(value, str) else INTEGER if isinstance(value, int) else DOUBLE
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    parts = [name.encode() + b"\0", kind, _space()]
    return _message(ATTRIBUTE, struct.pack("<BxHHH", 1, *map(len, parts)) + b"".join(map(pad, parts)) + raw)


def _dataset(shape: tuple[int, ...], layout: bytes, notes: dict, filters: bytes = b"") -> bytes:
    own = [_message(SPACE, _space(*shape)), _message(TYPE, DOUBLE), _message(FILL, bytes([2, 2, 2, 0])), _message(LAYOUT, layout)]
    return _object([*own, *([_message(FILTERS, filters)] if filters else []), *[_note(k, v) for k, v in notes.items()]])


class Hdf5Layout(Layout):
    """Times are put together in chunks of whole records, at most 64 to a file, each after the other; no filter."""

    suffix = "h5"
    leaf = 32

    def head(self) -> bytes:
        cells, most = len(self.lat), 2 * self.leaf
        self.rows = max(-(-self.times // most), min(16, self.times), 1)
        n_chunks = -(-self.times // self.rows)
        names = sorted(["lat", "lon", "time", self.name])
        heap = bytearray(b"\0" * 8)
        place = {}
        for n in names:
            place[n] = len(heap)
            heap += n.encode() + b"\0" * (8 - len(n.encode()) % 8)
        notes = {"lat": {"index": 1}, "lon": {"index": 1}, "time": {"index": 0, "units": self.units, "calendar": self.calendar}, self.name: {"fill_value": self.fill}}
        shapes = {"lat": (cells,), "lon": (cells,), "time": (self.times,), self.name: (self.times, cells)}

        def built(at: dict[str, int]) -> dict[str, bytes]:
            """The parts of the file in front of the data, for their addresses."""
            root = {"btree": at["group"], "heap": at["heap"]}
            out = {"super": SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, at["end"], NOWHERE) + struct.pack("<QQI4xQQ", 0, at["root"], 1, root["btree"], root["heap"])}
            out["root"] = _object([_message(SYMBOLS, struct.pack("<QQ", root["btree"], root["heap"]))])
            out["heap"] = b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, at["heap"] + 32) + bytes(heap)
            out["group"] = (b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, at["leaf"], place[names[-1]])).ljust(24 + 16 * 32 + 8, b"\0")
            out["leaf"] = (b"SNOD" + struct.pack("<BxH", 1, len(names)) + b"".join(struct.pack("<QQI4x16x", place[n], at[f"object {n}"], 0) for n in names)).ljust(8 + 40 * 8, b"\0")
            for n in names:
                chunked = n == self.name
                layout = struct.pack("<BBB", 3, 2, 3) + struct.pack("<QIII", at["chunks"] if self.times else NOWHERE, self.rows, max(cells, 1), 8) if chunked else struct.pack("<BBQQ", 3, 1, at[f"data {n}"], 8 * int(np.prod(shapes[n])))
                out[f"object {n}"] = _dataset(shapes[n], layout, notes[n])
            key = lambda k: struct.pack("<IIQQQ", self.rows * cells * 8 if k < n_chunks else 0, 0, k * self.rows, 0, 0)
            tree = b"TREE" + struct.pack("<BBHQQ", 1, 0, n_chunks, NOWHERE, NOWHERE)
            out["chunks"] = (tree + b"".join(key(k) + struct.pack("<Q", at["data"] + k * self.rows * cells * 8) for k in range(n_chunks)) + key(n_chunks)).ljust(24 + 40 * most + 32, b"\0")
            return out

        at: dict[str, int] = dict.fromkeys(["end", "root", "group", "heap", "leaf", "chunks", "data", *[f"object {n}" for n in names], *[f"data {n}" for n in names]], 0)
        here = 0
        for k, raw in built(at).items():
            at[k], here = here, here + len(raw)
        at["data lat"], at["data lon"] = here, here + 8 * cells
        at["data"] = here + 16 * cells
        at["data time"] = at["data"] + n_chunks * self.rows * cells * 8
        at["end"] = at["data time"] + 8 * self.times
        self.missing = (n_chunks * self.rows - self.times) * cells
        return b"".join(built(at).values()) + self.lat.astype("<f8").tobytes() + self.lon.astype("<f8").tobytes()

    def record(self, time: float, values: np.ndarray) -> bytes:
        return values.astype("<f8").tobytes()

    def tail(self, times: list[float]) -> bytes:
        return np.full(self.missing, self.fill, "<f8").tobytes() + np.array(times, "<f8").tobytes()


def write(rows: DataFrame, folder: str, name: str, units: str, calendar: str = "standard", times_a_file: int = 120, fill: float = 1e20) -> list[str]:
    """Writes rows (time, lat, lon, value) as files of a run of times each, places along the second dimension; gives their paths."""
    return gridfiles.write(rows, Hdf5Layout, folder, name, units, calendar, times_a_file, fill)
