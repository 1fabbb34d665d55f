"""Embedding near-dedup with Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised; at cosine c two lie sqrt(2 - 2c) apart. One hash floors a random Gaussian
projection, shifted, over cells of ``WIDTH``; k of them joined name a bucket, in each of L tables. k grows
with the logarithm of the number of vectors, so that a vector meets some ``MATES`` unrelated ones in a table;
L follows from k so that a pair at the threshold misses all tables with probability 1e-5 at most.

1. Vectors that are equal once normalised form a class, known by a digest; only one of them goes on, with
   their number. So copies cost nothing, however many there are.
2. A pass takes some tables: tasks pack classes with their vectors into blocks of bytes, one for each
   partition of bucket keys, so that what is shuffled at once has about the size of ``PASS`` vector tables, and
   a vector is no row of its own. The shuffle files of a pass go before the next one.
3. Buckets larger than a task should hold (found by counting the keys of some classes, which decides nothing but
   the cut) are dealt into chunks; each unordered pair of chunks is a unit of work.
4. A task multiplies the members of a unit by tiles in single precision and takes those near the threshold again
   in double precision. A linked pair counts in the first table in which it meets, so pairs that meet in an earlier
   one are left out, a few tables at a time. For the components a class gets only the smallest id that it reaches
   by the links counted there.
5. Rows take the result of their class by its digest; a class with very many rows is dealt to parts.

Nothing is broadcast or collected but keys of buckets that are cut and of hot classes and links. Links and counts, which compress so well that
the optimizer would take them for small, are joined by sorting.

Defined results: null vectors, and ones with null or non-finite components, of zero length or no norm,
link with nothing; vectors of different length do not link; rows with one ``vec_id`` each count their own
links and share a component; a null ``vec_id`` links with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored
from .components import components

WIDTH, MISS, MATES = 2.0, 1e-5, 1024
#: Tables that are looked at together when a pair's first one is sought.
EARLY = 4
#: Rows of a tile; rows that are packed together; pairs that are settled together.
TILE, BLOCK, PAIRS = 1024, 32768, 500_000
#: Bytes of a partition; the vector tables that a pass shuffles, or bytes if these are more.
PART, PASS, LEAST = 8 << 20, 3, 256 << 20
#: Files of links of a pass, where there are no more than 8 times as many partitions: the driver lists them.
FILES = 64
#: Classes whose keys are counted to find the buckets that have to be cut, and members of a chunk of these.
COUNTED, CHUNK = 50_000, (2048, 16384)


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one p-stable (Gaussian) hash agrees for two points so far apart."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def shape(rows: int, cosine: float) -> tuple[int, int]:
    """Hashes a table and tables for so many vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows / MATES, 2)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


class Tables:
    def __init__(self, dims: int, k: int, tables: int):
        rng = np.random.default_rng([dims, k, tables])
        self.dims, self.k, self.tables = dims, k, tables
        self.lines = rng.standard_normal((dims, tables * k))
        self.shifts = rng.uniform(0, WIDTH, tables * k)
        self.codes = rng.integers(1, 1 << 63, (tables, k), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Bucket keys (rows x tables, all or those from first to before last); the table and the length are part of the key."""
        last = self.tables if last is None else min(last, self.tables)
        n = last - first
        cols = slice(first * self.k, last * self.k)
        out = np.empty((len(x), n), np.uint64)
        own = np.arange(first, last, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(self.dims * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        for a in range(0, len(x), 512):
            cell = np.floor((x[a : a + 512] @ self.lines[:, cols] + self.shifts[cols]) / WIDTH).astype(np.int64).astype(np.uint64)
            h = (cell.reshape(-1, n, self.k) * self.codes[first:last]).sum(axis=2, dtype=np.uint64)
            h ^= own
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[a : a + 512] = h ^ (h >> np.uint64(32))
        return out


_tables: dict[tuple[int, int, int], Tables] = {}


def tables_for(dims: int, k: int, tables: int) -> Tables:
    if (dims, k, tables) not in _tables:
        _tables[dims, k, tables] = Tables(dims, k, tables)
    return _tables[dims, k, tables]


def units(column: pa.Array) -> list[np.ndarray | None]:
    """Normalised vectors in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            scale = np.abs(x).max()
            if not np.isfinite(scale) or scale == 0:
                x = None
            else:
                x = x / scale
                x /= math.sqrt(float(x @ x))
        out.append(x)
    return out


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector, digest): the vector as it came, the digest of the normalised one; null twice where it links with nothing."""
    for batch in batches:
        given = batch.column(1)
        digests = [None if x is None else hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() for x in units(given)]
        vector = pa.array([v if d is not None else None for v, d in zip(_rows(given), digests, strict=True)], given.type)
        yield pa.RecordBatch.from_arrays([batch.column(0), vector, pa.array(digests, pa.binary())], names=["vec_id", "vector", "digest"])


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    return [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in column]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows normalised in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Columns (uid, vec_id, m, vectors) of about ``BLOCK`` rows with vectors of one length."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths).tolist():
            own = batch.filter(pa.array(lengths == dims))
            ids = [own.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            held.setdefault(dims, []).append((*ids, own.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)))
            if sum(len(h[0]) for h in held[dims]) >= min(BLOCK, (64 << 20) // (8 * dims)):
                yield tuple(map(np.concatenate, zip(*held.pop(dims), strict=True)))
    for parts in held.values():
        yield tuple(map(np.concatenate, zip(*parts, strict=True)))


def _record(dims: int, number: np.dtype) -> np.dtype:
    """A member of unit (key, i, j): its table, its chunk, its class and its vector."""
    return np.dtype([("key", "u8"), ("i", "u2"), ("j", "u2"), ("chunk", "u2"), ("table", "u2"), ("uid", "i8"), ("vec_id", "i8"), ("m", "i8"), ("x", number, (dims,))])


def _count(k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, x in _blocks(batches):
            for a in range(0, len(x), 4096):
                key, n = np.unique(tables_for(x.shape[1], k, tables).keys(unit(x[a : a + 4096])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _pack(k: int, tables: int, first: int, last: int, parts: int, cut: dict[int, int]):
    """Rows (part, dims, data): members of the units of a partition, of tables ``first`` to before ``last`` with ``parts`` partitions each."""
    cut_keys = np.array(sorted(cut), np.uint64)
    chunks = np.array([cut[key] for key in sorted(cut)], np.int64)

    def dealt(key: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, i, j and chunk of every member of a unit."""
        n = np.ones(len(key), np.int64)
        if len(cut_keys):
            at = np.minimum(np.searchsorted(cut_keys, key), len(cut_keys) - 1)
            n = np.where(cut_keys[at] == key, chunks[at], 1)
        row = np.repeat(np.arange(len(key)), n)
        other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        chunk = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)[row] % n[row]
        return row, np.minimum(chunk, other), np.maximum(chunk, other), chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, vec_id, m, x in _blocks(batches):
            kind, u = _record(x.shape[1], x.dtype), unit(x)
            for table in range(first, last):
                keys = tables_for(x.shape[1], k, tables).keys(u, table, table + 1)[:, 0]
                every = dealt(keys, uid)
                for a in range(0, len(every[0]), BLOCK):
                    row, i, j, chunk = (c[a : a + BLOCK] for c in every)
                    place = (keys[row] + (i * 65536 + j).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(parts)
                    order = np.argsort(place, kind="stable")
                    row, place = row[order], place[order]
                    out = np.empty(len(row), kind)
                    for name, c in (("key", keys[row]), ("i", i[order]), ("j", j[order]), ("chunk", chunk[order]), ("table", table), ("uid", uid[row]), ("vec_id", vec_id[row]), ("m", m[row]), ("x", x[row])):
                        out[name] = c
                    ends = np.r_[np.flatnonzero(np.diff(place)) + 1, len(place)]
                    starts = np.r_[0, ends[:-1]]
                    part = pa.array((place[starts].astype(np.int64) + (table - first) * parts).astype(np.int32))
                    data = pa.array([out[p:q].tobytes() for p, q in zip(starts, ends, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(starts), x.shape[1], np.int32)), data], names=["part", "dims", "data"])

    return run


def _compare(cosine: float, k: int, tables: int, number: np.dtype):
    """Rows (uid, vec_id, n, low): classes linked in a partition and the smallest vec_id that each reaches by these links."""
    schema = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])

    def near(v: np.ndarray, u: np.ndarray, p: range, q: range) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs between two runs of rows, or within one."""
        slack = (v.shape[1] + 8) * 1.2e-7  # of sums in single precision
        found = []
        for a in range(p.start, p.stop, TILE):
            for b in range(a if p == q else q.start, q.stop, TILE):
                s = v[a : min(a + TILE, p.stop)] @ v[b : min(b + TILE, q.stop)].T
                x, y = np.nonzero(s >= cosine - slack)
                if p == q and a == b:
                    x, y = x[x < y], y[x < y]
                close = np.flatnonzero(s[x, y] < cosine + slack)
                x, y = x + a, y + b
                if len(close):
                    ok = np.ones(len(x), bool)
                    for c in range(0, len(close), 65536):
                        w = close[c : c + 65536]
                        ok[w] = np.einsum("ij,ij->i", u[x[w]], u[y[w]]) >= cosine
                    x, y = x[ok], y[ok]
                found.append((x, y))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def settle(rec: np.ndarray, u: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
        """Counts of the pairs that meet in no earlier table."""
        table = rec["table"][a].astype(np.int64)
        for first in range(0, int(table.max()), EARLY):
            late = table > first
            if not late.any():
                break
            last = min(first + EARLY, int(table.max()))
            rows, where = np.unique(np.r_[a[late], b[late]], return_inverse=True)
            keys = tables_for(u.shape[1], k, tables).keys(u[rows], first, last)
            half, met = len(where) // 2, np.zeros(int(late.sum()), bool)
            for c in range(last - first):
                met |= (keys[where[:half], c] == keys[where[half:], c]) & (table[late] > first + c)
            left = ~late
            left[late] = ~met
            a, b, table = a[left], b[left], table[left]
            if not len(a):
                return None
        rows, where = np.unique(np.r_[a, b], return_inverse=True)
        p, q = where[: len(a)], where[len(a) :]
        vec_id, m = rec["vec_id"][rows], rec["m"][rows]
        n = np.bincount(p, m[q], len(rows)) + np.bincount(q, m[p], len(rows))
        low, last = vec_id.copy(), None
        while last is None or (low != last).any():
            last = low.copy()
            np.minimum.at(low, p, last[q])
            np.minimum.at(low, q, last[p])
        return pa.RecordBatch.from_arrays([pa.array(rec["uid"][rows]), pa.array(vec_id), pa.array(n.astype(np.int64)), pa.array(low)], schema=schema)

    def solve(rec: np.ndarray) -> Iterator[pa.RecordBatch]:
        rec = rec[np.lexsort((rec["chunk"], rec["j"], rec["i"], rec["key"]))]
        new = np.zeros(len(rec), bool)
        for name in ("key", "i", "j"):
            new[1:] |= rec[name][1:] != rec[name][:-1]
        size = np.diff(np.r_[0, np.flatnonzero(new), len(rec)])
        rec, size = rec[np.repeat(size > 1, size)], size[size > 1]
        if not len(rec):
            return
        u = unit(rec["x"])
        v = u.astype(np.float32)
        pairs, held = [], 0
        ends = np.cumsum(size)
        for a, b, i, j in zip((ends - size).tolist(), ends.tolist(), rec["i"][ends - 1].tolist(), rec["j"][ends - 1].tolist(), strict=True):
            middle = b if i == j else a + int((rec["chunk"][a:b] == i).sum())
            if i != j and middle in (a, b):
                continue
            x, y = near(v, u, range(a, middle), range(a, middle) if i == j else range(middle, b))
            if len(x):
                pairs.append((x, y))
                held += len(x)
            if held >= PAIRS:
                for c in _cuts(pairs):
                    if (got := settle(rec, u, *c)) is not None:
                        yield got
                pairs, held = [], 0
        for c in _cuts(pairs):
            if (got := settle(rec, u, *c)) is not None:
                yield got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for dims, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(dims, []).append(data)
        for dims in list(held):
            yield from solve(np.frombuffer(b"".join(held.pop(dims)), _record(dims, number)))

    return run


def _cuts(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs, some at a time."""
    if pairs:
        x, y = map(np.concatenate, zip(*pairs, strict=True))
        for c in range(0, len(x), 2 * PAIRS):
            yield x[c : c + 2 * PAIRS], y[c : c + 2 * PAIRS]


def _to_cut(vectors: DataFrame, rows: int, k: int, tables: int) -> dict[int, int]:
    """Chunks of the buckets with more than two chunks of members, by key: at most as many of a table as its rows hold two chunks."""
    chunk = min(max(CHUNK[0], rows // 64), CHUNK[1])
    every = max(1, rows // COUNTED)
    if rows <= 2 * chunk:
        return {}
    some = vectors.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0) if every > 1 else vectors
    found = some.mapInArrow(_count(k, tables), "key long, n long").groupBy("key").agg((F.sum("n") * every).alias("n")).where(F.col("n") > 2 * chunk).collect()
    return {r.key & (1 << 64) - 1: min(math.ceil(r.n / chunk), 65535) for r in found}


def linked(vectors: DataFrame, cosine: float) -> DataFrame:
    """(uid, vec_id, n, low) of what the units of ``vectors`` (uid, vec_id, m, vector) found; a class may come several times."""
    spark = vectors.sparkSession
    number = np.dtype("f4" if vectors.schema["vector"].dataType.elementType.typeName() == "float" else "f8")
    rows, numbers = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    k, tables = shape(rows, cosine)
    cut = _to_cut(vectors, rows, k, tables)
    each = number.itemsize * numbers + 40 * rows
    more = sum(n * n * min(max(CHUNK[0], rows // 64), CHUNK[1]) for n in cut.values()) * each / max(rows, 1) / tables  # of chunks sent several times
    at_once = max(1, min(tables, int(max(PASS * each, LEAST) // max(each + more, 1))))
    parts = max(math.ceil((each + more) / PART), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / at_once))
    out = None
    for first in range(0, tables, at_once):
        last = min(first + at_once, tables)
        packed = vectors.mapInArrow(_pack(k, tables, first, last, parts, cut), "part int, dims int, data binary").repartitionById((last - first) * parts, F.col("part"))
        links = packed.mapInArrow(_compare(cosine, k, tables, number), "uid long, vec_id long, n long, low long")
        found = stored(links.coalesce(max(FILES, (last - first) * parts // 8)), "linked")
        out = found if out is None else out.union(found)
        del packed, links
        found.isEmpty()  # until another action ends, listeners hold the last plan
        gc.collect()
        spark._jvm.System.gc()  # the cleaner deletes shuffle files once their plan is unreachable
    return out


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    normal = given.mapInArrow(_normal, f"vec_id long, vector {kind}, digest binary")
    rows = stored(normal.select("vec_id", "digest").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    real = rows.where("vec_id is not null and digest is not null")
    classes = normal.where("vec_id is not null and digest is not null").groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    found = linked(classes.select("uid", "vec_id", "m", "vector"), cosine)
    # an id with several vectors ties their classes together
    several = real.groupBy("vec_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select(F.col("vec_id").alias("id"))
    ties = real.join(several, F.col("vec_id") == F.col("id")).select("id", "digest").join(classes.select("digest", "vec_id"), "digest").where("id <> vec_id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    links = found.where("low <> vec_id").select(F.col("vec_id").alias("a"), F.col("low").alias("b")).distinct().union(ties)
    group = stored(components(links, hint="merge"), "components")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    of = classes.select("uid", "digest", "vec_id", "m").join(counts.hint("merge"), "uid", "left").join(group.withColumnRenamed("node", "vec_id").hint("merge"), "vec_id", "left")
    of = of.select("digest", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "vec_id").alias("component"))
    mine = rows.select("vec_id", "uid", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    out = hot_join(mine, of.hint("merge"), "digest", "left", classes.select("digest", "m"))
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
