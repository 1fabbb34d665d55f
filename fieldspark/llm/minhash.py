"""MinHash near-dedup with circulant signatures.

A document's set holds its distinct shingles of ``n`` words (split at ``[\\x20\\x09-\\x0D]``, A-Z lowered); with
fewer words the whole sequence is the only one. Two permutations give all coordinates: the first
scatters shingles over a universe of 2^20 places, the second is a table whose k-th circular shift gives
coordinate k. The shifts of one place are neighbours in the doubled table, so a shingle adds one
contiguous slice, and the signature is the minimum over slices.

1. Equal sets are one class, represented by its smallest ``doc_id``; only representatives go on. Rows take
   their class by its digest; the rows of a very large class, bucket or pivot are dealt to parts.
2. Bands of the signature give buckets. Each member is checked against the smallest and the largest id of
   its bucket, on full sets: 100 * intersection >= percent * union, so pairs grow with members only.
3. Components of the confirmed links are formed. Buckets that still hold several components are searched
   across components in blocks of members: counts of shingles by hashed cell bound the intersection from
   above (the sum of smaller counts), and what the bound cannot exclude is checked on full sets: first the
   best partner of each member in every other component, then, after these links have joined components,
   all that is left. So no candidate is left out, no pair of a bucket is a row before the bound has passed
   it, and members of one component need no more checks.

At Jaccard 0.8 a pair misses all buckets with probability (1 - 0.8^6)^48 = 5e-7.

Defined results: null, empty and blank texts have an empty set and link with nothing; a null ``doc_id``
is returned with a null component and links with nothing; rows with one ``doc_id`` share a component, whatever their
texts, and what links with any of these texts belongs to it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, discard, filled, hot_join, n_parts, release, stored
from .components import components
from .words import buffers, chunks, mix, rolling, words

UNIVERSE_BITS, ROWS, BANDS = 20, 6, 48
COORDINATES = ROWS * BANDS
#: Members that meet one pivot in one group of a task, and members in a block.
GROUP = 512
CELLS = 256
#: A list of meetings up to this size is sent to all tasks.
SENT_BYTES = 32 << 20

_table: list[np.ndarray] = []


def slices() -> np.ndarray:
    """Row x: the second permutation at x, x + 1, … in the circle, one for each coordinate."""
    if not _table:
        p = np.random.default_rng(77).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _table.append(np.lib.stride_tricks.sliding_window_view(np.r_[p, p[: COORDINATES - 1]], COORDINATES))
    return _table[0]


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets, CHUNK_BYTES):
        part = data[offsets[a] : offsets[b]]
        h, first = words(part, offsets[a : b + 1] - offsets[a], lower=True)
        rolled = rolling(h, n, seed=11)
        for k in range(b - a):
            lo, hi = int(first[k]), int(first[k + 1])
            if hi - lo >= n:
                yield np.unique(rolled[lo : hi - n + 1])
            elif hi > lo:
                yield rolling(h[lo:hi], hi - lo, seed=100 + hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """Band hashes of a set's circulant signature."""
    table = slices()
    places = np.unique(mix(own ^ np.uint64(0x5BF03635)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(places), 2048):
        np.minimum(low, table[places[a : a + 2048]].min(axis=0), out=low)
    x = low.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        out = mix(out + x[:, j])
    return out


def cells(own: np.ndarray) -> bytes:
    """Shingles in each hashed cell as bytes, about one or two to a cell; a cell of 255 may hold more."""
    n = CELLS
    while n < 4 * CELLS and n < len(own) // 2:
        n *= 2
    return np.minimum(np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def _signed(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            sizes, digests, bands, counts = [], [], [], []
            for own in shingle_sets(batch.column(1), n):
                d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if d not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[d] = signature(own).view(np.int64).tolist() if len(own) else []
                sizes.append(len(own)), digests.append(d), bands.append(known[d]), counts.append(cells(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(counts, pa.binary())], schema=schema)
        known.clear()
        release()

    return run


def _sets(n: int):
    """Rows (pivot, part, member, is_member, own): a set for each meeting of its document."""
    schema = pa.schema([("pivot", pa.int64()), ("part", pa.int32()), ("member", pa.int64()), ("is_member", pa.bool_()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, own, meets in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), batch.column(2).to_pylist(), strict=True):
                raw = own.tobytes()
                for m in meets:
                    rows.append((m["pivot"], m["part"], doc, m["is_member"], raw))
                    size += len(raw)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _confirm(percent: int):
    """Links (a, b) among rows sorted by pivot, part, is_member: a pivot's set comes before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            pivot, part, member, is_member = (batch.column(k).to_pylist() for k in range(4))
            for k, raw in enumerate(batch.column(4)):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if not is_member[k]:
                    at, base = (pivot[k], part[k]), own.copy()
                elif at == (pivot[k], part[k]):
                    small, large = (own, base) if len(own) < len(base) else (base, own)
                    i = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[i] == small).sum()) if len(large) else 0
                    if both and 100 * both >= percent * (len(own) + len(base) - both):
                        a.append(member[k]), b.append(pivot[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (member, pivot) those whose full sets are similar enough; a hot pivot is split into parts."""
    counts = pairs.groupBy("pivot").agg(F.count("*").alias("m"))
    of = counts.select("pivot", F.ceil(F.col("m") / GROUP).cast("int").alias("parts"))
    dealt = hot_join(pairs, of, "pivot", counts=counts).select("pivot", F.pmod(F.hash("member"), F.col("parts")).alias("part"), F.col("member").alias("doc_id"), F.lit(True).alias("is_member"))
    # the pivot itself goes to every part, also to such that the hash leaves empty
    heads = of.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("doc_id"), F.lit(False).alias("is_member"))
    meets = stored(dealt.unionByName(heads).groupBy("doc_id").agg(F.collect_list(F.struct("pivot", "part", "is_member")).alias("meets")), "meets")
    # few documents meet others: up to a bounded size their list goes to the texts, beyond it both are shuffled
    small = (meets.agg(F.sum(F.lit(16) + F.size("meets") * 40)).first()[0] or 0) <= SENT_BYTES
    sets = docs.join(F.broadcast(meets) if small else meets, "doc_id").select("doc_id", "text", "meets").mapInArrow(_sets(n), "pivot long, part int, member long, is_member boolean, own binary")
    sets = sets.repartition(n_parts(docs), "pivot", "part").sortWithinPartitions("pivot", "part", "is_member")
    links = stored(sets.mapInArrow(_confirm(percent), "a long, b long"), "links")
    discard(meets)
    return links


def _fits(percent: int, x: str, y: str) -> str:
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def _bounded(percent: int, best: bool):
    """Pairs across components in each run of equal (key, i, j) that the bound does not exclude.

    best: only the partner with the highest bound for each member and component.
    """

    def fold(raw: list[bytes]) -> np.ndarray:
        return np.stack([np.frombuffer(r, np.uint8) for r in raw])

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        minor, all_ = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        sizes = {len(r[4]) for r in all_}
        for cells_x in {len(r[4]) for r in minor}:
            xs = [r for r in minor if len(r[4]) == cells_x]
            for cells_y in sizes:
                ys = [r for r in all_ if len(r[4]) == cells_y]
                k = min(cells_x, cells_y)
                x = fold([r[4] for r in xs]).reshape(len(xs), -1, k)
                y = fold([r[4] for r in ys]).reshape(len(ys), -1, k)
                full_x, full_y = (x == 255).any((1, 2)), (y == 255).any((1, 2))
                x, y = x.sum(1, dtype=np.uint16), y.sum(1, dtype=np.uint16)
                ny, cy, ry = (np.array([r[c] for r in ys]) for c in (2, 3, 1))
                for q, (_, rx, nx, cx, _) in enumerate(xs):
                    both = np.minimum(x[q], y).sum(1, dtype=np.int64)
                    both = np.where(full_y | full_x[q], np.minimum(nx, ny), np.minimum(both, np.minimum(nx, ny)))
                    ok = np.flatnonzero((cy != cx) & (100 * both >= percent * (nx + ny - both)))
                    if best and len(ok):
                        order = ok[np.lexsort((-both[ok] / (nx + ny[ok]), cy[ok]))]
                        ok = order[np.r_[True, cy[order][1:] != cy[order][:-1]]]
                    for r in ry[ok].tolist():
                        yield max(rx, r), min(rx, r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            if rows and (got := [*set(solve(rows))]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["member", "pivot"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for head, row in zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True):
                if head != at:
                    yield from ended()
                    at, rows = head, []
                rows.append(row)
        yield from ended()

    return run


def across(shared: DataFrame, cells_of: DataFrame, found: DataFrame, tested: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs that share a bucket but no component yet and may be similar enough.

    In a bucket, members outside its largest component meet all members, in blocks of GROUP by GROUP: a bucket
    of m members, c of them in its largest component, costs m * (m - c) comparisons of counts (no rows), in as
    many units of work as it has pairs of blocks. Members are different sets that agree on six coordinates, so
    a bucket with many and hardly any link between them is a chance that falls with the sixth power of their
    similarity.
    """
    now = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    by = now.groupBy("key", "c").agg(F.count("*").alias("m"))
    of = by.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("m"), F.max("m").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    of = of.select("key", "main", "m", F.ceil(F.col("m") / GROUP).cast("int").alias("ys"), F.ceil((F.col("m") - F.col("most")) / GROUP).cast("int").alias("xs"))
    of = stored(of, "open")
    open_ = hot_join(now, of.drop("m"), "key", counts=of.select("key", "m"))
    hit = lambda m: F.pmod(F.xxhash64("rep"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    x = open_.where("c <> main").select("key", hit("xs").alias("i"), every("ys").alias("j"), F.lit(True).alias("minor"), "rep", "n", "c")
    y = open_.select("key", every("xs").alias("i"), hit("ys").alias("j"), F.lit(False).alias("minor"), "rep", "n", "c")
    work = x.union(y).join(cells_of, "rep").select("key", "i", "j", "minor", "rep", "n", "c", "cells")
    work = work.repartition(n_parts(cells_of), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return work.mapInArrow(_bounded(percent, best), "member long, pivot long").distinct().join(tested, ["member", "pivot"], "left_anti")


def _of_several(docs: DataFrame, several: DataFrame, n: int, percent: int) -> DataFrame:
    """Near duplicates where some ids have several sets: each such text gets a number of its own, beyond all ids.

    Components then join where texts have one id, and take the smallest id of their texts.
    """
    docs = docs.withColumn("text_id", F.unhex(F.sha2("text", 256)))
    top = docs.agg(F.max("doc_id")).first()[0]
    own = docs.select("doc_id", "text_id").join(several, "doc_id", "left_semi").distinct()
    own = stored(own.withColumn("number", F.lit(top) + 1 + F.monotonically_increasing_id()), "numbers")
    plain = docs.join(several, "doc_id", "left_anti").select("doc_id", "text")
    found = stored(near_duplicates(plain.union(docs.join(own, ["doc_id", "text_id"]).select(F.col("number").alias("doc_id"), "text")), n, percent), "found")
    of_id = stored(found.where("n_shingles > 0").join(own, found.doc_id == own.number).select(own.doc_id.alias("id"), F.col("component_id").alias("node")).distinct(), "several")
    edges = of_id.join(of_id.groupBy("id").agg(F.min("node").alias("low")), "id").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    joined = stored(components(edges), "joined")
    nodes = of_id.join(joined, "node", "left").select("id", "node", F.coalesce("component", "node").alias("component"))
    least = nodes.groupBy("component").agg(F.min("id").alias("least"))
    least = least.select("component", F.when(F.col("component") <= top, F.least("least", "component")).otherwise(F.col("least")).alias("least"))
    final = nodes.select("node", "component").distinct().join(least, "component").select(F.col("node").alias("component_id"), "least")
    out = hot_join(hot_join(found.drop("kept"), final, "component_id", "left"), own.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id", "left")
    doc = F.coalesce("id", "doc_id")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "component_id")).otherwise(doc)
    return out.select(doc.alias("doc_id"), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, n: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, one row per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"))
    signed = stored(docs.mapInArrow(_signed(n), "doc_id long, n_shingles long, digest binary, bands array<long>, cells binary"), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    several = stored(real.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id"), "several")
    if not several.isEmpty():
        discard(signed)
        return _of_several(docs, several, n, percent)
    reps = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    entries = reps.select("rep", "n", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("low"), F.max(F.struct("rep", "n")).alias("high"), F.count("*").alias("m")).where("m > 1")
    buckets = stored(buckets, "buckets")
    shared = stored(hot_join(entries, buckets.drop("m"), "key", counts=buckets.select("key", "m")).select("key", "rep", "n", "low", "high"), "shared")
    discard(buckets)
    star = [shared.where(f"rep <> {p}.rep and {_fits(percent, 'n', f'{p}.n')}").select(F.greatest("rep", f"{p}.rep").alias("member"), F.least("rep", f"{p}.rep").alias("pivot")) for p in ("low", "high")]
    tested = stored(star[0].union(star[1]).distinct(), "tested")
    links, spent = confirmed(docs, tested, n, percent), [shared, tested]
    found = stored(components(links), "components")
    cells_of = real.groupBy("doc_id").agg(F.first("cells").alias("cells")).withColumnRenamed("doc_id", "rep")
    for best in (True, False):
        more = stored(across(shared.select("key", "rep", "n"), cells_of, found, tested, percent, best), "more")
        if more.isEmpty():
            continue
        tested = tested.unionByName(more)
        spent.append(more)
        new = confirmed(docs, more, n, percent)
        if not new.isEmpty():
            links = links.unionByName(new)
            found = stored(components(links), "components")
    for table in spent:
        discard(table)
    classes = reps.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rep", F.coalesce("component", "rep").alias("component_id"))
    out = hot_join(signed.select("doc_id", "n_shingles", "digest"), classes, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
