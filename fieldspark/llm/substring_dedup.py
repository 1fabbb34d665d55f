"""Substring dedup by relative Lempel-Ziv parsing against content-partitioned reference blocks.

Words are ``[^\\x20\\x09-\\x0D]+``. A phrase is ``n`` consecutive words of one document. Each phrase belongs to
the reference block that the smallest of its hashed 5-word seeds (its minimiser) names, so the block
that could hold a copy of a phrase is known, and parsing against it equals parsing against every block.
Neighbouring phrases mostly share the minimiser and travel as one run. Seeds that are frequent in a sample of
documents (2000, or one in a thousand; at most ``MAX_FREQUENT`` seeds) rank behind all others, so that a phrase
is rarely named by them; this deals the work evenly and changes no result.

1. Every task parses some MB of its documents against themselves: a phrase that starts in a smaller
   document of the chunk is covered at once; of phrases that repeat in the chunk only the first goes on. A task
   also remembers the repeated phrases of its earlier chunks with their smallest document. So a hot passage
   sends its blocks about one run of some 50 bytes for each task, not one for each copy.
2. A block indexes the phrases it got (sorted by hash, the smallest document first) and factors the runs
   greedily: a factor starts at a phrase that an earlier document holds and grows while the next phrase
   continues at the next word of the same source. Rows come sorted by block, and a worker holds one block.
3. Factors have ``n`` words at least. Where one ends inside a phrase of the next, across sources or
   blocks, the spans are checked at that boundary and merge; documents are joined with their spans.

A phrase is known by 64 hash bits of its words, compared only with phrases of its block whose minimisers agree in 16
further bits: a million phrases of one minimiser meet by chance with probability 3e-8. Arrays travel by bytes of
one rank (``planes``), so that the many zero bytes of small numbers cost nothing once compressed.

Defined results: null text has no words; a null ``doc_id`` is no source and loses nothing; rows with one
``doc_id`` are no sources for each other; an empty table gives no rows; of clashing columns in ``keep``
the operator's own win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, n_parts
from .words import buffers, chunks, firsts, mix, rolling, words

OUT = ("doc_id", "text", "n_words", "n_removed")
SEED_WORDS = 5
#: Documents whose seeds are counted, occurrences that make one frequent there, and seeds that are sent to tasks.
SAMPLE_DOCS, FREQUENT, MAX_FREQUENT = 2000, 10, 100_000
#: Repeated phrases that a task remembers from its earlier chunks.
REMEMBERED = 1 << 20
#: Bytes of text that one task parses against themselves at a time.
LOCAL_BYTES = 4 << 20
COLUMNS = ("ids", "print", "doc", "start", "size", "seed", "phrase")
ROW = "block int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, all lowest ones first."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def seeds_of(h: np.ndarray) -> np.ndarray:
    return rolling(h, SEED_WORDS, seed=5) >> np.uint64(1)


def minimisers(h: np.ndarray, n: int, frequent: np.ndarray) -> np.ndarray:
    """For every phrase of ``n`` words the smallest hash among its seeds; ``frequent`` ones (sorted) come last."""
    x = seeds_of(h)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x
        x = x | late.astype(np.uint64) << np.uint64(63)
    width, have = n - SEED_WORDS + 1, 1
    m = x
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def first_in_group(key: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the phrase with the smallest document among equal ones, and whether that is another document."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, s, d = key[order], seed[order], doc[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low = np.minimum.reduceat(d, at)
    # the first place of the smallest document of each group
    hit = np.flatnonzero(d == low[group])
    lead = hit[np.r_[True, group[hit][1:] != group[hit][:-1]]]
    source = np.empty(len(key), np.int64)
    source[order] = order[lead][group]
    return source, doc > doc[source]


def runs(*same: np.ndarray) -> np.ndarray:
    """First places of maximal runs in which all given arrays continue (differences of 0)."""
    new = np.zeros(max(0, len(same[0]) - 1), bool)
    for x in same:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.r_[True, new]) if len(same[0]) else np.zeros(0, np.int64)


class Known:
    """Repeated phrases of a task's earlier chunks, sorted by their hash, each with the smallest document."""

    def __init__(self):
        self.key, self.seed, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def covers(self, key: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(key), bool)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[i] == key) & (self.seed[i] == seed) & (self.doc[i] < doc)

    def add(self, key: np.ndarray, seed: np.ndarray, doc: np.ndarray) -> None:
        if len(self.key) + len(key) > REMEMBERED:
            self.__init__()
        key, seed, doc = (np.concatenate(p) for p in ((self.key, key), (self.seed, seed), (self.doc, doc)))
        order = np.lexsort((doc, seed, key))
        key, seed, doc = key[order], seed[order], doc[order]
        new = np.r_[True, (key[1:] != key[:-1])] if len(key) else np.zeros(0, bool)  # of keys with several seeds one stays
        self.key, self.seed, self.doc = key[new], seed[new], doc[new]


def _parse(n: int, blocks: int, frequent):
    """Rows of runs for the reference blocks, and rows of spans found at once (block -1 - …)."""
    schema = pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in COLUMNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            prints = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            data, offsets = buffers(batch.column(2))
            for a, b in chunks(offsets, LOCAL_BYTES):
                h, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(h) >= n:
                    yield pa.RecordBatch.from_pylist(list(_chunk(h, first, ids[a:b], prints[a:b], n, blocks, frequent.value, known)), schema=schema)

    return run


def _chunk(h: np.ndarray, first: np.ndarray, ids: np.ndarray, prints: np.ndarray, n: int, blocks: int, frequent: np.ndarray, known: Known) -> Iterator[dict]:
    at = np.flatnonzero(firsts(first, n))
    seed = minimisers(h, n, frequent)[at]
    word = rolling(h, n, seed=13)[at]
    doc = np.searchsorted(first, at, "right") - 1
    key = word ^ seed
    source, covered = first_in_group(key, seed, ids[doc])
    again = np.unique(source[covered])
    covered |= known.covers(key, seed, ids[doc])
    known.add(key[again], seed[again], ids[doc[again]])
    start = at - first[doc]
    # what is covered here, as spans of words
    c = np.flatnonzero(covered)
    lead = runs(doc[c], start[c] - np.arange(len(c)))
    if len(c):
        size = np.diff(np.r_[lead, len(c)]) + n - 1
        yield _row(-1, ids, prints, doc[c][lead], start[c][lead], size.astype(np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    # first of equal phrases go on; a phrase of a document's own repeats needs its own answer
    go = np.flatnonzero(~covered)
    seed, word, doc, start = seed[go], word[go], doc[go], start[go]
    lead = runs(doc, seed.view(np.int64), start - np.arange(len(go)))
    size = np.diff(np.r_[lead, len(go)])
    cut = np.flatnonzero(size > 60_000)
    if len(cut):  # sizes travel as 16 bits
        lead = np.unique(np.r_[lead, np.concatenate([np.arange(lead[k], lead[k] + size[k], 60_000) for k in cut])])
        size = np.diff(np.r_[lead, len(go)])
    block = (mix(seed[lead]) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        k = np.repeat(lead[own] - np.r_[0, np.cumsum(size[own])[:-1]], size[own]) + np.arange(size[own].sum())
        r = lead[own]
        yield _row(int(block[own[0]]), ids, prints, doc[r], start[r], size[own].astype(np.uint16), seed[r], word[k])


def _row(block: int, ids: np.ndarray, prints: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray, phrase: np.ndarray) -> dict:
    used, index = np.unique(doc, return_inverse=True)
    if block < 0:
        block = -1 - int(abs(int(prints[used[0]])) % 1_000_003)
    # of a block's runs documents come in order, so that mostly 0 or 1 lies between them
    arrays = ids[used], prints[used], np.diff(index, prepend=0).astype(np.uint32), start.astype(np.uint32), size
    return {"block": block, **dict(zip(COLUMNS, map(planes, arrays), strict=False)), "seed": seed.astype(np.uint16).tobytes(), "phrase": phrase.tobytes()}


FACTOR = pa.schema([("doc_id", pa.int64()), ("print", pa.int32()), ("spans", pa.binary())])
GROUPED = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("id", "print", "start", "size")]])


def _factor(n: int, groups: int):
    """Rows of spans, one for each group of documents, of what this partition's blocks cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ready, held = None, _empty(), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != at:
                    if parts["id"]:
                        ready.append(_parsed({k: np.concatenate(v) for k, v in parts.items()}, n))
                        held += len(ready[-1][0])
                        parts = _empty()
                    if held > SPANS:
                        yield from _spread(ready, groups)
                        ready, held = [], 0
                    at = row["block"]
                doc = np.cumsum(unplaned(row["doc"], np.uint32))
                ids, prints, start = unplaned(row["ids"], np.int64)[doc], unplaned(row["print"], np.int32)[doc], unplaned(row["start"], np.uint32)
                if row["block"] < 0:
                    ready.append((ids, prints, start.astype(np.int64), unplaned(row["size"], np.uint32).astype(np.int64)))
                    held += len(ids)
                    continue
                for k, v in (("id", ids), ("print", prints), ("start", start), ("size", unplaned(row["size"], np.uint16)), ("seed", np.frombuffer(row["seed"], np.uint16)), ("phrase", np.frombuffer(row["phrase"], np.uint64))):
                    parts[k].append(v)
        if parts["id"]:
            ready.append(_parsed({k: np.concatenate(v) for k, v in parts.items()}, n))
        if ready:
            yield from _spread(ready, groups)

    return run


#: Spans that a task holds before it sends them on.
SPANS = 1 << 20


def _empty() -> dict[str, list[np.ndarray]]:
    return {k: [] for k in ("id", "print", "start", "size", "seed", "phrase")}


def _spread(ready: list[tuple[np.ndarray, ...]], groups: int) -> Iterator[pa.RecordBatch]:
    found = [np.concatenate(c) for c in zip(*ready, strict=True)]
    part = (mix(found[0].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield pa.RecordBatch.from_arrays([pa.array([part[own[0]]], pa.int32()), *[pa.array([c[own].tobytes()], pa.binary()) for c in found]], schema=GROUPED)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with all spans (start, end as 32-bit word numbers) for each document of this partition."""
    parts = [[], [], [], []]
    for batch in batches:
        for k in range(4):
            parts[k] += [np.frombuffer(x.as_buffer(), np.int32 if k == 1 else np.int64) for x in batch.column(k + 1)]
    if parts[0]:
        yield from _spans(*(np.concatenate(p) for p in parts))


def _parsed(p: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """Factors (document, print, first word, words) of the runs against the index of all phrases here."""
    size = p["size"].astype(np.int64)
    run = np.repeat(np.arange(len(size)), size)
    start = p["start"].astype(np.int64)[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    doc = p["id"][run]
    source, covered = first_in_group(p["phrase"], p["seed"][run], doc)
    c = np.flatnonzero(covered)
    src = source[c]
    lead = runs(run[c], start[c] - np.arange(len(c)), doc[src], start[src] - np.arange(len(c)))
    words_in = np.diff(np.r_[lead, len(c)]) + n - 1
    at = c[lead]
    return doc[at], p["print"][run[at]], start[at], words_in


def _spans(ids: np.ndarray, prints: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((start, prints, ids))
    ids, prints = ids[order], prints[order]
    pairs = np.stack([start[order], start[order] + size[order]], 1).astype("<u4")
    lead = runs(ids, prints)
    ends = np.r_[lead[1:], len(ids)]
    for k in range(0, len(lead), 10_000):
        a, b = lead[k : k + 10_000], ends[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(prints[a]), pa.array([pairs[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())], schema=FACTOR)


def _kept(text: pa.Array, spans: pa.Array) -> pa.Array:
    texts, n_words, n_removed = [], [], []
    for t, found in zip(text, spans, strict=True):
        own = t.as_buffer().to_pybytes().split()  # at [\x20\x09-\x0D], as bytes
        stay = own
        if found.is_valid:
            edge = np.zeros(len(own) + 1, np.int64)
            pairs = np.frombuffer(found.as_buffer(), "<u4").reshape(-1, 2)
            np.add.at(edge, pairs[:, 0], 1)
            np.add.at(edge, pairs[:, 1], -1)
            stay = [own[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        texts.append(b" ".join(stay)), n_words.append(len(own)), n_removed.append(len(own) - len(stay))
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["text", "n_words", "n_removed"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds of sampled documents, once for each document."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for a, b in chunks(offsets, LOCAL_BYTES):
            h, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            found = [np.unique(seeds_of(h[first[k] : first[k + 1]])) for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["seed"])


def frequent_seeds(docs: DataFrame) -> np.ndarray:
    """The commonest seeds of a sample, sorted; at most MAX_FREQUENT."""
    n = docs.count()
    share = min(1.0, max(SAMPLE_DOCS, n // 1000) / max(n, 1))
    counted = docs.select("text").sample(share, seed=3).mapInArrow(_sampled, "seed long").groupBy("seed").agg(F.count("*").alias("m")).where(F.col("m") >= FREQUENT)
    rows = counted.orderBy(F.desc("m"), "seed").limit(MAX_FREQUENT).toArrow()
    return np.sort(rows["seed"].to_numpy().astype(np.int64)).view(np.uint64)


def factors(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, print, spans) for documents (doc_id, print, text): spans of words that earlier documents hold."""
    parts = n_parts(docs, 2 << 20)  # a block's index holds some 30 bytes for each byte that it receives
    blocks = max(2 * parts, min(n_parts(docs, 1 << 20), 64 * parts))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_seeds(docs))
    parsed = docs.mapInArrow(_parse(n, blocks, frequent), ROW)
    groups = n_parts(docs)
    # by number: hashed, some partitions would get several times as many blocks as others
    dealt = parsed.repartitionById(parts, F.pmod("block", F.lit(parts))).sortWithinPartitions("block")
    factored = dealt.mapInArrow(_factor(n, 4 * groups), "part int, id binary, print binary, start binary, size binary")
    return factored.repartitionById(groups, F.pmod("part", F.lit(groups))).mapInArrow(_gather, "doc_id long, print int, spans binary")


def dedup_substrings(docs: DataFrame, n: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (kept words joined by a space), n_words, n_removed and ``keep``.

    A word goes if some phrase of ``n`` words that covers it also starts in a document with a smaller id.
    """
    keep = tuple(c for c in keep if c not in OUT)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"), *keep).withColumn("__print", F.hash("text"))
    named = docs.where("doc_id is not null").select("doc_id", F.col("__print").alias("print"), "text")
    found = factors(named, n).select("doc_id", F.col("print").alias("__print"), F.col("spans").alias("__spans"))
    rebuilt = F.arrow_udf(_kept, "struct<text: string, n_words: long, n_removed: long>")
    out = docs.join(found, ["doc_id", "__print"], "left").withColumn("__new", rebuilt("text", "__spans"))
    return out.select("doc_id", *[F.col(f"__new.{c}").alias(c) for c in OUT[1:]], *keep)
