"""Line dedup with a pair of Bloom filters.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lowered. Keys of
at least ``min_chars`` code points that occur in two or more documents lose their lines everywhere
but in the smallest ``doc_id``.

1. *Filters.* Every task hashes the keys of its documents (once per document) and sends set bits,
   grouped by filter block. A block's owner merges them: ``once`` collects bits seen, ``twice``
   those that two tasks, or two documents of one task, have set. Only bit positions travel.
2. *Suspects.* A line is suspected if all its bits stand in ``twice``. Line hashes with their documents, grouped
   by block, go to the owner of the block, who reads its filter once and then the hashes, and lets suspects
   pass. Lines that repeat inside one batch are suspects at once and do not ask, so a hot line sends one hash
   a batch to its block. No filter is sent to all tasks: the way is the same at every size.
3. *Confirmation.* Only suspects shuffle: smallest and largest ``doc_id`` by key (known by 128 bits of BLAKE2b),
   combined before the shuffle; a key whose two differ is a true repeat. Documents of a hot key are dealt to parts.
4. Documents are joined with the keys they lose and rebuilt.

Defined results: null text counts as one empty line; a null ``doc_id`` neither loses lines nor makes
others lose them; rows with one ``doc_id`` are the same document, so they do not make each other lose
lines; an empty table gives no rows. Of clashing columns in ``keep`` the operator's own win.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, filled, hot_join, n_parts, stored

BLANK = b" \t\n\x0b\x0c\r"
#: 2 ** 16 bits a block, so that positions fit 16 bits; 16 bits a line and 4 hash functions.
BLOCK_BITS, BITS_A_LINE, N_HASHES = 1 << 16, 16, 4
OUT = ("doc_id", "text", "n_lines", "n_dropped")


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line; None where it is too short to count. Only A-Z change in ``bytes.lower``."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK)
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(key.lower())
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _places(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bit positions (n x N_HASHES) of 128-bit digests given as two words each."""
    block = (h[:, 0] % np.uint64(n_blocks)).astype(np.int64)
    shifts = np.arange(N_HASHES, dtype=np.uint64) * np.uint64(16)
    return block, ((h[:, 1][:, None] >> shifts) & np.uint64(0xFFFF)).astype(np.uint16)


def _digests(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """doc_ids and digests (two words each) of the distinct keys of each document of a batch."""
    for batch in batches:
        prints, n = [], []
        for text in batch.column(1):
            own = {k for k in line_keys(text.as_buffer().to_pybytes(), min_chars) if k}
            prints += [digest(k) for k in own]
            n.append(len(own))
        yield np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), n), np.frombuffer(b"".join(prints), np.uint64).reshape(-1, 2)


def _grouped(block: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    parts = [np.split(v[order], cuts) for v in values]
    for i, b in enumerate(block[np.r_[0, cuts]] if len(block) else ()):
        yield int(b), [p[i] for p in parts]


def _insert(min_chars: int, n_blocks: int):
    """Rows (block, once, twice): positions of bits that one task sets, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for _, h in _digests(batches, min_chars):
            seen.append(h)
            held += h.nbytes
            if held > 32 << 20:
                yield from _bits(seen, n_blocks)
                seen, held = [], 0
        yield from _bits(seen, n_blocks)

    return run


def _bits(seen: list[np.ndarray], n_blocks: int) -> Iterator[pa.RecordBatch]:
    h = np.concatenate(seen) if seen else np.zeros((0, 2), np.uint64)
    if not len(h):
        return
    h = h[np.lexsort((h[:, 1], h[:, 0]))]
    new = np.r_[True, (h[1:] != h[:-1]).any(1)]
    count = np.diff(np.r_[np.flatnonzero(new), len(h)])
    block, bits = _places(h[new], n_blocks)
    rows: dict[str, list] = {"block": [], "once": [], "twice": []}
    for b, (own, n) in _grouped(block, bits, count):
        flat = own.ravel()
        once, times = np.unique(flat, return_counts=True)
        rows["block"].append(b)
        rows["once"].append(once.tobytes())
        rows["twice"].append(np.union1d(once[times > 1], np.unique(own[n > 1].ravel())).astype(np.uint16).tobytes())
    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Once- and twice-seen bits of each block of this partition; only the latter go on."""
    filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for b, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b not in filters:
                filters[b] = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
            o, t = filters[b]
            at = np.frombuffer(once, np.uint16)
            t[at] |= o[at]
            t[np.frombuffer(twice, np.uint16)] = True
            o[at] = True
    names = [*filters]
    for k in range(0, len(names), 256):
        some = names[k : k + 256]
        yield pa.RecordBatch.from_pydict({"block": some, "bits": [np.packbits(filters[b][1], bitorder="little").tobytes() for b in some]}, schema=pa.schema([("block", pa.int32()), ("bits", pa.binary())]))


def _hit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """bits: packed; at: n x N_HASHES positions in them."""
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


QUESTION = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("data", pa.binary())])
SUSPECT = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])


def _questions(min_chars: int, n_blocks: int):
    """Rows of documents and line hashes: for each block those to be asked (kind 1), and those that repeat here (block < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, h in _digests(batches, min_chars):
            if not len(h):
                continue
            order = np.lexsort((h[:, 1], h[:, 0]))
            h, docs = h[order], docs[order]
            at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(1)])
            again = np.repeat(np.diff(np.r_[at, len(h)]) > 1, np.diff(np.r_[at, len(h)]))
            rows = [(-1 - int(h[0, 0] % np.uint64(1_000_003)), 1, docs[again].tobytes(), h[again].tobytes())] if again.any() else []
            h, docs = h[~again], docs[~again]
            rows += [(b, 1, d.tobytes(), x.tobytes()) for b, (d, x) in _grouped(_places(h, n_blocks)[0], docs, h)] if len(h) else []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), QUESTION, strict=True)], schema=QUESTION)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suspects among rows sorted by block and kind: a block's filter (kind 0) comes before its line hashes."""
    at, bits = None, np.zeros(0, np.uint8)
    for batch in batches:
        ids, prints, held = [], [], 0
        for block, kind, docs, data in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), batch.column(3), strict=True):
            if kind == 0:
                at, bits = block, np.frombuffer(data.as_py(), np.uint8)
                continue
            own, h = np.frombuffer(docs.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.uint64).reshape(-1, 2)
            if block >= 0:
                if at != block:
                    continue  # no bit of this block is set twice
                ok = _hit(bits, _places(h, 1)[1].astype(np.int64))
                own, h = own[ok], h[ok]
            ids.append(own), prints.append(h)
            held += h.nbytes
            if held > 8 << 20:
                yield _suspected(ids, prints)
                ids, prints, held = [], [], 0
        if ids:
            yield _suspected(ids, prints)


def _suspected(ids: list[np.ndarray], prints: list[np.ndarray]) -> pa.RecordBatch:
    raw = np.concatenate(prints).tobytes()
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array([raw[k : k + 16] for k in range(0, len(raw), 16)], pa.binary())], schema=SUSPECT)


def suspects(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, fp) of every line whose key the filters take for repeated; few others are among them."""
    n_lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    n_blocks = max(8, -(-n_lines * BITS_A_LINE // BLOCK_BITS))
    parts = n_parts(docs, 64 << 20)
    filters = docs.mapInArrow(_insert(min_chars, n_blocks), "block int, once binary, twice binary").repartition(parts, "block").mapInArrow(_merge, "block int, bits binary")
    asked = docs.mapInArrow(_questions(min_chars, n_blocks), "block int, kind int, docs binary, data binary")
    both = asked.union(filters.select("block", F.lit(0).alias("kind"), F.lit(b"").alias("docs"), F.col("bits").alias("data")))
    return both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(_answer, "doc_id long, fp binary")


def _rebuild(min_chars: int):
    @F.arrow_udf("struct<text: string, n_lines: long, n_dropped: long>")
    def rebuild(text: pa.Array, fps: pa.Array) -> pa.Array:
        texts, n_lines, n_dropped = [], [], []
        for t, lose in zip(text, fps, strict=True):
            raw = t.as_buffer().to_pybytes()
            if not lose.is_valid:
                texts.append(raw), n_lines.append(raw.count(b"\n") + 1), n_dropped.append(0)
                continue
            lost, lines = set(lose.as_py()), raw.split(b"\n")
            stay = [line for line, key in zip(lines, line_keys(raw, min_chars), strict=True) if key is None or digest(key) not in lost]
            texts.append(b"\n".join(stay)), n_lines.append(len(lines)), n_dropped.append(len(lines) - len(stay))
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])

    return rebuild


def dedup_lines(docs: DataFrame, min_chars: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents without their repeated lines: doc_id, text, n_lines (before), n_dropped and ``keep``."""
    keep = tuple(c for c in keep if c not in OUT)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"), *keep)
    named = docs.select("doc_id", "text").where("doc_id is not null")
    found = stored(suspects(named, min_chars), "suspects")
    true = found.groupBy("fp").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("m")).where("keeper < last")
    true = stored(true.select("fp", "keeper", "m"), "repeats")
    lost = cut(hot_join(found, true.select("fp", "keeper"), "fp", counts=true).where("doc_id > keeper").groupBy("doc_id").agg(F.collect_set("fp").alias("__fps")))
    discard(found), discard(true)
    out = docs.join(lost, "doc_id", "left").withColumn("__new", _rebuild(min_chars)("text", "__fps"))
    return out.select("doc_id", F.col("__new.text").alias("text"), F.col("__new.n_lines").alias("n_lines"), F.col("__new.n_dropped").alias("n_dropped"), *keep)
