"""Best-fit packing of token sequences, planned on a histogram of lengths.

Documents become token ids and an end id; longer ones are cut into pieces of ``capacity`` tokens, the
first taking the remainder. The driver sees only how many pieces have each length (at most
``capacity`` numbers) and packs counts: best-fit decreasing, where a group of equal sequences is
treated as one entry with a multiplicity. Every plan row gives a run of ranks within one length its
sequence ids and offset. Pieces get a rank within their length from counts by (length, salt), so no
length has to fit one task, and take the slot by joining on length and rank.

Defined results: null text counts as empty (the end id alone); repeated rows and ids are packed each
for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import threading
import time
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, n_parts, release, stored

CAPACITY, END = 2048, 0
#: Chunks of text in each of the two generations whose ids a worker remembers, over all its tasks.
REMEMBERED = 700_000
#: Seconds without work after which a worker forgets them.
IDLE = 3
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, salt int"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as little-endian bytes, from a ``tokenizers`` byte-level vocabulary.

    Its pre-tokenizer never joins across a space between two non-blank characters: the pieces before
    and after are encoded alone, and the ids of pieces already seen are remembered. A text that holds one of
    the vocabulary's added tokens goes to the tokenizer as it is, which gives the token its own id.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lock, self.used = threading.Lock(), time.monotonic()
        threading.Thread(target=self._forget, daemon=True).start()
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[[*vocabulary.values()]] = [len(k) for k in vocabulary]  # a character stands for a byte

    def _forget(self) -> None:
        """Drops what is remembered once the worker has encoded nothing for a while: it may run other stages next."""
        while True:
            time.sleep(1)
            with self.lock:
                if self.known and time.monotonic() - self.used > IDLE:
                    self.known, self.older = {}, {}
                    release()

    def _learn(self, new: list[str]) -> None:
        """Chunks with a space before and no blank elsewhere at their ends are encoded in one go and told apart by size."""
        alone, joined = [], []
        for text in new:
            if (ids := self.older.get(text)) is not None:
                self.known[text] = ids
            elif len(text) > 1 and text[0] == " " and not text[1].isspace() and not text[-1].isspace():
                joined.append(text)
            else:
                alone.append(text)
        for a in range(0, len(joined), 4096):
            part = joined[a : a + 4096]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.sizes[ids])
            want = np.cumsum([len(t.encode()) for t in part])
            at = np.searchsorted(ends, want)
            if len(ends) != at[-1] + 1 or (ends[at] != want).any():
                alone += part
                continue
            raw, start = ids.tobytes(), 0
            for text, end in zip(part, (4 * at + 4).tolist(), strict=True):
                self.known[text] = raw[start:end]
                start = end
        for a in range(0, len(alone), 4096):
            part = alone[a : a + 4096]
            for text, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[text] = array("I", e.ids).tobytes()

    @staticmethod
    def _split(text: str) -> list[str]:
        parts = text.split(" ")
        if len(parts) < 2:
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if p == "" or p[0].isspace() or out[-1] == "" or out[-1][-1].isspace():
                out[-1] += " " + p
            else:
                out.append(" " + p)
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Texts are handled in groups of some MB, so that the memory is bounded."""
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= 2_000_000):
                size += len(texts[b])
                b += 1
            with self.lock:
                done = self._group(texts[a:b])
                self.used = time.monotonic()
            yield from done
            a = b

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        split, whole = [], {}
        for k, t in enumerate(texts):
            if self.added.search(t):
                whole[k] = array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
                split.append([])
                continue
            # quick way for the usual text: no blank stands beside a space
            parts = t.replace(" ", "\0 ").split("\0") if "\0" not in t and not _beside(t) else self._split(t)
            split.append(parts)
        self._learn([*set(chain.from_iterable(split)).difference(self.known)])
        return [whole[k] if k in whole else b"".join(map(self.known.__getitem__, parts)) for k, parts in enumerate(split)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _beside(text: str) -> bool:
    """True if some blank may stand beside a space, or a space at an end."""
    if text[:1].isspace() or text[-1:].isspace() or "  " in text or not text:
        return True
    return any(f" {c}" in text or f"{c} " in text for c in _BLANKS if c in text)


#: Other characters that ``\\s`` matches.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")


def _pieces(path: str, capacity: int, end: int, salts: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = encoder_of(path), np.asarray([end], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
            held = 0
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += last
                n = len(ids) // 4
                a, b, k = 0, n % capacity or capacity, 0
                while a < n:
                    own = ids[4 * a : 4 * b]
                    crc = zlib.crc32(own)
                    out["doc_id"].append(doc), out["piece"].append(k), out["start"].append(a), out["length"].append(b - a)
                    out["ids_crc32"].append(crc), out["ids"].append(own if with_ids else None)
                    out["salt"].append((crc * 2654435761 + (doc or 0) * 40503 + k >> 7) % salts)
                    a, b, k = b, b + capacity, k + 1
                held += len(ids)
                if held > 16 << 20:
                    yield _batch(out)
                    held, out = 0, {k: [] for k in out}
            yield _batch(out)

    return run


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, kinds[t]) for n, t in (x.split() for x in PIECES.split(", "))]))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, first sequence, offset).

    Sequences that are filled alike form a group with a multiplicity. A length goes into the fullest
    groups that have room, as many of it to each sequence as fit; what is left opens a new group.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room -> groups (first sequence, sequences)
    rooms: list[int] = []
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[i]
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            full, rest = divmod(min(left, n * each), each)
            for k in range(each):
                if full:
                    rows.append((length, rank + k * full, full, first, capacity - room + k * length))
            rank += full * each
            for k in range(rest):
                rows.append((length, rank + k, 1, first + full, capacity - room + k * length))
            rank += rest
            left -= full * each + rest
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
    return rows


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of documents, one row each, with their ids if asked for."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"))
    return docs.mapInArrow(_pieces(path or tokenizer_file(), capacity, end, n_parts(docs), with_ids), PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    own = stored(pieces(docs, path, capacity, end, with_ids), "pieces")
    counts = own.groupBy("length", "salt").agg(F.count("*").alias("n"))
    placed = place(spark, own, counts, capacity)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"), *["ids"] * with_ids)


def place(spark: SparkSession, own: DataFrame, counts: DataFrame, capacity: int) -> DataFrame:
    """Joins pieces to planned slots on their rank within their length."""
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = np.array(plan(histogram, capacity) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    sent = spark.sparkContext.broadcast(rows)
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = own.withColumn("__at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("__rank", F.col("base") + F.col("__at"))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def slot(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows = sent.value
        n, r = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        width = np.int64(1) << 48
        i = np.searchsorted(rows[:, 0] * width + rows[:, 1], n * width + r, "right") - 1
        return pa.StructArray.from_arrays([pa.array(rows[i, 3] + r - rows[i, 1]), pa.array(rows[i, 4])], names=["sequence_id", "offset"])

    out = ranked.withColumn("__slot", slot("length", "__rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", F.col("__slot.sequence_id").alias("sequence_id"), F.col("__slot.offset").alias("offset"))
