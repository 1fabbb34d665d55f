"""Benchmark decontamination with an FM-index per shard of training text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z. A phrase is ``n`` consecutive words of
a benchmark item, or the whole item if it has fewer. Every shard (some MB of documents of one task)
is turned into a string of symbols: words that no phrase contains, and runs of known words too short
for any phrase, cannot take part in an occurrence and shrink to one separator. Its suffix array gives
the Burrows-Wheeler transform, held as a wavelet matrix with rank counts. All phrases are searched
backwards together, one word a step; the rows found are followed to the nearest sampled suffix
position; the occurrences merge into spans of words to remove.

The benchmark's size is taken first. One of up to ``block_bytes`` of text goes to the tasks as one block and
nothing is shuffled. A larger one is dealt to blocks of about that size by a hash, and each block makes a pass of
its own over the documents: driver and workers hold one block at a time. The spans that the passes find are
stored, gathered by document and merged.

Defined results: null texts and texts without words have no words and no hits; items without words
give no phrase; an item with a null id has phrases that hit, but is not among the items found; rows with one id are each treated alone; empty tables give no rows or no hits; of
clashing columns in ``keep`` the operator's own win.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, filled, release, stored
from .words import LOWER, NOT_ALNUM, buffers, chunks, hashes, spans

OUT = ("doc_id", "text", "n_words", "n_hit", "items", "spans")
SAMPLE = 8


class Phrases:
    """Distinct phrases of some items as words of the alphabet 2..: 1 is the separator, 0 the end."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        column = pa.array([t for _, t in items], pa.large_string())
        data, offsets = buffers(column)
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, NOT_ALNUM)
        self.vocabulary, word = np.unique(hashes(data, starts, ends), return_inverse=True)
        word = word + 2
        own: dict[tuple[int, ...], list[str]] = {}
        for k, (item, _) in enumerate(items):
            w = word[first[k] : first[k + 1]].tolist()
            for p in {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} - {()}:
                own.setdefault(p, [])
                if item is not None:
                    own[p].append(item)
        self.phrases = [np.array(p) for p in own]
        self.items = [sorted(v) for v in own.values()]
        self.shortest = min((len(p) for p in own), default=0)
        self.n = n


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit level at a time, most significant first."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, bit, ones, len(s) - int(ones[-1])))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i of the sequence."""
        lo = np.zeros_like(i)
        for b, _, ones, zeros in self.levels:
            one = (symbol >> b & 1).astype(bool)
            a, z = ones[lo], ones[i]
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + z, i - z)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for b, bit, ones, zeros in self.levels:
            one = bit[i]
            out |= one.astype(i.dtype) << b
            i = np.where(one, zeros + ones[i], i - ones[i])
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol is smaller than all others."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(s)
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Backward search in, and positions of, a symbol string that ends with its only 0."""

    def __init__(self, s: np.ndarray, symbols: int, sample: int = SAMPLE):
        sa = suffix_array(s)
        bits = max(1, (symbols - 1).bit_length())
        self.n = len(s)
        self.wavelet = WaveletMatrix(s[sa - 1], bits)
        self.before = np.r_[0, np.cumsum(np.bincount(s, minlength=1 << bits))]
        self.sampled = sa % sample == 0
        self.sample_rank = np.r_[0, np.cumsum(self.sampled)]
        self.samples = sa[self.sampled]

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, i)

    def ranges(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that start with each phrase; all are searched together."""
        size = np.array([len(p) for p in phrases])
        table = np.zeros((len(phrases), size.max()), np.int64)
        for k, p in enumerate(phrases):
            table[k, : len(p)] = p[::-1]
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(table.shape[1]):
            live = live[(lo[live] < hi[live])]
            now = live[size[live] > j]
            if not len(now):
                break
            both = self.step(np.tile(table[now, j], 2), np.r_[lo[now], hi[now]])
            lo[now], hi[now] = both[: len(now)], both[len(now) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by steps back to a sampled one."""
        out, steps, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[at[todo]]
            ready = todo[done]
            out[ready] = self.samples[self.sample_rank[at[ready]]] + steps[ready]
            todo = todo[~done]
            at[todo] = self.step(self.wavelet.access(at[todo]), at[todo])
            steps[todo] += 1
        return out


def _symbols(h: np.ndarray, first: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """The shard's string and, for each of its symbols, the word it stands for (-1: none)."""
    if not len(p.vocabulary) or not len(h):
        return np.zeros(1, np.int64), np.full(1, -1)
    i = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    word = np.where(p.vocabulary[i] == h, i + 2, 1)
    known = word > 1
    # runs of known words inside one text
    new = known.copy()
    new[1:] &= ~known[:-1]
    at = first[:-1][first[:-1] < len(h)]
    new[at] = known[at]
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.bincount(run[known], minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    keep = known & (size >= p.shortest)[np.maximum(run, 0)] if len(starts) else known
    where = np.flatnonzero(keep)
    gaps = np.flatnonzero(np.r_[True, run[where][1:] != run[where][:-1]]) if len(where) else np.zeros(0, np.int64)
    return np.r_[np.insert(word[where], gaps, 1), 1, 0], np.r_[np.insert(where, gaps, -1), -1, -1]


def occurrences(h: np.ndarray, first: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and first word of every occurrence of a phrase in the texts of a shard."""
    s, where = _symbols(h, first, p)
    if len(s) < 4 or not p.phrases:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(s, len(p.vocabulary) + 2)
    lo, hi = index.ranges(p.phrases)
    n = hi - lo
    phrase = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return phrase, where[index.locate(rows)]


RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("text", pa.string())])
DDL = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<start: int, end: int>>, text: string>"


def _shard(column: pa.Array, blocks: list[Phrases]) -> pa.Array:
    """The result for the texts of one shard; spans are byte ranges in the text."""
    data, offsets = buffers(column)
    lowered = LOWER[data]
    starts, ends, first = spans(lowered, offsets, NOT_ALNUM)
    h = hashes(lowered, starts, ends)
    hit = np.zeros(len(h) + 1, np.int64)
    doc_of = lambda w: np.searchsorted(first, w, "right") - 1
    items: dict[int, set[str]] = {}
    for p in blocks:
        phrase, at = occurrences(h, first, p)
        if len(at):
            size = np.array([len(x) for x in p.phrases])[phrase]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + size, -1)
            for d, k in set(zip(doc_of(at).tolist(), phrase.tolist(), strict=True)):
                items.setdefault(d, set()).update(p.items[k])
    covered = np.cumsum(hit)[:-1] > 0
    total = np.r_[0, np.cumsum(covered)]
    n_hit = total[first[1:]] - total[first[:-1]]
    out_spans: list[list[dict]] = [[] for _ in range(len(column))]
    texts = column
    if items:
        raw, new = data.tobytes(), {}
        for d in items:
            a, b, base = first[d], first[d + 1], offsets[d]
            inside = np.r_[False, covered[a:b], False]
            edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2) + a
            own = [(int(starts[x] - base), int(ends[y - 1] - base)) for x, y in edges]
            out_spans[d] = [{"start": x, "end": y} for x, y in own]
            text, parts, last = raw[base : offsets[d + 1]], [], 0
            for x, y in own:
                parts.append(text[last:x])
                last = y
            new[d] = b"\n".join([*parts, text[last:]]).decode("utf-8", "replace")
        texts = pa.array([new.get(k, x) if k in new else x for k, x in enumerate(column.to_pylist())], pa.string())
    lists = pa.array([sorted(items.get(k, ())) for k in range(len(column))], pa.list_(pa.string()))
    return pa.StructArray.from_arrays([pa.array(np.diff(first).astype(np.int64)), pa.array(n_hit.astype(np.int64)), lists, pa.array(out_spans, RESULT.field("spans").type), texts.cast(pa.string())], fields=list(RESULT))


def _search(block, n: int):
    @F.arrow_udf(DDL)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packed = [Phrases(block.value, n)]
        for column in texts:
            if not len(column):
                yield pa.array([], RESULT)
                continue
            column = column.fill_null("") if column.null_count else column
            _, offsets = buffers(column)
            yield pa.concat_arrays([_shard(column.slice(a, b - a), packed) for a, b in chunks(offsets, 2 * CHUNK_BYTES)])
        release()

    return search


def _merged(text: pa.Array, found: pa.Array, names: pa.Array) -> pa.Array:
    """The result for texts with the byte spans that several passes found (null: none) and their items."""
    out = []
    for t, spans_, own in zip(text, found.to_pylist(), names.to_pylist(), strict=True):
        raw = t.as_buffer().to_pybytes()
        starts, ends, _ = spans(LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), NOT_ALNUM)
        hit = np.zeros(len(starts) + 1, np.int64)
        if spans_:
            np.add.at(hit, np.searchsorted(starts, [s["start"] for s in spans_]), 1)
            np.add.at(hit, np.searchsorted(ends, [s["end"] for s in spans_]) + 1, -1)
        inside = np.r_[False, np.cumsum(hit)[:-1] > 0, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        cut = [(int(starts[x]), int(ends[y - 1])) for x, y in edges]
        places = [0, *(p for pair in cut for p in pair), len(raw)]
        parts = [raw[places[k] : places[k + 1]] for k in range(0, len(places), 2)]
        out.append({"n_words": len(starts), "n_hit": int(inside.sum()), "items": sorted(set(own or ())), "spans": [{"start": x, "end": y} for x, y in cut], "text": b"\n".join(parts).decode("utf-8", "replace")})
    return pa.array(out, RESULT)


def _in_passes(docs: DataFrame, items: DataFrame, blocks: int, n: int) -> DataFrame:
    """As one search, a block of items at a time."""
    spark = docs.sparkSession
    docs = docs.withColumn("__print", F.xxhash64("text"))
    found = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()  # about a block
        sent = spark.sparkContext.broadcast([tuple(r) for r in own])
        got = docs.select("doc_id", "__print", _search(sent, n)("text").alias("g")).where("g.n_hit > 0")
        found.append(stored(got.select("doc_id", "__print", "g.spans", "g.items"), "hits"))
        sent.destroy()
    every = reduce(DataFrame.union, found).groupBy("doc_id", "__print").agg(F.flatten(F.collect_set("spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items"))
    merge = F.arrow_udf(_merged, DDL)
    joined = docs.join(every, docs.doc_id.eqNullSafe(every.doc_id) & (docs["__print"] == every["__print"]), "left")
    return joined.select(*[docs[c] for c in docs.columns], merge(docs.text, "__spans", "__items").alias("__got"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 16 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without hit spans (a line break stands for each), n_words, n_hit, items, spans and ``keep``.

    items: sorted ids, as strings, of the items with a phrase in the text. spans: byte ranges of the
    text before removal, end exclusive.
    """
    keep = tuple(c for c in keep if c not in OUT)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"), *keep)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    if blocks > 1:
        out = _in_passes(docs, items, blocks, n)
    else:
        block = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])  # block_bytes at most
        out = docs.withColumn("__got", _search(block, n)("text"))
    return out.select("doc_id", *[F.col(f"__got.{c}").alias(c) for c in OUT[1:]], *keep)
