"""Language-model scores from an interpolated modified Kneser-Ney bigram model.

Texts are lowered (A-Z) and split at ``[\\x20\\x09-\\x0D]``; one end token follows. The model learns from the
documents whose crc32 of the id, as text, is not 1 modulo 5.

1. *Counting.* Every task counts the bigrams of some MB of text and sends them to a shard, one entry for each
   distinct bigram of the chunk: to that of its first word, or, where that is one of the ``HOT_WORDS`` commonest
   of a sample (2000 documents, or one in a thousand), to that of the pair, so that no frequent first word fills
   a shard, at any size. A shard adds
   its bigrams up, writes them and sends on, to the shards of the words: of first words, its part of their
   counts as context, which are added there; of second words, how many contexts each has.
2. *Storage.* A shard's files hold hashes in sorted order: bigrams as 16 leading bits (an offset table), 32
   more bits and a count; words as 64 bits with their counts. They lie in the folder of
   ``spark.checkpoint.dir``, which must be mounted (``file:``): workers map them into memory, so a worker reads
   the pages it needs. The number of shards grows with the data. Tasks return the shards that they wrote, and
   a worker that misses the file of one of these raises.
3. *Scoring.* A worker looks up the distinct words and bigrams of some MB of text in hash order.

p(w | v) = max(c(vw) - D, 0) / c(v) + g(v) p(w), where p(w) is of the same form over the numbers of contexts,
interpolated with 1 / (V + 1); D depends on the count (1, 2, 3 or more) and comes from counts of counts.

Defined results: null text counts as empty (the end token alone); a null id counts as an empty one (it is
learned from); every row is counted and scored by itself; without any training document all words are
unknown and p = 1 / (V + 1) = 1; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, n_parts, shared_dir, stored
from .words import buffers, chunks, mix, words

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
COUNT_BYTES, SCORE_BYTES = 12 << 20, 4 << 20
SAMPLE_DOCS, HOT_WORDS = 2000, 1000
ROW = "shard int, kind int, a binary, b binary, c binary, d binary"
SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), *[(x, pa.binary()) for x in "abcd"]])
STATS = "n1 long, n2 long, n3 long, n4 long, types long, tokens long, shard long"
STATS_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in STATS.split(", ")])


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with their contexts, and the first token of each text (n + 1 values)."""
    h, first = words(data, offsets, lower=True)
    n = len(first) - 1
    second = np.insert(h, first[1:], END)
    begins = first + np.arange(n + 1)
    context = np.r_[BEGIN, second[:-1]] if len(second) else second
    context[begins[:-1]] = BEGIN
    return context, second, begins


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0xC2B2AE3D27D4EB4F) + w * np.uint64(0x165667B19E3779F9))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h) % np.uint64(shards)).astype(np.int64)


def pair_shard(v: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """The shard of a bigram: that of its first word, or of the pair where the word is ``hot`` (sorted)."""
    common = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
    return (mix(np.where(common, bigram(v, w), v)) % np.uint64(shards)).astype(np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for a, b in chunks(offsets, SCORE_BYTES):
            h, n = np.unique(words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def hot_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the commonest words of a sample, and of the begin, sorted. They settle where counts lie, nothing else."""
    n = docs.count()
    share = min(1.0, max(SAMPLE_DOCS, n // 1000) / max(n, 1))
    counted = docs.select("text").sample(share, seed=5).mapInArrow(_sampled, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "word").limit(HOT_WORDS).toArrow()["word"].to_numpy().astype(np.int64).view(np.uint64)
    return np.unique(np.r_[found, BEGIN])


def by_shard(s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(s, kind="stable")
    cuts = np.flatnonzero(np.diff(s[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield int(s[own[0]]), own


def _count(shards: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in chunks(offsets, COUNT_BYTES):
                v, w, _ = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                key = bigram(v, w)
                order = np.argsort(key)
                key = key[order]
                at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                v, w, n = v[order[at]], w[order[at]], np.diff(np.r_[at, len(key)])
                if (n > 255).any():  # a count travels in bytes that add up
                    times = -(-n // 255)
                    last = np.cumsum(times) - 1
                    v, w, rest = np.repeat(v, times), np.repeat(w, times), n - (times - 1) * 255
                    n = np.full(len(v), 255)
                    n[last] = rest
                s = pair_shard(v, w, shards, hot.value)
                order = np.lexsort((v, s))
                v, w, n, s = v[order], w[order], n[order].astype(np.uint8), s[order]
                at = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (s[1:] != s[:-1])])
                size = np.diff(np.r_[at, len(v)]).astype(np.uint32)
                cuts = np.flatnonzero(np.r_[True, s[at][1:] != s[at][:-1], True])
                out = []
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    x, y = at[i], at[j] if j < len(at) else len(v)
                    out.append({"shard": int(s[x]), "kind": 0, "a": v[at[i:j]].tobytes(), "b": size[i:j].tobytes(), "c": w[x:y].tobytes(), "d": n[x:y].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return run


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole files appear at once, whatever attempt writes them."""
    part = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(part, array)
    os.replace(part, f"{folder}/{name}.npy")


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    """Rows by shard; a partition holds few shards."""
    rows: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            rows.setdefault(row["shard"], []).append(row)
    return rows


def _join(rows: list[dict], column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _bigrams(folder: str, shards: int):
    """Writes the bigrams of each shard; rows: kind 1 contexts and kind 2 words for the shards of words, kind 3 counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _gathered(batches).items():
            v = np.repeat(_join(rows, "a", np.uint64), _join(rows, "b", np.uint32))
            w, n = _join(rows, "c", np.uint64), _join(rows, "d", np.uint8)
            rows.clear()
            key = bigram(v, w)
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.add.reduceat(n[order].astype(np.int64), at)
            v, w, key = v[order[at]], w[order[at]], key[at]
            save(folder, f"offsets-{shard}", np.r_[0, np.cumsum(np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=1 << 16))].astype(np.uint32))
            save(folder, f"rest-{shard}", (key >> np.uint64(16)).astype(np.uint32))
            save(folder, f"count-{shard}", np.minimum(n, 255).astype(np.uint8))
            large = np.flatnonzero(n >= 255)
            save(folder, f"large-{shard}", np.stack([large, n[large]]))
            out = [{"shard": shard, "kind": 3, "a": np.array([*(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n)], np.int64).tobytes()}]
            word, own = np.unique(v, return_inverse=True)
            parts = np.stack([np.bincount(own, minlength=len(word), weights=x).astype(np.int64) for x in (n, n == 1, n == 2, n >= 3)])
            for s, k in by_shard(shard_of(word, shards)):
                out.append({"shard": s, "kind": 1, "a": word[k].tobytes(), "b": parts[:, k].tobytes()})
            word, own = np.unique(w, return_inverse=True)
            contexts, total = np.bincount(own, minlength=len(word)), np.bincount(own, minlength=len(word), weights=n)
            for s, k in by_shard(shard_of(word, shards)):
                out.append({"shard": s, "kind": 2, "a": word[k].tobytes(), "b": contexts[k].astype(np.uint32).tobytes(), "c": total[k].astype(np.uint64).tobytes()})
            yield pa.RecordBatch.from_pylist([{**dict.fromkeys("abcd", b""), **r} for r in out], schema=SCHEMA)

    return run


def _words(folder: str):
    """Writes the words of each shard, columns COLUMNS; rows: counts of counts of contexts, types and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _gathered(batches).items():
            own = [r for r in rows if r["kind"] == 1]
            more = [r for r in rows if r["kind"] == 2]
            word = np.concatenate([_join(own, "a", np.uint64), _join(more, "a", np.uint64)])
            every, at = np.unique(word, return_inverse=True)
            table = np.zeros((7, len(every)), np.int64)
            table[0] = every.view(np.int64)
            cut = 0
            for r in own:
                n = len(r["a"]) // 8
                table[1:5, at[cut : cut + n]] += np.frombuffer(r["b"], np.int64).reshape(4, n)
                cut += n
            np.add.at(table[5], at[cut:], _join(more, "b", np.uint32))
            np.add.at(table[6], at[cut:], _join(more, "c", np.uint64).astype(np.int64))
            save(folder, f"words-{shard}", table)
            c = table[5]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*((c == k).sum() for k in (1, 2, 3, 4)), (c > 0).sum(), table[6].sum(), shard)], schema=STATS_SCHEMA)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts 0, 1, 2 and 3 or more; between 0 and the count also where few counts are known."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [0.0, *(k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
    return [min(max(d, 0.0), k) for k, d in enumerate(raw)]


class Model:
    """Sorted hash arrays of all shards, mapped into memory."""

    def __init__(self, folder: str, shards: int, d2: list[float], d1: list[float], contexts: int, types: int, total: int, rest: float, pairs: frozenset[int], words: frozenset[int], hot: np.ndarray):
        self.written = {"words": words, **dict.fromkeys(("offsets", "rest", "count", "large"), pairs)}
        self.folder, self.shards, self.d2, self.d1, self.hot = folder, shards, np.array(d2), np.array(d1), hot
        self.contexts, self.types, self.total, self.rest = contexts, types, total, rest
        self.open: dict[str, np.ndarray] = {}

    def load(self, kind: str, shard: int) -> np.ndarray | None:
        """None for a shard without entries; a missing file of any other raises."""
        if shard not in self.written[kind]:
            return None
        name = f"{kind}-{shard}"
        if name not in self.open:
            self.open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return self.open[name]

    def word_rows(self, h: np.ndarray) -> np.ndarray:
        """The six numbers of each word (6 x n): as context its count, N1, N2, N3+; its contexts; its count."""
        out = np.zeros((6, len(h)), np.int64)
        for s, k in by_shard(shard_of(h, self.shards)):
            table = self.load("words", s)
            if table is not None and table.shape[1]:
                own = table[0].view(np.uint64)
                i = np.minimum(np.searchsorted(own, h[k]), len(own) - 1)
                hit = own[i] == h[k]
                out[:, k[hit]] = table[1:, i[hit]]
        return out

    def counts(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        for s, k in by_shard(shard):
            offsets = self.load("offsets", s)
            if offsets is None:
                continue
            rest, n, large = (self.load(x, s) for x in ("rest", "count", "large"))
            top, want = (key[k] >> np.uint64(48)).astype(np.int64), (key[k] >> np.uint64(16)).astype(np.uint32)
            lo, end = offsets[top].astype(np.int64), offsets[top + 1].astype(np.int64)
            hi = end.copy()
            while (lo < hi).any():
                mid = np.minimum((lo + hi) >> 1, len(rest) - 1)
                less = (rest[mid] < want) & (lo < hi)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.where(lo < hi, mid, hi))
            at = np.minimum(lo, len(rest) - 1)
            hit = (lo < end) & (rest[at] == want)
            own = np.where(hit, n[at], 0).astype(np.int64)
            if large.shape[1] and (full := np.flatnonzero(own == 255)).size:
                own[full] = large[1, np.searchsorted(large[0], at[full])]
            out[k] = own
        return out

    def score(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p(w | v), and the counts of w."""
        known, at = np.unique(np.r_[v, w], return_inverse=True)
        context, n1, n2, n3, contexts, count = self.word_rows(known)
        lower = self.rest / (self.types + 1) + np.maximum(contexts - self.d1[np.minimum(contexts, 3)], 0) / max(self.contexts, 1)
        iv, iw = at[: len(v)], at[len(v) :]
        pair, where = np.unique(iv * len(known) + iw, return_inverse=True)
        pv, pw = pair // len(known), pair % len(known)
        c = self.counts(pair_shard(known[pv], known[pw], self.shards, self.hot), bigram(known[pv], known[pw]))
        gamma = n1 * self.d2[1] + n2 * self.d2[2] + n3 * self.d2[3]
        all_ = np.maximum(context[pv], 1)
        p = np.where(context[pv] > 0, np.maximum(c - self.d2[np.minimum(c, 3)], 0) / all_ + gamma[pv] / all_ * lower[pw], lower[pw])
        return np.log10(p)[where], count[iw]


def train(docs: DataFrame) -> Model:
    """Counts the texts of ``docs`` (column text) and writes the model's files to the shared folder."""
    spark = docs.sparkSession
    at = urlparse(f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}")
    if at.scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir must be a mounted folder (file:), for workers to map the model into memory")
    folder = at.path
    os.makedirs(folder, exist_ok=True)
    shards, hot = n_parts(docs), hot_words(docs)
    counted = docs.select("text").mapInArrow(_count(shards, spark.sparkContext.broadcast(hot)), ROW)
    # by number, one shard a partition: hashed, one partition in several would hold three or more at a time
    counted = counted.repartitionById(shards, "shard").mapInArrow(_bigrams(folder, shards), ROW)
    counted = stored(counted, "counted")
    sums, pairs = np.zeros(5, np.int64), set()
    for r in counted.where("kind = 3").select("shard", "a").collect():  # five numbers a shard
        sums += np.frombuffer(r.a, np.int64)
        pairs.add(r.shard)
    made = counted.where("kind < 3").repartitionById(shards, "shard").mapInArrow(_words(folder), STATS)
    t = made.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS_SCHEMA.names[:-1]], F.collect_set("shard").alias("shards")).first()
    d1 = discounts(t.n1, t.n2, t.n3, t.n4)
    contexts = int(sums[4])
    left = (d1[1] * t.n1 + d1[2] * t.n2 + d1[3] * (t.types - t.n1 - t.n2)) / contexts if contexts else 1.0
    return Model(folder, shards, discounts(*map(int, sums[:4])), d1, contexts, t.types, t.tokens, left, frozenset(pairs), frozenset(t.shards), hot)


RESULT = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(model: Model):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = buffers(column)
            parts = []
            for a, b in chunks(offsets, SCORE_BYTES):
                v, w, first = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p, c = model.score(v, w)
                base = np.log10((c + 0.5) / (model.total + 0.5 * (model.types + 1)))
                at = first[:-1]
                parts.append(pa.StructArray.from_arrays([pa.array(np.diff(first).astype(np.int64)), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(p, at))], fields=list(RESULT)))
            yield pa.concat_arrays(parts) if parts else pa.array([], RESULT)

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and ``keep``."""
    names = [f.name for f in RESULT]
    keep = tuple(c for c in keep if c not in ("doc_id", *names))
    from collections.abc import Iterator as _Iterator

    run = _scored(model)
    run.__annotations__ = {"texts": _Iterator[pa.Array], "return": _Iterator[pa.Array]}
    udf = F.arrow_udf(run, "struct<n_tokens: long, n_known: long, base_score: double, score: double>")
    out = docs.select("doc_id", *keep, udf(filled("text")).alias("__got"))
    return out.select("doc_id", *[F.col(f"__got.{c}").alias(c) for c in names], *keep)
