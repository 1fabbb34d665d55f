"""Language identification by mixtures: every word of a document is drawn from one language of a set.

Words are runs of letters (of bytes from 0x80 on, too) in lower case. A language gives a word the product over its
bytes, and its end, of P(byte | up to three bytes before it), interpolated over orders 1 to 4 from counts of n-grams
hashed into ``BUCKETS``. A noise component gives each byte the same chance, for words of no language.

Training counts n-grams of all documents given, by their language: tasks count their distinct words once and add up
tables, which meet by language and order; the model takes 2 MB a language and is broadcast, so more than
``MOST_LANGUAGES`` raise ValueError.

Prediction works on whole texts. Expectation-maximisation over all languages gives each document its proportions.
Languages join the set in the order of these proportions; the set of m languages is fitted again, and one more is
taken while the log likelihood grows by more than ``PENALTY`` times the logarithm of the number of words. The
prediction is the language of the set with the largest share and the score this share of the document's words.
Documents are worked on together, some bytes of text at a time.

Defined results: null text, or text without a letter, is ``und`` with score 0 and no languages; so is everything
where there is nothing to learn from. Of equal proportions the language with more training words comes first, then
the smaller name. Null lang is never learned from; rows count each, whatever their ids; a null id is allowed and not
held out, nor learned from by the query. An empty table gives no rows. Of clashing columns in ``keep`` the
operator's own win; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, filled, release
from .vocabulary import Coded, coded

OUT = ("lang_pred", "score", "langs")
BITS, ORDER = 16, 4
BUCKETS = 1 << BITS
#: Weight of the shorter context, log probability of a byte of noise, and of a word's start in the proportions.
BACKOFF, NOISE, PRIOR = 4.0, -np.log(64.0), 1.0
PENALTY, ROUNDS = 3.0, 12
MOST_LANGUAGES = 256
#: Bytes before and after a word.
BEGIN, END = 1, 2
#: Bytes that are no part of a word: ASCII without letters.
BREAKS = np.zeros(256, bool)
BREAKS[:0x80] = True
BREAKS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _lowered(column: pa.Array, most: int = CHUNK_BYTES, rows: int = 1024) -> Iterator[tuple[int, Coded]]:
    """The words of a text column in lower case, with the first row of each part."""
    for k in range(0, len(column), rows):
        for part in coded(pc.utf8_lower(column.slice(k, rows)), BREAKS, most):
            yield k, part


def _bucket(key: np.ndarray) -> np.ndarray:
    return ((key * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def grams(words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For orders 1 to 4 the bucket of each n-gram and of its context, over the bytes and ends of all words.

    Also where each word's positions start.
    """
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64, len(words) + 1)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    pad = ORDER - 1
    starts = np.concatenate([[0], np.cumsum(size + pad + 1)])
    stream = np.full(starts[-1], BEGIN, np.uint64)
    own = np.arange(len(data)) + np.repeat(np.arange(len(words)) * (pad + 1) + pad, size)
    stream[own] = data
    stream[starts[1:] - 1] = END
    at = np.flatnonzero(np.concatenate([[False] * pad, np.ones(max(0, len(stream) - pad), bool)]) & _inside(starts, pad))
    key, context, grams_, contexts = stream[at], np.zeros(len(at), np.uint64), [], []
    for n in range(1, ORDER + 1):
        grams_.append(_bucket(key))
        contexts.append(_bucket(context))
        if n < ORDER:
            before = stream[at - n]
            key = key | (before << np.uint64(8 * n))
            context = context | (before << np.uint64(8 * (n - 1)))
    return grams_, contexts, starts[:-1] - pad * np.arange(len(words))


def _inside(starts: np.ndarray, pad: int) -> np.ndarray:
    """Which places of the stream are no word's beginning."""
    out = np.ones(starts[-1], bool)
    for j in range(pad):
        out[starts[:-1] + j] = False
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, part, buckets, counts) of a task: its counts of n-grams (parts 0 to 3) and contexts (4 to 7)."""
    tables: dict[str, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, t in tables.items():
            for part in range(2 * ORDER):
                some = np.flatnonzero(t[part])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([some.astype(np.uint16).tobytes()], pa.binary()), pa.array([t[part, some].tobytes()], pa.binary())], names=["lang", "part", "buckets", "counts"])
        tables.clear()

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for row, part in _lowered(batch.column(1)):
            if not len(part.words):
                continue
            of_word = np.repeat(of[row + part.a : row + part.b], np.diff(part.first))
            v = len(part.words)
            weight = np.bincount(of_word * v + part.codes, minlength=v * len(names)).reshape(len(names), v)
            g, c, starts = grams(part.words)
            size = np.diff([*starts, len(g[0])])
            for k in np.flatnonzero(weight.any(axis=1)):
                t = tables.setdefault(names[k], np.zeros((2 * ORDER, BUCKETS), np.int64))
                each = np.repeat(weight[k], size)
                some = np.flatnonzero(each)
                for n in range(ORDER):
                    t[n] += np.bincount(g[n][some], each[some], BUCKETS).astype(np.int64)
                    t[ORDER + n] += np.bincount(c[n][some], each[some], BUCKETS).astype(np.int64)
            if len(tables) > 32:
                yield from sent()
    yield from sent()
    release()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one language and part added up; rows come by language and part."""
    at, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lang", "part", "counts"])
    for batch in batches:
        for lang, part, buckets, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, part) != at:
                if at:
                    yield row()
                at, total = (lang, part), np.zeros(BUCKETS, np.int64)
            total[np.frombuffer(buckets, np.uint16)] += np.frombuffer(counts, np.int64)
    if at:
        yield row()


class Model:
    """Languages, more training words first, and tables (part, bucket, language) of counts."""

    def __init__(self, names: list[str], tables: np.ndarray, words: np.ndarray):
        self.names, self.tables, self.words = names, tables, words

    def log_likelihood(self, words: pa.Array) -> np.ndarray:
        """Of each word in each language, and in noise as the last column."""
        g, c, starts = grams(words)
        total = self.tables[ORDER].sum(axis=0)  # all contexts of order 1 are empty
        out = np.empty((len(words), len(self.names) + 1))
        size = np.diff([*starts, len(g[0])])
        out[:, -1] = NOISE * size
        step = max(1, (1 << 21) // (len(self.names) * 8))
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + step, "right")) - 1) if starts[-1] >= starts[a] + step else len(words)
            to = starts[b] if b < len(words) else len(g[0])
            p = (self.tables[0][g[0][starts[a] : to]] + 0.1) / (total + 25.6)
            for n in range(1, ORDER):
                p = (self.tables[n][g[n][starts[a] : to]] + BACKOFF * p) / (self.tables[ORDER + n][c[n][starts[a] : to]] + BACKOFF)
            # buckets that words of other contexts share can make a sum over bytes exceed one, never a factor
            out[a:b, :-1] = np.add.reduceat(np.log(np.minimum(p, 1.0)), starts[a:b] - starts[a], axis=0)
            a = b
        return out


def train(docs: DataFrame) -> Model:
    """A model of the documents' texts by their lang; rows without either teach nothing."""
    ddl = "lang string, part int, buckets binary, counts binary"
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = known.mapInArrow(_count, ddl).repartition(max(1, min(2 * ORDER * found, 512)), "lang", "part").sortWithinPartitions("lang", "part").mapInArrow(_added, "lang string, part int, counts binary")
    tables: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():  # half a megabyte each, of a bounded number
        tables.setdefault(r.lang, np.zeros((2 * ORDER, BUCKETS), np.int64))[r.part] = np.frombuffer(r.counts, np.int64)
    words = {k: int(t[0, int(_bucket(np.array([END], np.uint64))[0])]) for k, t in tables.items()}
    names = sorted(tables, key=lambda k: (-words[k], k))
    all_ = np.stack([tables[k] for k in names], axis=2).astype(np.float32) if names else np.zeros((2 * ORDER, BUCKETS, 0), np.float32)
    return Model(names, all_, np.array([words[k] for k in names], float))


def proportions(p: np.ndarray, n: np.ndarray, starts: np.ndarray, prior: np.ndarray | float, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x components) by expectation-maximisation, and the log likelihood at the last shares but one.

    p: likelihoods of the entries, up to a factor for each; n: how often each occurs; entries of a document lie
    together, from ``starts`` on (none is without). prior: words of each component added before counting shares.
    """
    size = np.diff([*starts, len(p)])
    k = p.shape[1]
    prior = np.broadcast_to(prior, k)
    share = np.full((len(starts), k), 1 / k)
    total = np.add.reduceat(n, starts)
    for r in range(rounds):
        w = p * np.repeat(share, size, axis=0)
        s = w.sum(axis=1)
        if r == rounds - 1:
            likelihood = np.add.reduceat(n * np.log(s), starts)
        w *= (n / s)[:, None]
        share = np.add.reduceat(w, starts, axis=0) + prior
        share /= total[:, None] + prior.sum()
    return share, likelihood


def mixtures(model: Model, part: Coded) -> Iterator[tuple[int, list[tuple[str, float]]]]:
    """For each text with words its place in the part and its set of languages with their shares, largest first."""
    starts, codes, n = part.counts()
    rows = np.flatnonzero(np.diff(starts))
    if not len(rows):
        return
    starts, n = starts[:-1][rows], n.astype(float)
    log_p = model.log_likelihood(part.words)
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(log_p - top, -60.0))[codes]
    rest = np.add.reduceat(n * top[codes, 0], starts)
    size = np.diff([*starts, len(codes)])
    prior = np.append(PRIOR * (model.words + 1) / (model.words + 1).sum() * 0.9, PRIOR * 0.1)
    full, _ = proportions(p, n, starts, prior)
    order = np.argsort(-full[:, :-1], axis=1, kind="stable")
    words = np.add.reduceat(n, starts)
    best, shares, sets = np.full(len(rows), -np.inf), [()] * len(rows), 0
    active = np.arange(len(rows))
    while len(active) and sets < len(model.names):
        sets += 1
        mine = np.zeros(len(rows), bool)
        mine[active] = True
        entries = np.flatnonzero(np.repeat(mine, size))
        own_size = size[active]
        chosen = np.c_[order[active, :sets], np.full(len(active), p.shape[1] - 1)]
        own = np.take_along_axis(p[entries], np.repeat(chosen, own_size, axis=0), axis=1)
        share, likelihood = proportions(own, n[entries], np.concatenate([[0], np.cumsum(own_size)[:-1]]), PRIOR / (10 * (sets + 1)))
        value = likelihood + rest[active] - PENALTY * sets * np.log(words[active] + 1)
        better = value > best[active]
        for i, s in zip(active[better].tolist(), share[better]):
            shares[i] = s
        best[active[better]] = value[better]
        active = active[better]
    for i, r in enumerate(rows.tolist()):
        found = sorted(zip(shares[i][:-1].tolist(), range(len(shares[i]) - 1)), key=lambda x: (-x[0], x[1]))
        yield r, [(model.names[order[i, j]], s) for s, j in found]


RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, lang_pred, score and langs, the set of languages with their shares, for every row."""
    keep = tuple(c for c in keep if c not in OUT)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB a language

    @F.arrow_udf("struct<lang_pred: string, score: double, langs: array<struct<lang: string, share: double>>>")
    def langs(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        most = max(1 << 16, CHUNK_BYTES * 8 // (len(model.names) + 8))
        for column in texts:
            out = [{"lang_pred": "und", "score": 0.0, "langs": []}] * len(column)
            for row, part in _lowered(column, most) if model.names else ():
                for i, found in mixtures(model, part):
                    out[row + part.a + i] = {"lang_pred": found[0][0], "score": found[0][1], "langs": [{"lang": k, "share": s} for k, s in found]}
            yield pa.array(out, RESULT)
        release()

    text = filled("text")
    got = docs.select(*[F.col(c).alias(f"__{c}") for c in keep], langs(F.when(text.rlike(r"\p{L}"), text).otherwise("")).alias("__got"))
    return got.select(*[F.col(f"__{c}").alias(c) for c in keep], *[F.col("__got")[c].alias(c) for c in OUT])
