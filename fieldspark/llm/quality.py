"""Quality classifier by importance resampling.

Tokens are maximal runs of letters and digits, or of ASCII punctuation, in whole texts; tokens and pairs
of neighbours are hashed into ``BUCKETS`` features. Two generative models give each feature a probability:
the *target* model counts documents labelled good, the *raw* model all documents. A document's log weight
is the sum of log(target / raw) over its features, divided by their number plus ``PRIOR`` and scaled by
``SCALE``: as many features as ``SCALE`` then decide in any text, whatever its length. Gumbel noise, drawn
from a hash of the document's id, is added, and the k largest keys are kept: a sample without replacement
with probabilities that follow the weights.

k is the number of documents whose weight is at least the threshold that ``keep_share`` of the labelled
good documents reach. The k-th key is found exactly by refining 16 bits at a time on bucket counts, so
neither keys nor documents gather anywhere.

With ``reject_toxic``, as in op9_quality and the pipeline, toxic documents are judged apart, go, and do not
count for k. A token or pair of the lower-cased text, by its
64-bit hash, is a *mark* if the documents labelled toxic that hold it exceed what chance gives by
``EVIDENCE`` (log likelihood ratio of a binomial) and its share of them is ``STRONG`` times its share of
documents labelled not toxic. A document's toxic weight is the sum of log(toxic share / other share) over
the different marks that it holds, so a few words count in a text of any length. Documents are rejected
above the weight that ``clean_share`` of those labelled not toxic stay within. Of the features that enough
toxic documents hold, the ``MAX_MARKS`` commonest are tried.

The labels that the models count are samples of at most ``max_labelled`` rows for each label, smallest hash
of the id first; all else covers all rows.

Defined results: null text counts as empty; an empty text has weight 0; without any good label every
weight is 0 and all documents stay that are not toxic; a null toxic label counts as not toxic for the
quality target and not at all for toxicity; of several labels of an id the toxic one holds; labels too few
for any mark reject nothing as toxic; rows with one id share their noise; a null id is allowed; ties at the
k-th key are all kept; an empty table gives no rows; of clashing columns in ``keep`` the operator's own win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, release, stored
from .words import buffers, chunks, hashes, rolling

OUT = ("doc_id", "log_weight", "gumbel_key", "kept")
BUCKETS, PRIOR, SCALE, SEED = 1 << 16, 20, 200.0, 17
#: Bytes of text whose features are made at a time.
FEATURE_BYTES = 1 << 20
EVIDENCE, STRONG, MAX_MARKS = 12.0, 10.0, 1 << 20
#: 0: blank, 1: letter, digit or not ASCII, 2: ASCII punctuation or control.
KINDS = np.ones(256, np.uint8)
KINDS[:0x80] = 2
KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KINDS[[0x20, *range(0x09, 0x0E)]] = 0


def features(column: pa.Array, bits: int = 16) -> Iterator[np.ndarray]:
    """Feature numbers of each text, with repeats: the leading bits of their hashes."""
    shift = np.uint64(64 - bits)
    data, offsets = buffers(column)
    for a, b in chunks(offsets, FEATURE_BYTES):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        kind = KINDS[part]
        new = np.ones(len(part), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[own[:-1][own[:-1] < len(part)]] = True
        at = np.flatnonzero(new)
        ends = np.r_[at[1:], len(part)]
        real = kind[at] > 0
        starts, ends = at[real], ends[real]
        first = np.searchsorted(starts, own)
        h = hashes(part, starts, ends)
        one = (h >> shift).astype(np.int64)
        two = (rolling(h, 2, seed=1) >> shift).astype(np.int64)
        for k in range(b - a):
            lo, hi = int(first[k]), int(first[k + 1])
            yield np.concatenate([one[lo:hi], two[lo : max(lo, hi - 1)]])


def _count(good):
    """Rows (bucket, raw, target) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = np.isin(np.nan_to_num(ids.astype(np.float64), nan=-1).astype(np.int64) if ids.dtype.kind == "f" else ids, good.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for f, w in zip(features(batch.column(1)), wanted, strict=True):
                own = np.bincount(f, minlength=BUCKETS) if len(f) > 2000 else None
                for to in (raw, target)[: 1 + bool(w)]:
                    if own is None:
                        np.add.at(to, f, 1)
                    else:
                        to += own
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])
        release()

    return run


def log_ratio(docs: DataFrame, labels: DataFrame, max_labelled: int) -> np.ndarray:
    """log(target / raw) of every feature, from counts of at most ``BUCKETS`` rows."""
    spark = docs.sparkSession
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = np.array([r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()], np.int64)
    counts = docs.select("doc_id", "text").mapInArrow(_count(spark.sparkContext.broadcast(np.sort(ids))), "bucket int, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _found(f: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``known`` (not empty), and whether they match."""
    at = np.minimum(np.searchsorted(known, f), len(known) - 1)
    return at, known[at] == f


def _words(column: pa.Array, rows: int = 512) -> Iterator[np.ndarray]:
    """Full hashes of the features of each text in lower case, lowering some rows at a time."""
    for k in range(0, len(column), rows):
        yield from features(pc.utf8_lower(column.slice(k, rows)), 64)


def _holders(known=None):
    """Rows (feature, n): documents of a batch that hold it, of the features ``known`` or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, size, last = [], 0, len(batch) - 1
            for k, f in enumerate(_words(batch.column(0))):
                seen.append(np.unique(f if known is None else f[_found(f, known.value)[1]]))
                size += len(seen[-1])
                if size > 1 << 20 or k == last:
                    f, n = np.unique(np.concatenate(seen), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n.astype(np.int64))], names=["feature", "n"])
                    seen, size = [], 0
        release()

    return run


def _toxicity(labels: DataFrame) -> DataFrame:
    """doc_id and whether it is toxic, one row for each id with such a label."""
    some = labels.where("doc_id is not null and toxic is not null")
    return some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))


def marks(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that mark toxic documents, sorted, and their log(toxic share / other share)."""
    none = np.empty(0, np.int64), np.empty(0)
    known = _toxicity(labels)
    part = lambda w: known.where(w).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = {w: docs.select("doc_id", "text").join(F.broadcast(part(w)), "doc_id", "left_semi") for w in ("toxic", "not toxic")}
    n1, n0 = (d.count() for d in texts.values())
    if not n1 or not n0:
        return none
    base = n1 / (n1 + n0)
    enough = int(np.ceil(EVIDENCE / -np.log(base)))
    total = lambda w, ids: texts[w].select("text").mapInArrow(_holders(ids), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    often = total("toxic", None).where(F.col("n") >= enough).orderBy(F.desc("n"), "feature").limit(MAX_MARKS).toArrow()
    order = np.argsort(often["feature"].to_numpy())
    f, a = often["feature"].to_numpy()[order], often["n"].to_numpy()[order].astype(float)
    if not len(f):
        return none
    other = total("not toxic", docs.sparkSession.sparkContext.broadcast(f)).toArrow()  # MAX_MARKS rows at most
    b = np.zeros(len(f))
    b[np.searchsorted(f, other["feature"].to_numpy())] = other["n"].to_numpy()
    weight = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
    evidence = a * np.log(a / (a + b) / base) + b * np.log(np.maximum(b, 1) / (a + b) / (1 - base))
    strong = (evidence >= EVIDENCE) & (weight >= np.log(STRONG))
    return f[strong], weight[strong]


RESULT = pa.struct([("weight", pa.float64()), ("toxic", pa.float64())])


def _weights(ratio, model):
    """The log weight and the toxic weight of each text, in one pass; ``model`` is None where toxicity is not judged."""

    @F.arrow_udf("struct<weight: double, toxic: double>")
    def weights(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            r = ratio.value
            weight = [SCALE * float(r[f].sum()) / (len(f) + PRIOR) for f in features(text)]
            toxic = [0.0] * len(weight)
            if model is not None:
                known, w = model.value
                for k, f in enumerate(_words(text)):
                    at, same = _found(f, known)
                    toxic[k] = float(w[np.unique(at[same])].sum())
            yield pa.StructArray.from_arrays([pa.array(weight, pa.float64()), pa.array(toxic, pa.float64())], fields=list(RESULT))
        release()

    return weights


def gumbel(column: str, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of a column: the same in every run."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """Exact k-th largest value of a long column ``key``: counts over 2^16 ranges, refined until one value is left."""
    if k < 1:
        return None
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = -(-(high - low + 1) // (1 << 16))
        inside = keys.where(F.col("key").between(low, high)).groupBy(F.expr(f"(key - {low}L) div {width}L").alias("b")).agg(F.count("*").alias("n"))
        for r in sorted(inside.collect(), reverse=True):  # 2^16 rows at most
            if k <= r.n:
                low, high = low + r.b * width, min(high, low + (r.b + 1) * width - 1)
                break
            k -= r.n
    return low


def weigh(docs: DataFrame, labels: DataFrame, max_labelled: int = 50_000, keep: tuple[str, ...] = (), reject_toxic: bool = False) -> DataFrame:
    """doc_id, log_weight, the toxic weight as __toxic and ``keep``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text"), *[F.col(c).alias(f"__{c}") for c in keep])
    share = docs.sparkSession.sparkContext.broadcast
    ratio = share(log_ratio(docs, labels, max_labelled))  # BUCKETS numbers
    model = marks(docs, labels, max_labelled) if reject_toxic else ((), ())
    got = docs.withColumn("__got", _weights(ratio, share(model) if len(model[0]) else None)("text"))
    return got.select("doc_id", F.col("__got.weight").alias("log_weight"), F.col("__got.toxic").alias("__toxic"), *[F.col(f"__{c}").alias(c) for c in keep])


def classify(docs: DataFrame, labels: DataFrame, keep_share: float = 0.999, max_labelled: int = 50_000, keep: tuple[str, ...] = (), reject_toxic: bool = False, clean_share: float = 0.999) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept and ``keep``, one row per document.

    keep_share: share of labelled good documents whose weight defines k.
    reject_toxic: documents whose toxic weight is too high go as well.
    clean_share: share of the documents labelled not toxic whose toxic weight defines the rejection.
    """
    keep = tuple(c for c in keep if c not in OUT)
    weighed = stored(weigh(docs, labels, max_labelled, keep, reject_toxic).withColumn("gumbel_key", F.col("log_weight") + gumbel("doc_id")), "weighed")
    scores = weighed.select("doc_id", *[F.expr(f"cast(round({c} * 1e6) as long)").alias(n) for c, n in (("log_weight", "w"), ("gumbel_key", "key"), ("__toxic", "t"))])
    most = None
    if reject_toxic:
        clean = scores.join(_toxicity(labels).where("not toxic"), "doc_id", "left_semi").select(F.col("t").alias("key"))
        n = clean.count()
        most = kth_largest(clean, int((1 - clean_share) * n) + 1) if n else None
    fine = F.lit(True) if most is None else F.expr(f"cast(round(__toxic * 1e6) as long) <= {most}L")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = scores.join(good, "doc_id", "left_semi").select(F.col("w").alias("key"))
    floor = kth_largest(known, int(np.ceil(keep_share * known.count())))
    if floor is None:
        return weighed.select("doc_id", "log_weight", "gumbel_key", fine.alias("kept"), *keep)
    rest = scores if most is None else scores.where(F.col("t") <= most)
    least = kth_largest(rest, rest.where(F.col("w") >= floor).count())
    enough = F.lit(False) if least is None else F.expr("cast(round(gumbel_key * 1e6) as long)") >= least
    return weighed.select("doc_id", "log_weight", "gumbel_key", (enough & fine).alias("kept"), *keep)
