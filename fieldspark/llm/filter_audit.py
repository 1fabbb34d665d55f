"""Audit of how five quality filters interact, from a sparse document-term matrix.

Words are maximal runs without ``[\\x20\\x09-\\x0D]``. Tasks parse whole texts into shards of compressed sparse
rows (CSR): for each document the codes of its different words and their counts, with a vocabulary for each shard
of some megabytes of text. The shards' vocabularies, not the documents' words, travel: dealt into buckets by their
hash, words of a bucket meet in one task, which numbers the different ones; each shard then gets the numbers of its
codes and holds global ones. Row sums are the words of a document and the entries of a row its different words.
Words stand for themselves throughout: a hash only deals them. Buckets grow in number with the input, so what a task
knows of words does not.

Failure conditions: A: under 200 words; B: 100 * different words < 50 * words; C: 100 * ``[A-Z]`` characters >
3 * code points; D: any of ``[#$%&*|]``; E: a document with a smaller doc_id has the same text (256 bits of SHA-2
stand for a text). E never gathers a group of copies: counts by text, part and label are summed before texts meet,
so a text has as many rows then as there are parts and labels.

For each part (lang) and each of the 120 orders of the filters, the report says what each step removes. Only counts
by part, failures and labels reach it, so its cost does not depend on the documents.

Defined results: null text is empty (fails A; B and C compare 0 with 0 and pass); null lang is the part ''; a null
doc_id never fails E, makes no other document fail it and has no labels; rows that repeat a doc_id count each, and
of copies under the smallest doc_id none fails E; of several labels of an id any 1 holds; null labels count as 0;
labels of unknown ids are ignored; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, hot_join, n_parts, release, stored
from .vocabulary import Coded, coded
from .words import buffers, hashes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#$%&*|"]] = True
MEASURES = [pa.field("c", pa.bool_()), pa.field("d", pa.bool_())]
BLOBS = pa.list_(pa.struct([("bucket", pa.int64()), ("first", pa.int32()), ("words", pa.binary())]))


def _lists(values: pa.Array) -> pa.Array:
    """All values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(x: np.ndarray, kind: type) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())


def _dealt(part: Coded, buckets: int) -> tuple[list[dict], np.ndarray]:
    """The vocabulary in buckets of the words' hashes, as blobs of words with a line end between, and new codes.

    The new codes follow the buckets, so a bucket's words have codes from ``first`` on.
    """
    _, offsets, data = part.words.buffers()
    ends = np.frombuffer(offsets, np.int64, len(part.words) + 1) if len(part.words) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if len(part.words) else np.zeros(0, np.uint8)
    bucket = (hashes(data, ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    words = part.words.take(pa.array(order)).to_pylist()
    some, first = np.unique(bucket[order], return_index=True)
    return [{"bucket": b, "first": a, "words": b"\n".join(words[a:e])} for b, a, e in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(words)])], code


def _parsed(buckets: int, measure):
    """Rows (text, doc) as shards with codes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in coded(batch.column(0)):
                rows = slice(part.a, part.b)
                doc = batch.column(1)[rows]
                if measure:
                    doc = pa.StructArray.from_arrays([*doc.flatten(), *measure(batch.column(0)[rows])], fields=[*doc.type, *MEASURES])
                blobs, new = _dealt(part, buckets)
                starts, codes, counts = part.counts(new)
                arrays = [pa.array([number]), _lists(doc), _packed(starts, np.int64), _packed(codes, np.int32), _packed(counts, np.int32), pa.array([blobs], BLOBS)]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "docs", "starts", "codes", "counts", "blobs"])
                number += 1
        release()

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of each blob's words: within a bucket, in the order in which they are met. Rows come by bucket."""
    at, known = None, {}
    for batch in batches:
        found = []
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if bucket != at:
                at, known = bucket, {}
            found.append(np.array([known.setdefault(w, len(known)) for w in blob.split(b"\n")], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["shard", "bucket", "first", "ranks"])


def _global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with the global numbers of their codes."""
    for batch in batches:
        out = []
        for codes, pieces in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
            pieces = sorted(pieces or (), key=lambda p: p["first"])
            number = [np.frombuffer(p["ranks"], np.int32).astype(np.int64) + (p["bucket"] << 32) for p in pieces]
            out.append(np.concatenate([np.empty(0, np.int64), *number])[np.frombuffer(codes, np.int32)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary()), batch.column(4)], names=["shard", "docs", "starts", "indices", "counts"])
    release()


def term_matrix(docs: DataFrame, keep: tuple[str, ...], measure=None) -> DataFrame:
    """Shards (shard, docs, starts, indices, counts) of the document-term matrix of the column ``text``.

    docs: ``keep`` of each row, in the order of the rows (and ``MEASURES`` of their texts, made by ``measure``).
    starts, indices, counts: 8, 8 and 4-byte integers; entries starts[k] to starts[k + 1] are those of row k, and
    an index is a word's number in the whole corpus (its bucket in the upper half, its place there in the lower).
    """
    parts = n_parts(docs)
    wanted = docs.select(filled("text").alias("text"), F.struct(*keep).alias("doc"))
    doc = wanted.schema["doc"].dataType.simpleString()
    if measure:
        doc = doc[:-1] + "".join(f",{f.name}:boolean" for f in MEASURES) + ">"
    ddl = f"shard long, docs array<{doc}>, starts binary, codes binary, counts binary, blobs array<struct<bucket: long, first: int, words: binary>>"
    local = stored(wanted.mapInArrow(_parsed(4 * parts, measure), ddl), "shards")
    words = local.select("shard", F.inline("blobs")).select("bucket", "shard", "first", "words")
    named = words.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_numbered, "shard long, bucket long, first int, ranks binary")
    named = named.groupBy("shard").agg(F.collect_list(F.struct("bucket", "first", "ranks")).alias("pieces"))  # a shard's own words
    both = local.drop("blobs").join(named, "shard", "left")
    return both.mapInArrow(_global, f"shard long, docs array<{doc}>, starts binary, indices binary, counts binary")


def row_stats(matrix: DataFrame) -> DataFrame:
    """The rows' documents with n_words (row sums) and n_distinct (different indices)."""
    doc = matrix.schema["docs"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, starts, counts in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                starts = np.frombuffer(starts, np.int64)
                sums = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)])[starts]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(np.diff(sums)), pa.array(np.diff(starts))], names=["doc", "n_words", "n_distinct"])
        release()

    got = matrix.select("docs", "starts", "counts").mapInArrow(run, f"doc {doc.simpleString()}, n_words long, n_distinct long")
    return got.select(*[F.col("doc")[n].alias(n) for n in doc.names], "n_words", "n_distinct")


def characters(texts: pa.Array) -> list[pa.Array]:
    """MEASURES of texts: conditions C and D."""
    data, offsets = buffers(texts)
    total = lambda w: np.diff(np.concatenate([[0], np.cumsum(w, dtype=np.int64)])[offsets])
    points = total((data & 0xC0) != 0x80)
    return [pa.array(100 * total((data >= 0x41) & (data <= 0x5A)) > 3 * points), pa.array(total(SYMBOLS[data]) > 0)]


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_id and fails: the letters among ABCD whose conditions the document meets."""
    text = filled("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("lang").alias("part"), F.unhex(F.sha2(text, 256)).alias("text_id"), text.alias("text"))
    got = row_stats(term_matrix(own, ("doc_id", "part", "text_id"), characters))
    tests = {"A": F.col("n_words") < 200, "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"), "C": F.col("c"), "D": F.col("d")}
    return got.select("doc_id", "part", "text_id", F.concat(*[F.when(t, k).otherwise("") for k, t in tests.items()]).alias("fails"))


def profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (letters among ABCDE), good, toxic and n: the documents by what they fail."""
    marked = stored(failures(docs), "failures")
    rows = marked.groupBy("text_id", "part", "fails", "doc_id").agg(F.count("*").alias("c"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    labelled = hot_join(rows.where("doc_id is not null"), known, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    labelled = labelled.select("text_id", "part", "fails", "doc_id", "c", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    each = labelled.groupBy("text_id", "part", "fails", "good", "toxic").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("free"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("at_least"))
    each = each.withColumn("first", F.min("least").over(Window.partitionBy("text_id")))  # rows by part and label
    fine = F.col("free") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("fails"), fine.alias("n")), F.struct(F.concat("fails", F.lit("E")).alias("fails"), (F.col("n") - fine).alias("n")))
    return each.select("part", "good", "toxic", F.inline(both)).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, with the counts of what the step does."""
    steps = profile(docs, labels).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("failed", F.expr("fails like concat('%', filter, '%')"))
    steps = steps.withColumn("gone", F.expr("translate(fails, substring(filter_order, 1, step - 1), '') <> fails"))
    count = lambda where, name: F.sum(F.when(where, F.col("n")).otherwise(0)).alias(name)
    here = F.col("failed") & ~F.col("gone")
    got = steps.groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("failed") & ~F.col("gone"), "kept"),
        count(here, "removed"),
        count(F.col("failed") & F.col("gone"), "redundant"),
        count(F.col("fails") == F.col("filter"), "unique_fails"),
        count(here & F.col("good"), "good_lost"),
        count(here & F.col("toxic"), "toxic_lost"),
    )
    return got.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")  # 120 rows each


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS txt FROM documents),
words AS (SELECT *, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS w FROM d),
firsts AS (SELECT txt, min(doc_id) AS least FROM d GROUP BY txt),
marks AS (
  SELECT words.doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(words.txt, '[^A-Z]', '', 'g')) > 3 * length(words.txt) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(words.txt, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN words.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM words JOIN firsts USING (txt)),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
prof AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM marks LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT part, filter_order, s.step, n, good, toxic, fails, filter_order[s.step] AS f, contains(fails, filter_order[s.step]) AS failed,
    length(translate(fails, filter_order[1:s.step - 1], '')) < length(fails) AS gone
  FROM prof, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
summed AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT failed AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed AND NOT gone AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT gone AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
