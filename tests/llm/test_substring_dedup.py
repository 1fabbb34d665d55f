import hashlib
import random
import re

import numpy as np

from pyspark.sql import functions as F

from fieldspark.llm import substring_dedup
from fieldspark.llm.substring_dedup import dedup_substrings

from .data import edge_texts, frame, rows


def brute(docs, n=13):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][k : k + n]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def mixed(seed):
    """Texts that share passages of about 13 words, from several sources, at changing places."""
    rng = random.Random(seed)
    pool = [f"W{i}" for i in range(60)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(11, 40))] for _ in range(12)]
    out = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 4)
            w += p[a : rng.randint(a, len(p))] + [rng.choice(pool) for _ in range(rng.randint(0, 6))]
        out.append("  ".join(w))
    return out + ["De " * 50, "x " + "De " * 20, "De " * 12]


def test_against_brute_force(spark, monkeypatch):
    docs = [(r[0], r[1]) for r in rows(spark)] + [(1000 + i, t) for i, t in enumerate(edge_texts() + mixed(1))]
    for size in (substring_dedup.LOCAL_BYTES, 2000):
        monkeypatch.setattr(substring_dedup, "LOCAL_BYTES", size)
        got = dedup_substrings(frame(spark, docs).repartition(5))
        got = {r[0]: tuple(r[1:]) for r in got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()}
        assert got == brute(docs)
        assert sum(v[1] > 0 for v in got.values()) > 30


def test_frequent_seeds_and_hot_passage(spark, monkeypatch):
    """A passage in most documents, in many chunks of a task; with and without frequent seeds the result is the same."""
    rng = random.Random(6)
    passage = " ".join(f"P{i}" for i in range(30))
    own = lambda: " ".join(f"W{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20)))
    docs = [(i, f"{own()} {passage} {own()}" if i % 3 else f"{own()} P3 P4 P5 P6 P7 {own()}") for i in range(400)]
    docs = docs[200:] + docs[:200]
    monkeypatch.setattr(substring_dedup, "LOCAL_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "SPANS", 50)
    frame_ = frame(spark, docs).repartition(2)
    assert len(substring_dedup.frequent_seeds(frame_)) >= 26
    for least in (10, 10**9):
        monkeypatch.setattr(substring_dedup, "FREQUENT", least)
        got = dedup_substrings(frame_)
        assert {r[0]: tuple(r[1:]) for r in got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()} == brute(docs)


def test_a_task_sends_a_hot_passage_about_once():
    """Of a passage in every chunk of a task only the first chunk sends phrases, whatever the number of chunks."""
    rng = np.random.default_rng(1)
    passage, known, sent = rng.integers(0, 1 << 63, 40, dtype=np.uint64), substring_dedup.Known(), []
    for chunk in range(20):
        h = np.concatenate([np.r_[passage, rng.integers(0, 1 << 63, 3, dtype=np.uint64)] for _ in range(10)])
        ids = np.arange(10) + 10 * chunk
        rows_ = list(substring_dedup._chunk(h, np.arange(0, len(h) + 1, 43), ids, ids, 13, 4, np.zeros(0, np.uint64), known))
        sent.append(sum(len(r["phrase"]) // 8 for r in rows_ if r["block"] >= 0))
    assert sent[0] >= 28 + 30 and max(sent[1:]) == 30


def test_no_false_factors_within_one_minimiser():
    """A million different phrases of one minimiser, as block rows that come back from their packed form."""
    n = 1_000_000
    phrase = np.random.default_rng(2).integers(0, 1 << 64, n, dtype=np.uint64)
    phrase[-3:] = phrase[:3]
    some = {"id": np.arange(n), "print": np.zeros(n, np.int32), "start": np.zeros(n, np.uint32), "size": np.ones(n, np.uint16), "seed": np.full(n, 9, np.uint16), "phrase": phrase}
    ids, _, start, size = substring_dedup._parsed(some, 13)
    assert sorted(ids.tolist()) == [n - 3, n - 2, n - 1] and set(start.tolist()) == {0} and set(size.tolist()) == {13}
    for x in (np.arange(300, dtype=np.uint32), np.array([-5, 1 << 40, 7], np.int64), np.zeros(0, np.uint16)):
        assert (substring_dedup.unplaned(substring_dedup.planes(x), x.dtype) == x).all()


def test_odd_tables(spark):
    text = " ".join(map(str, range(20)))
    docs = frame(spark, [(None, text), (5, text), (5, "a " + text), (6, text), (7, None)]).withColumn("n_words", F.lit(1)).withColumn("spans", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in dedup_substrings(docs, keep=("n_words", "spans")).collect())
    assert got == [(0, 20, 0), (5, 20, 0), (5, 21, 0), (6, 20, 20), (7, 0, 0)]
    assert dedup_substrings(docs.limit(0)).count() == 0
