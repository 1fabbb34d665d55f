import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fieldspark.llm import lm_score
from fieldspark.llm.common import filled

from .data import edge_texts, frame, rows


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Brute:
    def __init__(self, texts):
        self.c, self.uni = Counter(), Counter()
        for t in texts:
            w = split(t)
            self.c.update(zip(["<s>", *w], w))
            self.uni.update(w)
        self.context, self.kinds, self.cc = Counter(), defaultdict(Counter), Counter()
        for (v, w), n in self.c.items():
            self.context[v] += n
            self.kinds[v][min(n, 3)] += 1
            self.cc[w] += 1
        of = lambda c: lm_score.discounts(*(sum(n == k for n in c.values()) for k in (1, 2, 3, 4)))
        self.d2, self.d1 = of(self.c), of(self.cc)

    def lower(self, w):
        types, n = len(self.cc), len(self.c)
        if not n:
            return 1 / (types + 1)
        left = sum(self.d1[min(x, 3)] for x in self.cc.values()) / n
        return max(self.cc[w] - self.d1[min(self.cc[w], 3)], 0) / n + left / (types + 1)

    def p(self, v, w):
        if not self.context[v]:
            return self.lower(w)
        left = sum(self.d2[k] * n for k, n in self.kinds[v].items())
        return max(self.c[v, w] - self.d2[min(self.c[v, w], 3)], 0) / self.context[v] + left / self.context[v] * self.lower(w)

    def score(self, text):
        w = split(text)
        n, v = sum(self.uni.values()), len(self.uni)
        base = sum(math.log10((self.uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        return len(w), sum(self.uni[x] > 0 for x in w), base, sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *w], w))


def test_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in rows(spark)] + [(1000 + i, t) for i, t in enumerate(edge_texts() + ["De " * 1000, "De " * 999])]
    out = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    brute = Brute([t for i, t in docs if i not in out])
    df = frame(spark, docs).repartition(3).select("doc_id", filled("text").alias("text"))
    assert {r[0] for r in df.where(lm_score.held_out()).select("doc_id").collect()} == out
    model = lm_score.train(df.where(~lm_score.held_out()))
    assert model.total == sum(brute.uni.values()) and model.types == len(brute.uni)
    for r in lm_score.score(df, model).collect():
        want = brute.score(dict(docs)[r.doc_id])
        assert (r.n_tokens, r.n_known) == want[:2]
        assert math.isclose(r.base_score, want[2], rel_tol=1e-9) and math.isclose(r.score, want[3], rel_tol=1e-9)


def test_missing_files_raise(spark):
    import os

    import pytest

    docs = frame(spark, ["a b a c", "a b", "c c d"])
    model = lm_score.train(docs.select("text"))
    want = [r.score for r in lm_score.score(docs, model).orderBy("doc_id").collect()]
    some = next(f for f in os.listdir(model.folder) if f.startswith("rest-"))
    os.remove(f"{model.folder}/{some}")
    with pytest.raises(Exception, match="No such file"):
        lm_score.score(docs, model).collect()
    assert all(x < 0 for x in want)


def test_hot_words_spread_over_shards():
    import numpy as np

    v, w = np.full(4000, 7, np.uint64), np.arange(4000, dtype=np.uint64)
    spread = np.bincount(lm_score.pair_shard(v, w, 40, np.array([7], np.uint64)), minlength=40)
    assert spread.max() < 2 * spread.mean() and spread.min() > 0
    assert len(set(lm_score.pair_shard(v, w, 40, np.array([8], np.uint64)))) == 1


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "a b", "c c d", "b a b a b"]
    brute = Brute(texts)
    words = [*brute.uni, "unknown"]
    for v in ["<s>", "a", "b", "c", "zzz"]:
        assert math.isclose(sum(brute.p(v, w) for w in words), 1, rel_tol=1e-9)


def test_held_out_text_is_better_than_unigrams(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm_score.train(df.where(~lm_score.held_out()).select("text"))
    r = lm_score.score(df.where(lm_score.held_out()), model).agg(F.sum("score"), F.sum("base_score"), F.max("score")).first()
    assert r[0] > r[1] and r[2] < 0


def test_odd_tables(spark):
    docs = frame(spark, [(None, "a b"), (1, None), (1, "a b")]).withColumn("score", F.lit(1))
    none = lm_score.train(docs.limit(0).select("text"))
    got = lm_score.score(docs, none, keep=("lang", "score")).collect()
    assert [(r.n_tokens, r.n_known, r.score) for r in got] == [(3, 0, 0.0), (1, 0, 0.0), (3, 0, 0.0)]
    assert lm_score.score(docs.limit(0), lm_score.train(docs.select("text"))).count() == 0
