import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldspark.llm import language_id
from fieldspark.llm.language_id import BACKOFF, NOISE, held_out, mixtures, predict, proportions, train
from fieldspark.llm.queries import op11_language_id

from .data import SF, edge_texts, frame

WORD = re.compile(r"[a-z\x80-\U0010FFFF]+")


def words(text):
    return WORD.findall((text or "").lower())


def slow_model(docs):
    """Exact n-gram counts by language; log likelihood of a word."""
    grams, contexts = {}, {}
    for lang, text in docs:
        g, c = grams.setdefault(lang, Counter()), contexts.setdefault(lang, Counter())
        for w in words(text):
            s = b"\1\1\1" + w.encode() + b"\2"
            for i in range(3, len(s)):
                for n in range(1, 5):
                    g[n, s[i - n + 1 : i + 1]] += 1
                    c[n, s[i - n + 1 : i]] += 1

    def score(lang, w):
        s, out = b"\1\1\1" + w.encode() + b"\2", 0.0
        for i in range(3, len(s)):
            p = (grams[lang][1, s[i : i + 1]] + 0.1) / (contexts[lang][1, b""] + 25.6)
            for n in range(2, 5):
                p = (grams[lang][n, s[i - n + 1 : i + 1]] + BACKOFF * p) / (contexts[lang][n, s[i - n + 1 : i]] + BACKOFF)
            out += math.log(p)
        return out

    return score


TEXTS = [("aa", "The theme of the day, THE end."), ("aa", "then there"), ("bb", "Über die Öfen und die Ämter"), ("bb", "und der"), ("cc", "que la"), (None, "lost"), ("aa", None)]


def test_likelihoods_against_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "lang string, text string").repartition(3)
    model = train(df)
    known = [d for d in TEXTS if d[0]]
    slow = slow_model(known)
    assert model.names == ["aa", "bb", "cc"] and model.words.tolist() == [len([w for k, t in known if k == x for w in words(t)]) for x in model.names]
    some = sorted({w for _, t in TEXTS for w in words(t)} | {"zzz", "ü", "x" * 300})
    got = model.log_likelihood(pa.array([w.encode() for w in some], pa.large_binary()))
    for w, row in zip(some, got):
        for lang, x in zip(model.names, row):
            assert math.isclose(x, slow(lang, w), rel_tol=1e-4), (lang, w)
        assert math.isclose(row[-1], NOISE * (len(w.encode()) + 1))


def test_proportions_against_brute_force():
    rng = np.random.default_rng(1)
    p, n, starts = rng.random((40, 3)), rng.integers(1, 5, 40).astype(float), np.array([0, 1, 17])
    share, likelihood = proportions(p, n, starts, 0.1, rounds=7)
    for k, (a, b) in enumerate(zip(starts, [1, 17, 40])):
        q = [1 / 3] * 3
        for _ in range(7):
            last = q
            got = [0.1] * 3
            for i in range(a, b):
                s = sum(q[j] * p[i, j] for j in range(3))
                for j in range(3):
                    got[j] += n[i] * q[j] * p[i, j] / s
            q = [g / sum(got) for g in got]
        assert np.allclose(share[k], q)
        assert math.isclose(likelihood[k], sum(n[i] * math.log(sum(last[j] * p[i, j] for j in range(3))) for i in range(a, b)))


def test_held_out_accuracy_and_mixtures(spark):
    """Documents that were held out, and documents made of two languages."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op11_language_id(spark, sf).collect()}
    truth = docs.select("doc_id", "lang", "text", held_out().alias("out")).collect()
    assert len(got) == len(truth) and {i for i, r in got.items() if r.held_out} == {r.doc_id for r in truth if r.out}
    held = [r for r in truth if r.out and re.search(r"[^\W\d_]", r.text or "")]
    right = [got[r.doc_id].lang_pred == r.lang for r in held]
    assert sum(right) / len(right) > 0.98, (sum(right), len(right))
    long = {lang: next(r.text for r in held if r.lang == lang and len(r.text) > 3000) for lang in ("de", "fr", "en")}
    cut = lambda lang, n: " ".join(long[lang].split()[:n])
    model = train(docs.where(~held_out()))
    mixed = predict(frame(spark, [cut("de", 300) + " " + cut("fr", 100), cut("fr", 200) + " " + cut("de", 200) + " " + cut("en", 200), cut("fr", 300)]), model, keep=("doc_id",))
    a, b, c = (r.langs for r in mixed.orderBy("doc_id").collect())
    assert [x.lang for x in a] == ["de", "fr"] and abs(a[0].share - 0.75) < 0.06 and abs(a[1].share - 0.25) < 0.06
    assert {x.lang for x in b} == {"de", "en", "fr"} and all(abs(x.share - 1 / 3) < 0.06 for x in b)
    assert [x.lang for x in c] == ["fr"] and c[0].share > 0.9


def test_short_texts_and_case(spark):
    rng = random.Random(2)
    vocabulary = {"en": "the and of that with which this".split(), "de": "der und die das mit welche dieser".split()}
    docs = [(k, " ".join(rng.choice(vocabulary[x]) for _ in range(30)), x) for k, x in enumerate(["en", "de"] * 20)]
    model = train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    texts = ["the", "UND", "Die 77 %% das", "with!!THIS!!"]
    got = [r.lang_pred for r in predict(frame(spark, texts), model, keep=("doc_id",)).orderBy("doc_id").collect()]
    assert got == ["en", "de", "de", "en"]


def test_odd_rows(spark):
    texts = [(k, t) for k, t in enumerate(edge_texts())] + [(None, "und"), (3, "12 34 !"), (3, "😀 ₣"), (4, "ª"), (5, "x" * 100_000), (6, "the " * 50_000)]
    df = frame(spark, texts).selectExpr("*", "'q' as score", "1 as langs").repartition(3)
    model = train(spark.createDataFrame(TEXTS, "lang string, text string"))
    want = predict(df, model, keep=("doc_id", "text", "score")).collect()
    assert df.count() == len(want)
    for r in want:
        some = bool(re.search(r"[^\W\d_]", r.text or ""))
        assert (r.lang_pred == "und") == (not some) and 0 <= r.score <= 1 and bool(r.langs) == some
    column = pa.array([t or "" for t in edge_texts()])
    found = [{row + part.a + i: [(k, round(x, 9)) for k, x in v] for row, part in language_id._lowered(column, most) for i, v in mixtures(model, part)} for most in (60, 1 << 22)]
    assert found[0] == found[1] and found[0]  # parts change nothing
    none = train(df.limit(0))
    assert none.names == [] and {r.lang_pred for r in predict(df, none).collect()} == {"und"}
    assert predict(df.limit(0), model).count() == 0
    many = spark.range(300).selectExpr("cast(id as string) as lang", "'a' as text")
    with pytest.raises(ValueError):
        train(many)


def test_query_learns_only_from_its_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 'xx' else lang end as lang", "source", "n_chars")
    changed.union(spark.sql("select null, 'der', 'yy', 's', 3L")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_language_id(spark, str(tmp_path)).collect()}
    same = {r.doc_id: r for r in op11_language_id(spark, SF).collect()}
    assert got.pop(None).held_out is False
    assert got == same and not {"xx", "yy"} & {r.lang_pred for r in got.values()}
