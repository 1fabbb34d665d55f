import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa

from fieldspark.llm.filter_audit import ORACLE, audit, row_stats, term_matrix
from fieldspark.llm.vocabulary import coded

from .data import SF, edge_texts, frame, rows

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, labels):
    """(part, order, step) -> counts; docs: (doc_id, text, lang)."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    by_text = {}
    for i, t, _ in docs:
        by_text.setdefault(t or "", []).append(i)
    marked = []
    for i, t, lang in docs:
        w, t = words(t), t or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i for j in by_text[t])}
        marked.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                before = set(order[:s])
                here = [m for m in own if f in m[1] and not m[1] & before]
                shapley[f] += len(here)
                out[part, "".join(order), s + 1] = [sum(not m[1] & (before | {f}) for m in own), len(here), sum(f in m[1] and bool(m[1] & before) for m in own), sum(m[1] == {f} for m in own), sum(m[2] for m in here), sum(m[3] for m in here)]
        for (p, order, s), v in out.items():
            if p == part:
                v.append(shapley[order[s - 1]])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in df.collect()}


def odd(spark):
    rng = random.Random(3)
    many = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    texts = [*edge_texts(), many(300, 9), many(300, 900), many(250, 40) + " 5 %", ("LOUD " * 300).strip(), "A" * 3 + "é" * 97, "A" * 4 + "é" * 96, "\x00 a \x0b b", many(300, 900).upper()]
    docs = [(100 + k, t) for k, t in enumerate(texts)] + [(7, texts[-1]), (7, texts[-1]), (None, texts[-1]), (8, "one"), (9, None), (None, "one"), (7, "other")]
    docs += [(1000 + k, "the same text") for k in range(700)]
    rng.shuffle(docs)
    return [(i, t, rng.choice(["en", "de", None, ""])) for i, t in docs]


def test_against_brute_force(spark):
    docs = odd(spark)
    labels = [(7, 1, 1), (7, 0, None), (8, None, 1), (100, 1, 0), (None, 1, 1), (99999, 1, 1), *[(1000 + k, k % 2, k % 3 == 0) for k in range(300)]]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' as part", "1 as fails", "2 as number", "3 as words").repartition(5)
    assert got(audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == brute(docs, labels)


def test_provided_tables_and_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    res = con.execute(ORACLE)
    names = [c[0] for c in res.description]
    want = {tuple(r[names.index(c)] for c in ("part", "filter_order", "step")): [r[names.index(c)] for c in COLUMNS] for r in res.fetchall()}
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    mine = got(audit(docs, labels))
    assert mine == want == brute([r[:3] for r in rows(spark)], rows(spark, "labels"))
    assert len(mine) == 600 * docs.select("lang").distinct().count()


def test_matrix(spark):
    """An index means one word in all shards, whatever the shards, and every word has one."""
    docs = [(i, t, None) for i, t in enumerate(edge_texts())] + [(i, r[1], None) for i, r in enumerate(rows(spark)[:40], 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    matrix = term_matrix(df, ("doc_id",)).collect()
    assert len(matrix) == 3
    meaning = {}
    text = {i: t for i, t, _ in docs}
    for shard in matrix:
        starts, indices, counts = np.frombuffer(shard.starts, np.int64), np.frombuffer(shard.indices, np.int64).tolist(), np.frombuffer(shard.counts, np.int32).tolist()
        for k, doc in enumerate(shard.docs):
            a, b = starts[k : k + 2]
            own = Counter(words(text[doc.doc_id]))
            assert sorted(counts[a:b]) == sorted(own.values()) and len(set(indices[a:b])) == b - a
            for n, c in zip(indices[a:b], counts[a:b]):
                same = {w for w in own if own[w] == c}
                meaning[n] = meaning[n] & same if n in meaning else same
    every = {w for t in text.values() for w in words(t)}
    assert len(meaning) == len(every) and all(meaning.values())
    stats = {r.doc_id: (r.n_words, r.n_distinct) for r in row_stats(term_matrix(df, ("doc_id",))).collect()}
    assert stats == {i: (len(words(t)), len(set(words(t)))) for i, t in text.items()}


def test_codes_are_exact():
    texts = ["b a b", None, "", "a  c", "\n", "cc c"]
    parts = list(coded(pa.array(texts), most=2))
    assert len(parts) > 3 and [w for p in parts for w in (p.words[c].as_py().decode() for c in p.codes.tolist())] == [w for t in texts for w in words(t)]
    for part in coded(pa.array(texts)):
        assert [part.words[c].as_py().decode() for c in part.codes.tolist()] == [w for t in texts for w in words(t)]
        assert part.first.tolist() == [0, 3, 3, 3, 5, 5, 7]


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(none, labels).count() == 0
    assert got(audit(frame(spark, ["x", None]), labels)) == brute([(0, "x", "en"), (1, None, "en")], [])
