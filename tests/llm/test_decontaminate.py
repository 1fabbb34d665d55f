import random
import re

from pyspark.sql import functions as F

from fieldspark.llm.decontaminate import Phrases, _shard, decontaminate, suffix_array

from .data import edge_texts, frame, rows
import numpy as np
import pyarrow as pa

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    phrases = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - n + 1)):
            if w:
                phrases.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes, out = {len(p) for p in phrases}, []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (p := tuple(w[k : k + size])) in phrases:
                    hit |= set(range(k, k + size))
                    found |= phrases[p]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(50):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 30))] + [0])
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_shards_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        docs = [(i, " ".join(rng.choice("abcdexyz") for _ in range(rng.randint(0, 40)))) for i in range(20)]
        items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 6)))) for i in range(6)]
        got = _shard(pa.array([t for _, t in docs]), [Phrases([(str(i), t) for i, t in items[:3]], 3), Phrases([(str(i), t) for i, t in items[3:]], 3)])
        for (i, n, hit, found), (_, t), g in zip(brute(docs, items, 3), docs, got.to_pylist()):
            assert (n, hit, found) == (g["n_words"], g["n_hit"], g["items"])
            assert len(g["text"].split()) == n - hit


def test_table_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in rows(spark)] + [(1000 + i, t) for i, t in enumerate(edge_texts())]
    items = [tuple(r) for r in rows(spark, "benchmark")] + [(777, "Alpha?"), (778, None), (779, "!!"), (780, edge_texts()[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 300):
        got = decontaminate(frame(spark, docs).repartition(3), bench, block_bytes=size)
        got = sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items").collect())
        assert got == sorted(brute(docs, items, 10))
        assert sum(r[2] > 0 for r in got) > 3


def test_odd_tables(spark):
    bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    docs = frame(spark, [(None, "q X, y z"), (1, None), (1, "x")]).withColumn("items", F.lit(3))
    got = {(r.doc_id, r.text, r.n_hit) for r in decontaminate(docs, bench, keep=("items", "lang")).collect()}
    assert got == {(None, "q \n z", 2), (1, "", 0), (1, "x", 0)}
    assert {(r.doc_id, r.text, r.n_hit) for r in decontaminate(docs, bench, block_bytes=1, keep=("items",)).collect()} == got
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_passes_give_the_same(spark):
    """Many small blocks, overlapping spans of several, repeated rows and an item without an id."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdexyz") + rng.choice(" .,") for _ in range(rng.randint(0, 60)))) for i in range(40)] * 2
    items = [(None if i == 3 else i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 8)))) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontaminate(frame(spark, docs), bench, n=3, block_bytes=size).collect())) for size in (1 << 20, 15))
    assert one == many and any("n_hit=0" not in r for r in one)
    lone = decontaminate(frame(spark, ["x a b c y"]), spark.createDataFrame([(None, "a b c")], "item_id long, text string"), n=3).first()
    assert (lone.n_hit, lone["items"]) == (3, [])
