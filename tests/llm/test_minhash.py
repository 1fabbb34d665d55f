import random
import re

import numpy as np
from pyspark.sql import functions as F

from fieldspark.llm import minhash
from fieldspark.llm.components import components

from .data import edge_texts, frame, rows


def sets(docs, n):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    return out


def brute(docs, n):
    own = sets(docs, n)
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(own[i] & own[j])
            if both and 100 * both >= 80 * (len(own[i]) + len(own[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(own[i]), find(i)) for i in ids}


def variants(seed, groups=12):
    """Chains and stars of edited texts, many near the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 14)):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            out.append(" ".join(new))
            if rng.random() < 0.4:
                base = new
    rng.shuffle(out)
    return out


def test_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in rows(spark)] + [(1000 + i, t) for i, t in enumerate(edge_texts() + variants(3))]
    for n in (2, 5):
        got = minhash.near_duplicates(frame(spark, docs).repartition(3), n=n).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, n)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hot_group_in_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 3)
    docs = list(enumerate(variants(9, 4)))
    got = minhash.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 2)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    same = np.mean([(minhash.signature(np.sort(pool[:1200] + np.uint64(k))) == minhash.signature(np.sort(pool[150:1350] + np.uint64(k)))).mean() for k in range(40)])
    assert abs(same - (1050 / 1350) ** minhash.ROWS) < 0.05


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)] + [(200, i) for i in range(201, 260)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: r for x, r in root.items() if x in got} and all(r == x for x, r in root.items() if x not in got)


def test_odd_tables(spark):
    docs = frame(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (6, "A  b\nc"), (7, None), (8, " ")]).withColumn("digest", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 0, 7, True), (8, 0, 8, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    """Links of every text of an id are kept, and its texts share a component."""
    a, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "ac")
    four = [(1, a), (1, c), (2, a + " x"), (3, c + " y")]
    got = minhash.near_duplicates(frame(spark, four)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 59, 1, True), (1, 59, 1, True), (2, 60, 1, False), (3, 60, 1, False)]
    rng = random.Random(6)
    texts = variants(21, 8) + ["", None, "one"]
    docs = [(None if rng.random() < 0.05 else rng.choice([k, k, rng.randrange(12)]), t) for k, t in enumerate(texts)]
    docs += docs[:5]
    alone = sets(enumerate(t for _, t in docs), 2)
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, _) in enumerate(docs):
        for m, (j, _) in enumerate(docs[:k]):
            both = len(alone[k] & alone[m])
            if i is not None and j is not None and both and 100 * both >= 80 * (len(alone[k]) + len(alone[m]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted((i if i is not None else -1, len(alone[k]), -1 if i is None and alone[k] else i if not alone[k] and i is not None else -1 if i is None else find(i)) for k, (i, _) in enumerate(docs))
    got = minhash.near_duplicates(frame(spark, docs).repartition(3)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
