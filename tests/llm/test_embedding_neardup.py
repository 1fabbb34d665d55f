import numpy as np

from fieldspark.llm import components as C
from fieldspark.llm import embedding_neardup as E

from .data import SF

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, cosine=0.95):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(ids))])
        if (new == label).all():
            return {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
        label = new


def check(spark, rows):
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_provided_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(spark, rows)


def test_hot_group_and_chains(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    rows = [(1000 - i, (base * rng.uniform(0.1, 9) + rng.standard_normal(32) * 0.01).tolist()) for i in range(700)]
    a, b = np.eye(32)[:2]
    rows += [(2000 + i, (np.cos(t) * a + np.sin(t) * b).tolist()) for i, t in enumerate(np.arange(0, 1.5, 0.2))]
    rows += [(3000 + i, rng.standard_normal(32).tolist()) for i in range(100)]
    check(spark, rows)


def test_many_equal_vectors(spark):
    """Copies are one class; scaled ones may be others, and ids may repeat with other vectors."""
    rng = np.random.default_rng(8)
    base, far = rng.standard_normal((2, 16))
    rows = [(5000 - i, base.tolist()) for i in range(1500)] + [(6000 + i, (base * 3).tolist()) for i in range(300)] + [(i, far.tolist()) for i in range(20)]
    rows += [(100 + i, (base + rng.standard_normal(16) * 0.02).tolist()) for i in range(40)]
    check(spark, rows)


def test_lengths_do_not_meet(spark):
    """Vectors of two lengths, with copies: their links are found beside each other."""
    rng = np.random.default_rng(2)
    rows = []
    for dims, first in ((8, 0), (12, 1000)):
        base = rng.standard_normal(dims)
        rows += [(first + i, (base + rng.standard_normal(dims) * 0.01).tolist()) for i in range(60)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (59, i // 1000 * 1000) for i, _ in rows}


def test_bridges_inside_a_unit(spark, monkeypatch):
    """A path whose middle link is neither end's smallest."""
    angle = [0.0, 0.25, 0.5, 0.75]
    for ids in ([10, 5, 20, 3], [1, 4, 3, 2], [3, 1, 2, 0]):
        check(spark, [(i, [float(np.cos(t)), float(np.sin(t)), 0.0]) for i, t in zip(ids, angle)])


def test_passes_and_cut_buckets(spark, monkeypatch):
    """One table a pass, and buckets cut into chunks of 16: every pair counts once."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((3, 24))
    rows = [(i, (base[i % 3] + rng.standard_normal(24) * rng.choice([0.02, 0.25])).tolist()) for i in range(260)]
    rows += [(1000 + i, rng.standard_normal(24).tolist()) for i in range(60)]
    for name, value in (("CHUNK", (16, 16)), ("TILE", 8), ("PAIRS", 50), ("PASS", 1), ("LEAST", 1), ("PART", 4096)):
        monkeypatch.setattr(E, name, value)
    vectors = spark.createDataFrame([(i, i, 1, v) for i, v in rows], "uid long, vec_id long, m long, vector array<float>")
    assert E._to_cut(vectors, len(rows), *E.shape(len(rows), 0.95))
    check(spark, rows)


def test_tables_and_plans_do_not_grow(spark, tmp_path):
    """0.6 GB are some 1.5 million vectors: few tables hold them, and the rounds of links broadcast nothing."""
    assert E.shape(1_500_000, 0.95)[1] <= 50 and E.shape(1_000_000_000, 0.95)[1] <= 200
    spark.range(1000).selectExpr("id + 1 as a", "id as b").write.parquet(str(tmp_path / "links"))
    plans = [f(spark.read.parquet(str(tmp_path / "links")), "merge")._jdf.queryExecution().executedPlan().toString() for f in (C._large, C._small)]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_recall_at_the_threshold():
    k, tables = E.shape(5000, 0.95)
    t = E.Tables(16, k, tables)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((2000, 16))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * y
    assert (t.keys(x) == t.keys(y)).any(1).mean() > 0.998


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, []), (8, [float("inf"), 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", uid int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in E.near_duplicates(docs).collect())
    assert got == [(0, 0, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), *[(k, 0, k) for k in range(3, 10)]]
    assert E.near_duplicates(docs.limit(0)).count() == 0
