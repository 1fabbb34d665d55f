import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from fieldspark.llm import quality
from fieldspark.llm.quality import classify, features, kth_largest

from .data import edge_texts, frame, rows

LABELS = "doc_id long, quality int, toxic int"


def tokens(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[^0-9A-Za-z\x80-\U0010FFFF\x20\x09-\x0D]+", text or "")


def test_features_are_tokens_and_pairs():
    texts = [t or "" for t in edge_texts()] + ["a,b ...é! x\x00y"]
    seen = {}
    for text, f in zip(texts, features(pa.array(texts))):
        w = tokens(text)
        names = [(x,) for x in w] + list(zip(w, w[1:]))
        assert len(names) == len(f)
        for name, x in zip(names, f.tolist()):
            assert seen.setdefault(name, x) == x


def test_weights_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in rows(spark)] + [(1000 + i, t) for i, t in enumerate(edge_texts())]
    labels = [tuple(r) for r in rows(spark, "labels")] + [(1001, 1, None), (1004, 1, 0), (None, 1, 0)]
    good = {i for i, q, t in labels if q == 1 and not t and i is not None}
    raw, target, own = Counter(), Counter(), {}
    for (i, t), f in zip(docs, features(pa.array([t or "" for _, t in docs]))):
        own[i] = f.tolist()
        raw.update(own[i])
        if i in good:
            target.update(own[i])
    nr, nt = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = {f: math.log((target[f] + 1) / nt) - math.log((raw[f] + 1) / nr) for f in raw}
    got = classify(frame(spark, docs).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    weight = {}
    for r in got:
        weight[r.doc_id] = r.log_weight
        assert math.isclose(r.log_weight, quality.SCALE * sum(ratio[f] for f in own[r.doc_id]) / (len(own[r.doc_id]) + quality.PRIOR), abs_tol=1e-9)
    known = sorted((round(weight[i] * 1e6) for i in good if i in weight), reverse=True)
    floor = known[math.ceil(0.999 * len(known)) - 1]
    k = sum(round(w * 1e6) >= floor for w in weight.values())
    best = sorted(got, key=lambda r: -r.gumbel_key)[:k]
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in best}


def test_held_out_accuracy(spark):
    """Fitted on half of the labels, it keeps nearly all good documents of the other half and few bad ones."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("hash(doc_id) % 2 = 0"))
    share = dict(got.join(labels.where("hash(doc_id) % 2 <> 0"), "doc_id").groupBy("quality").agg({"kept": "count"}).collect())
    kept = dict(got.where("kept").join(labels.where("hash(doc_id) % 2 <> 0"), "doc_id").groupBy("quality").count().collect())
    assert kept[1] / share[1] > 0.99
    assert kept.get(0, 0) / share[0] < 0.1


def test_toxic_documents_go(spark):
    """Fitted on half of the labels, it drops most toxic documents of good quality of the other half and few others."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("hash(doc_id) % 2 = 0"), reject_toxic=True)
    held = got.join(labels.where("hash(doc_id) % 2 <> 0 and quality = 1"), "doc_id").groupBy("toxic").count()
    total = dict(held.collect())
    kept = dict(got.where("kept").join(labels.where("hash(doc_id) % 2 <> 0 and quality = 1"), "doc_id").groupBy("toxic").count().collect())
    shares = f"held out: {total} kept: {kept}"
    assert kept.get(1, 0) / total[1] < 0.15, shares
    assert kept[0] / total[0] > 0.98, shares


def test_toxic_marks_by_hand(spark):
    """A marked word counts in a long text and in capitals; frequent harmless words do not."""
    rng = random.Random(4)
    plain = lambda n: " ".join(rng.choice("red green blue grey pink".split()) for _ in range(n))
    docs = [(i, plain(30)) for i in range(60)] + [(100 + i, plain(30) + " vile " + plain(5)) for i in range(20)]
    docs += [(200, plain(3000) + " VILE " + plain(3000)), (201, plain(6000)), (None, "vile")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(20)] + [(None, 1, 1), (201, 1, None)], LABELS)
    kept = {r.doc_id: r.kept for r in classify(frame(spark, docs), labels, reject_toxic=True).collect()}
    assert not any(kept[i] for i in [*range(100, 120), 200, None])
    assert sum(kept[i] for i in [*range(60), 201]) >= 60


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.randint(-(10**15), 10**15), rng.randint(-3, 3), 7]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "key long").cache()
    for k in (1, 2, 250, 499, 500):
        assert kth_largest(df, k) == sorted(values)[-k]


def test_gumbel_noise(spark):
    x = np.array([r[0] for r in spark.range(20000).select(quality.gumbel("id")).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.std() - math.pi / math.sqrt(6)) < 0.05


def test_odd_tables(spark):
    docs = frame(spark, [(None, "x y"), (1, None), (1, "x"), (2, "y")])
    labels = spark.createDataFrame([], LABELS)
    got = classify(docs, labels, keep=("kept", "text", "lang"))
    assert got.columns == ["doc_id", "log_weight", "gumbel_key", "kept", "text", "lang"]
    assert [r.kept for r in got.collect()] == [True] * 4
    one = spark.createDataFrame([(2, 1, 0)], LABELS)
    assert classify(docs, one).count() == 4
    assert classify(docs.limit(0), one).count() == 0
