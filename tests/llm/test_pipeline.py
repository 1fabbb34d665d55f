import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

from .data import SF
from .test_decontaminate import brute as leaks
from .test_line_dedup import brute as repeated
from .test_minhash import brute as groups


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    one = stages["quality"](spark, docs, SF).cache()
    assert one.columns == columns and 0 < one.count() < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert labels.where("quality = 1 and toxic = 0").join(one, "doc_id", "left_anti").count() <= 1

    two = stages["line_dedup"](spark, one, SF).cache()
    want = repeated(pairs(one))
    assert two.columns == columns and sum(v[1] for v in want.values()) > 0
    assert {i: len(t.split("\n")) for i, t in pairs(two)}.items() <= {i: v[0] - v[1] for i, v in want.items()}.items()

    three = stages["minhash"](spark, two, SF).cache()
    want = groups(pairs(two), 5)
    assert three.columns == columns and {i for i, _ in pairs(three)} == {i for i, (_, c) in want.items() if i == c}

    four = stages["decontaminate"](spark, three, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in leaks(pairs(three), items, 10) if r[2]}
    assert four.columns == columns and hit and not any(r[2] for r in leaks(pairs(four), items, 10))
    before = dict(pairs(three))
    assert all(t == before[i] for i, t in pairs(four) if i not in hit)
    assert all(r.n_chars == len(r.text) for r in four.collect())

    five = stages["packing"](spark, four, SF)
    assert {r.doc_id for r in five.collect()} == {i for i, _ in pairs(four)}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_recall_of_near_copies(spark):
    """Of pairs of edited copies at five-word similarities around the threshold, those at 0.8 or more lose one document."""
    import random

    from .data import frame
    from .test_minhash import sets

    rng = random.Random(12)
    docs = []
    for k in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 300))]
        new = list(base)
        for _ in range(rng.randint(0, len(base) // 30)):
            new[rng.randrange(len(new))] = f"x{rng.randint(0, 5000)}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(new))]
    own = sets(docs, 5)
    alike = {k for k in range(60) if 100 * len(own[2 * k] & own[2 * k + 1]) >= 80 * len(own[2 * k] | own[2 * k + 1])}
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["minhash"](spark, frame(spark, docs), SF).collect()}
    assert 15 < len(alike) < 55
    assert {k for k in range(60) if 2 * k + 1 not in left} == alike and all(2 * k in left for k in range(60))


def test_odd_documents(spark):
    """Null, empty and repeated texts, a null id and an extra column pass through all stages."""
    from pyspark.sql import functions as F

    from .data import frame

    docs = frame(spark, [(1, None), (2, ""), (2, ""), (None, "some words of a text here"), (3, "plain clean text, nothing else"), (4, "  \n ")]).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert out.count() >= 4
        assert stage(spark, docs.limit(0), SF).count() == 0
