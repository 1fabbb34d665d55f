import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldspark.llm.line_dedup import dedup_lines

from .data import edge_texts, frame, rows


def brute(docs, least=10):
    holders, keys = defaultdict(set), {}
    for i, t in docs:
        own = [re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r")) for line in (t or "").split("\n")]
        keys[i] = own
        for k in own:
            if len(k) >= least:
                holders[k].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [line for line, k in zip(lines, keys[i]) if not (len(holders[k]) > 1 and min(holders[k]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batch", [10_000, 7])
def test_against_brute_force(spark, batch):
    """With small batches repeats are found by the filters, not inside a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    docs = [(r[0], r[1]) for r in rows(spark)] + [(1000 + i, t) for i, t in enumerate(edge_texts())]
    got = dedup_lines(frame(spark, docs).repartition(5))
    got = {r[0]: tuple(r[1:]) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(docs)
    assert sum(v[1] for v in got.values()) > 20


def test_hot_line(spark):
    """A line that most documents hold, dealt to parts, beside their own lines."""
    docs = [(i, f"the very common line\nline of document {i}\n" + "a rarer line\n" * (i % 100 == 0)) for i in range(3000)]
    got = dedup_lines(frame(spark, docs).repartition(6))
    assert {r[0]: tuple(r[1:]) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()} == brute(docs)


def test_odd_tables(spark):
    line = "a line that repeats"
    docs = frame(spark, [(None, line), (1, line), (1, line), (2, line)]).withColumn("n_dropped", F.lit(9)).withColumn("__fps", F.lit(1))
    got = dedup_lines(docs, keep=("n_dropped", "source"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "source"]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, line), (1, line), (1, line), (2, "")]
    assert dedup_lines(docs.limit(0)).count() == 0
