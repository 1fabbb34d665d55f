"""Small inputs for the tests, from the provided tables and by hand."""

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, name="documents", sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def frame(spark, texts, first=0):
    """Documents with the given texts; ids count up unless a text is an (id, text) pair."""
    pairs = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA)


def edge_texts():
    rng = random.Random(5)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randint(0, 400)) for _ in range(6000))
    passage = " ".join(f"Shared{i}" for i in range(40))
    return [None, "", " ", "\n", "one", "one", "Two words", "é ü \t x", passage, f"before {passage} after", f"{passage}", long, long, f"x\n{passage}\ny\n{passage}", "a line of text\n  A LINE of text \nother line here", "a line of text"]
