"""Every query against its DuckDB twin, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldspark.jobs import queries as jobs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def near(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_twin(spark, con, name):
    df = jobs.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in jobs.ORACLE_SQL:
        assert got
        return
    rel = con.execute(jobs.ORACLE_SQL[name])
    columns = sorted(c[0] for c in rel.description)
    want = rel.fetch_df()
    assert sorted(df.columns) == columns
    key = lambda r: tuple((x is None, round(x, 4) if isinstance(x, float) else x) for x in r)
    a = sorted((tuple(r[c] for c in columns) for r in got), key=key)
    b = sorted((tuple(None if x is None or x != x else x for x in r) for r in want[columns].astype(object).itertuples(index=False)), key=key)
    assert len(a) == len(b) and len(a)
    for x, y in zip(a, b):
        assert all(near(p, q) for p, q in zip(x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
