import random
from fractions import Fraction

import numpy as np
import pytest

from fieldspark.llm.embedding_whitening import whiten
from fieldspark.llm.exact_eigen import above, coefficient_bits, largest_roots, polynomial_mod, primes, remaindered, square_free, vectors

from .data import rows

SCHEMA = "vec_id long, embedding array<double>, label int"


def exact_polynomial(m):
    """Faddeev-LeVerrier over the rationals."""
    d = len(m)
    c, b = [1], np.array([[Fraction(0)] * d] * d, object)
    eye = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    for k in range(1, d + 1):
        b = m @ b + c[-1] * eye
        c.append(-sum((m @ b)[i, i] for i in range(d)) / k)
    return [int(v) for v in reversed(c)]


def polynomial(m):
    return remaindered({p: polynomial_mod(m, p) for p in primes(coefficient_bits(int(np.trace(m)), len(m)))})


def from_roots(*values):
    p = [1]
    for v in values:
        p = [a - v * b for a, b in zip([0, *p], [*p, 0])]
    return p


def scatter(rng, d, n, spread=9):
    x = rng.integers(-spread, spread, (n, d)).astype(object)
    s = x.sum(axis=0)
    return n * (x.T @ x) - s[:, None] * s


@pytest.mark.parametrize("d,n", [(1, 3), (2, 5), (6, 40), (9, 4), (12, 60)])
def test_polynomial(d, n):
    m = scatter(np.random.default_rng(d), d, n)
    assert polynomial(m) == exact_polynomial(m)


def test_counts_of_roots():
    p = from_roots(1, 1, 4, 9, 9, 9)
    assert [above(p, c, 0) for c in (0, 1, 3, 4, 8, 9)] == [6, 4, 4, 3, 3, 0]
    assert above(p, 17, 1) == 3 and above(p, 19, 1) == 0
    assert square_free(p) in (from_roots(1, 4, 9), [-x for x in from_roots(1, 4, 9)])
    got = largest_roots([0, 0, *p], 4)
    assert [(r.low / 2**r.shift, r.times) for r in got] == [(9, 3), (4, 1)]
    assert largest_roots([0, 0, 1], 3) == [] == largest_roots([5], 3)


def test_close_roots():
    big = 10**40
    p = from_roots(big, big + 1, 3)
    got = largest_roots(p, 3)
    assert [(r.times, (r.low + r.high) // 2 >> r.shift) for r in got] == [(1, big + 1), (1, big), (1, 3)]


def test_vectors_of_equal_and_close_roots():
    rng = np.random.default_rng(3)
    m = np.diag(np.array([5, 5, 5, 10**30, 10**30 + 1, 0], object))
    t = np.array([[int(i == j) for j in range(6)] for i in range(6)], object)
    for _ in range(4):  # integer rotations by reflections with a common factor: (v.v) I - 2 v v'
        v = rng.integers(-3, 4, 6).astype(object)
        r = (v @ v) * np.array(np.eye(6).astype(int), object) - 2 * v[:, None] * v
        t = r @ t
    s = (t @ t.T)[0, 0]
    m = t @ m @ t.T  # eigenvalues times s
    roots = largest_roots(polynomial(m), 6)
    assert [r.times for r in roots] == [1, 1, 3]
    for r, want in zip(roots, (10**30 + 1, 10**30, 5)):
        assert abs(Fraction(r.low + r.high, 2 << r.shift) / s - want) < Fraction(1, 10**9)
        v = vectors(m, r)
        assert np.allclose(v.T @ v, np.eye(r.times), atol=1e-14)
        other = t.astype(float) / float(s) ** 0.5
        own = other[:, {10**30 + 1: [4], 10**30: [3], 5: [0, 1, 2]}[want]]
        assert np.abs(own @ (own.T @ v) - v).max() < 1e-13


def brute(data):
    """(vec_id, component) -> n, deviation, |whitened|, explained, by NumPy, for well separated eigenvalues."""
    kept = [(i, [int(np.floor(64 * float(c))) + 10**6 for c in v]) for i, v in data if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(c, n) for c in s]
    centred = np.array([[float(a - b) for a, b in zip(x, mean)] for x in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
        w = np.array([float(a - b) for a, b in zip(x, mean)]) @ basis
        for k in range(min(16, len(s))):
            out[i, k + 1] = (n, deviation, abs(w[k]) / values[k] ** 0.5, values[k] / values.sum())
    return out


def test_provided_table(spark):
    data = [(r[0], r[1]) for r in rows(spark, "embeddings")]
    extra = [(-1, None), (-2, [None] * 64), (-3, [float("nan")] * 64), (-4, [float("inf")] + [0.0] * 63), (-5, data[0][1]), (-6, []), (-7, [1.0] * 3), (-8, [1e300] * 64)]
    df = spark.createDataFrame(data + extra, "vec_id long, embedding array<double>").selectExpr("*", "1 as component", "'y' as x").repartition(5)
    got = whiten(df).collect()
    want = brute(data + extra[:5])
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, white, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - white) < 1e-8 and abs(r.explained - share) < 1e-12
        assert r.identity_error < 1e-10


def test_odd_tables(spark):
    make = lambda data: whiten(spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA))
    assert make([]).count() == 0
    assert make([(1, None), (2, [None])]).count() == 0
    assert make([(1, [0.5, 2.0]), (2, [0.5, 2.0])]).count() == 0  # no variance
    flat = make([(1, [0.0, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0])]).collect()  # one dimension varies
    assert [(r.component, r.n, r.deviation, r.explained) for r in flat] == [(1, 2, 64 * 64, 1.0)] * 3
    assert all(abs(abs(r.whitened) - 1) < 1e-15 for r in flat)
    rng = random.Random(1)
    square = [(k, [float(a), float(b), 0.0]) for k, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]  # equal eigenvalues
    got = make(square).collect()
    assert {r.component for r in got} == {1, 2} and all(r.explained == 0.5 and r.identity_error < 1e-14 for r in got)
    large = [(k, [rng.uniform(-1, 1) * 2.0**50, rng.uniform(-1, 1)]) for k in range(9)]
    got = make(large).collect()
    assert all(r.deviation is None for r in got if r.component == 1) and max(r.identity_error for r in got) < 1e-10
