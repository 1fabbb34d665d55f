"""Eigenvalues and eigenvectors of a symmetric integer matrix without a nonzero rounding error before the last step.

The characteristic polynomial is found modulo primes of 31 bits by Hessenberg reduction and put together by Chinese
remaindering; one prime more than its bound asks for checks it. The matrix has no negative eigenvalue, so the number
of roots above c is the number of sign changes of p(x + c) (Descartes' rule is exact where all roots are real), which
isolates roots by halving; an isolated root is halved on by the sign of the square-free part. Vectors come from
inverse iteration with decimals whose digits follow the gap to the next root; a root of multiplicity m gets m
orthonormal ones. The matrix has one row a dimension; work on primes and on roots is for Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import gcd, log2

import numpy as np

#: Bits of a root beyond twice those that tell it from the next one.
EXTRA_BITS = 160


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide all n below 3,215,031,751."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(bits: float) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits, and one more."""
    out, n, got = [], (1 << 31) - 1, 0.0
    while got <= bits:
        if _is_prime(n):
            out.append(n)
            got += log2(n)
        n -= 2
    while not _is_prime(n):
        n -= 2
    return [*out, n]


def coefficient_bits(trace: int, d: int) -> float:
    """Bits that hold every coefficient with its sign: their sizes add up to prod(1 + root) <= (1 + trace / d)^d."""
    return d * (log2(trace + d) - log2(d)) + 2 if d else 1.0


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p, the constant one first, of det(x - m) for integers m (an object array)."""
    h = (m % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        h[[k + 1, i]] = h[[i, k + 1]]
        h[:, [k + 1, i]] = h[:, [i, k + 1]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1]) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        t, c = np.empty(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            t[i] = h[i, k] * c % p
            c = c * int(h[i, i - 1]) % p if i else c
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (t[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d]


def remaindered(residues: dict[int, np.ndarray]) -> list[int]:
    """Integer coefficients from those modulo primes; raises if the last prime does not agree."""
    *used, check = sorted(residues, reverse=True)
    c, m = np.array([0] * len(residues[check]), object), 1
    for p in used:
        c = c + m * ((residues[p].astype(object) - c) * pow(m, -1, p) % p)
        m *= p
    c = np.where(c > m // 2, c - m, c)
    if ((c - residues[check].astype(object)) % check).any():
        raise ArithmeticError("a characteristic polynomial disagrees with its check prime")
    return [int(x) for x in c]


def _shifted(p: list[int], c: int) -> list[int]:
    """Coefficients of p(x + c)."""
    a = list(p)
    for k in range(len(a) - 1):
        for i in range(len(a) - 2, k - 1, -1):
            a[i] += c * a[i + 1]
    return a


def _changes(p: list[int]) -> int:
    signs = [x > 0 for x in p if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def above(p: list[int], c: int, s: int) -> int:
    """Roots above c / 2^s, with multiplicity, of a polynomial whose roots are all real."""
    scaled = [x << (s * (len(p) - 1 - i)) for i, x in enumerate(p)]  # its roots are 2^s times as large
    if not c:
        return _changes(scaled)
    # x -> c x first: a shift by one then takes additions only
    a = [x * c**i for i, x in enumerate(scaled)]
    return _changes(_shifted(a, 1))


def _sign(p: list[int], c: int, s: int) -> int:
    """Sign of p(c / 2^s)."""
    v = 0
    for k, x in enumerate(reversed(p)):
        v = v * c + (x << (s * k))
    return (v > 0) - (v < 0)


def _primitive(p: list[int]) -> list[int]:
    while p and not p[-1]:
        p = p[:-1]
    g = gcd(*p) if p else 1
    return [x // g for x in p]


def _rest(a: list[int], b: list[int]) -> list[int]:
    """A multiple of the remainder of a by b."""
    a = list(a)
    while len(a) >= len(b):
        g = gcd(a[-1], b[-1])
        f, h = b[-1] // g, a[-1] // g
        at = len(a) - len(b)
        a = [x * f - (h * b[i - at] if i >= at else 0) for i, x in enumerate(a)][:-1]
        while a and not a[-1]:
            a.pop()
    return a


def square_free(p: list[int]) -> list[int]:
    """The polynomial with the roots of p, each once."""
    a, b = _primitive(p), _primitive([i * x for i, x in enumerate(p)][1:])
    if _coprime(a, b):
        return a
    top = a
    while b:
        a, b = b, _primitive(_rest(a, b))
    if len(a) == 1:
        return top
    out, rest = [0] * (len(top) - len(a) + 1), list(top)
    scale = abs(a[-1]) ** len(out)
    rest = [x * scale for x in rest]  # so that all divisions are whole
    for k in range(len(out) - 1, -1, -1):
        out[k] = rest[k + len(a) - 1] // a[-1]
        for i, x in enumerate(a):
            rest[k + i] -= out[k] * x
    return _primitive(out)


def _coprime(a: list[int], b: list[int]) -> bool:
    """Whether a prime shows that the two have no root in common (False: it may or may not be so)."""
    for q in (2147483647, 2147483629):
        if not a[-1] % q or not b or not b[-1] % q:
            continue
        x, y = [v % q for v in a], [v % q for v in b]
        while y:
            inv = pow(y[-1], -1, q)
            while len(x) >= len(y):
                f, at = x[-1] * inv % q, len(x) - len(y)
                for i, v in enumerate(y):
                    x[at + i] = (x[at + i] - f * v) % q
                while x and not x[-1]:
                    x.pop()
            x, y = y, x
        if len(x) == 1:
            return True
    return False


@dataclass
class Root:
    """A root in (low, high] / 2^shift; equal ends if it is exact. digits: decimals that tell it from all others."""

    low: int
    high: int
    shift: int
    times: int
    digits: int

    def decimal(self) -> Decimal:
        """Its middle, to the precision of the context."""
        return Decimal(self.low + self.high) / Decimal(1 << (self.shift + 1))


def largest_roots(p: list[int], k: int) -> list[Root]:
    """The largest different positive roots, until they are k with their multiplicity or none is left, falling."""
    while len(p) > 1 and not p[0]:
        p = p[1:]
    if len(p) < 2:
        return []
    w = square_free(p)
    top = 1
    while above(w, top, 0):
        top *= 2
    out: list[Root] = []
    todo = [(0, top, 0, above(w, 0, 0), 0)]  # the highest last
    while todo and sum(r.times for r in out) < k:
        low, high, s, over_low, over_high = todo.pop()
        if over_low == over_high:
            continue
        if over_low - over_high == 1:
            out.append(_refined(p, w, low, high, s))
            continue
        if high - low == 1:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        m = above(w, mid, s)
        todo += [(low, mid, s, over_low, m), (mid, high, s, m, over_high)]
    return out


def _refined(p: list[int], w: list[int], low: int, high: int, s: int) -> Root:
    """Halves until the ends agree in EXTRA_BITS bits more than twice those that isolate the root."""
    times = above(p, low, s) - above(p, high, s)
    bits = EXTRA_BITS + 2 * max(0, high.bit_length() - (high - low).bit_length() + 1)
    digits = int(0.302 * bits) + 30
    sign = _sign(w, high, s)
    while sign and high.bit_length() - (high - low).bit_length() < bits:
        if high - low == 1:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        at = _sign(w, mid, s)
        if at == sign:
            high = mid
        elif at:
            low = mid
        else:
            high, sign = mid, 0
    return Root(high, high, s, times, digits) if not sign else Root(low, high, s, times, digits)


def vectors(m: np.ndarray, root: Root, rounds: int = 8) -> np.ndarray:
    """Orthonormal eigenvectors of a root, as columns; the largest entry of each (the first on ties) is positive."""
    d = len(m)
    with localcontext() as context:
        context.prec = root.digits + 20
        tiny = Decimal(10) ** -root.digits
        at = root.decimal()
        a = np.array([[Decimal(int(x)) for x in row] for row in m], object)
        a[np.arange(d), np.arange(d)] -= at
        order = np.arange(d)
        for k in range(d):  # a holds both factors
            i = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, i]] = a[[i, k]]
            order[[k, i]] = order[[i, k]]
            if abs(a[k, k]) < tiny * at:
                a[k, k] = tiny * at
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= a[k + 1 :, k : k + 1] * a[k, k + 1 :]
        rng = np.random.default_rng(d)
        x = np.array([[Decimal(float(v)) for v in row] for row in rng.standard_normal((d, root.times))], object)
        for _ in range(rounds):
            before = x
            x = x[order]
            for k in range(d):
                x[k + 1 :] -= a[k + 1 :, k : k + 1] * x[k]
            for k in range(d - 1, -1, -1):
                x[k] /= a[k, k]
                x[:k] -= a[:k, k : k + 1] * x[k]
            for j in range(root.times):
                for _ in range(2):
                    for i in range(j):
                        x[:, j] -= x[:, i] * (x[:, i] * x[:, j]).sum()
                    x[:, j] /= (x[:, j] * x[:, j]).sum().sqrt()
            span = x - before @ (before.T @ x)  # of orthonormal columns from the second round on
            if max(abs(v) for v in span.ravel()) < Decimal("1e-30"):
                break
        else:
            raise ArithmeticError("an eigenvector did not converge")
        for j in range(root.times):
            big = max(range(d), key=lambda i: abs(x[i, j]))
            x[:, j] *= 1 if x[big, j] > 0 else -1
        return x.astype(np.float64)
