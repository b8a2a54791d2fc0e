"""Distribution tails for a handful of summary statistics on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()
phi_cdf, phi_inv = _N.cdf, _N.inv_cdf


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the Lentz continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if not f > 0:
        return 1.0
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x: float, k: float) -> float:
    """P(X > x) from the regularised lower gamma (series or fraction)."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


_GL_X, _GL_W = np.polynomial.legendre.leggauss(24)


def bvn_cdf(a: float, b: float, rho: float) -> float:
    """Standard bivariate normal P(X<=a, Y<=b) by integration over correlation."""
    if a == -math.inf or b == -math.inf:
        return 0.0
    if a == math.inf:
        return 1.0 if b == math.inf else phi_cdf(b)
    if b == math.inf:
        return phi_cdf(a)
    top = math.asin(max(-1.0, min(1.0, rho)))
    t = np.sin(top * (_GL_X + 1) / 2)
    f = np.exp(-(a * a - 2 * t * a * b + b * b) / (2 * (1 - t * t)))
    return phi_cdf(a) * phi_cdf(b) + float(np.sum(_GL_W * f)) * top / (4 * math.pi)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def golden(fn, lo: float, hi: float, steps: int = 60, tol: float = 1e-10) -> float:
    """Minimiser of a one-dimensional function on a bracket."""
    r = (math.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = fn(a), fn(b)
    for _ in range(steps):
        if hi - lo < tol:
            break
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = fn(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = fn(b)
    return (lo + hi) / 2
