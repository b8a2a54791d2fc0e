"""Box-Cox and Yeo-Johnson exponents by maximum likelihood.

The first round evaluates a coarse grid of exponents for all columns in one
aggregate; later rounds take three points around the top of a fitted parabola."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import agg_dict

LAMBDA_RANGE = (-5.0, 5.0)


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-12 else (
        F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
    r = 2 - lam
    low = -F.log1p(F.greatest(-x, F.lit(0.0))) if abs(r) < 1e-12 else -(
        F.pow(F.greatest(-x, F.lit(0.0)) + 1, F.lit(r)) - 1) / r
    return F.when(x >= 0, up).when(x < 0, low)


def fit_lambdas(df: DataFrame, exprs: Mapping[str, Column], kind: str, rounds: int = 6, grid: int = 11) -> dict[str, float]:
    """Best exponent per expression (positive values needed for Box-Cox)."""
    # one logarithm per row; every exponent is then a single exponential of it
    log = {c: F.ln(x) if kind == "boxcox" else F.signum(x) * F.log1p(F.abs(x)) for c, x in exprs.items()}
    df = df.select(*[e.alias(f"l{i}") for i, e in enumerate(log.values())])
    cols = {c: F.col(f"l{i}") for i, c in enumerate(exprs)}
    base = agg_dict(df, {(c, s): f(l) for c, l in cols.items() for s, f in (("n", F.count), ("j", F.sum))})
    if kind == "boxcox":
        # taking off the mean logarithm leaves the best exponent as it is and keeps powers moderate
        cols = {c: l - base[(c, "j")] / max(base[(c, "n")], 1) for c, l in cols.items()}
        jac = dict.fromkeys(exprs, 0.0)
    else:
        jac = {c: base[(c, "j")] for c in exprs}

    def mapped(l, lam):
        def power(t, k):
            return t if abs(k) < 1e-12 else F.expm1(t * k) / k
        if kind == "boxcox":
            return power(l, lam)
        return F.when(l >= 0, power(l, lam)).when(l < 0, -power(-l, 2 - lam))

    def likelihood(points: dict[str, list[float]]) -> dict[str, list[float]]:
        var = agg_dict(df, {(c, i): F.var_pop(mapped(cols[c], l)) for c, ls in points.items() for i, l in enumerate(ls)})
        out: dict[str, list[float]] = {}
        for (c, i), v in var.items():
            n, l = base[(c, "n")], points[c][i]
            ok = v is not None and 0 < v < math.inf
            out.setdefault(c, []).append((l - 1) * jac[c] - n / 2 * math.log(v) if ok else -math.inf)
        return out

    lo, hi = LAMBDA_RANGE
    step = {c: (hi - lo) / (grid - 1) for c in exprs}
    pts = {c: [lo + i * step[c] for i in range(grid)] for c in exprs}
    best: dict[str, float] = {}
    for _ in range(rounds):
        for c, ll in likelihood(pts).items():
            i = max(range(len(ll)), key=lambda j: (ll[j], -j))
            best[c] = pts[c][i]
            if 0 < i < len(ll) - 1 and min(ll[i - 1], ll[i + 1]) > -math.inf:
                bend = ll[i - 1] - 2 * ll[i] + ll[i + 1]
                if bend < 0:  # top of the parabola through the three points
                    best[c] += step[c] * 0.5 * (ll[i - 1] - ll[i + 1]) / bend
                step[c] /= 8
            pts[c] = [best[c] - step[c], best[c], best[c] + step[c]]
    return best
