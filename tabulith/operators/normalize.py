"""Column scaling: one aggregate to fit, one projection to apply."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import agg_dict, numeric_columns, value
from ..functions.ordering import rank_table
from ..functions.quantiles import EXACT_ROWS, quantiles
from ..plans.ledger import operation
from .power import box_cox, fit_lambdas, yeo_johnson

METHODS = ("minmax", "standard", "robust", "log", "boxcox", "yeojohnson", "quantile", "winsor", "log1p_clip", "sqrt_clip")


def fit(df: DataFrame, method: str, columns: Sequence[str] | None = None, *, low: float = 0.0, high: float = 1.0,
        ddof: int = 0, q_low: float = 25.0, q_high: float = 75.0, base: str = "e", lam: float | None = None,
        standardize: bool = True, n_quantiles: int = 1000, output: str = "uniform") -> dict:
    cols = list(columns or numeric_columns(df))
    x = {c: value(df, c).cast("double") for c in cols}
    p: dict = {"method": method, "columns": cols, "fitted": {}}
    fitted = p["fitted"]
    if method == "minmax":
        if low >= high:
            raise ValueError("low must be below high")
        got = agg_dict(df, {(c, s): f(e) for c, e in x.items() for s, f in (("a", F.min), ("b", F.max))})
        fitted.update({c: {"min": got[(c, "a")], "max": got[(c, "b")]} for c in cols})
        p.update(low=low, high=high)
    elif method == "standard":
        sd = F.stddev_pop if ddof == 0 else F.stddev_samp
        got = agg_dict(df, {(c, s): f(e) for c, e in x.items() for s, f in (("m", F.avg), ("s", sd))})
        fitted.update({c: {"mean": got[(c, "m")], "sd": got[(c, "s")]} for c in cols})
    elif method == "robust":
        for c, (a, m, b) in quantiles(df, x, [q_low / 100, 0.5, q_high / 100]).items():
            fitted[c] = {"median": m, "range": b - a}
    elif method in ("log", "boxcox"):
        low_of = agg_dict(df, {c: F.min(e) for c, e in x.items()})
        off = {c: (abs(m) + 1 if m is not None and m <= 0 else 0.0) for c, m in low_of.items()}
        fitted.update({c: {"offset": off[c]} for c in cols})
        p["base"] = base
        if method == "boxcox":
            _fit_power(df, p, {c: e + off[c] for c, e in x.items()}, box_cox, lam, standardize)
    elif method == "yeojohnson":
        fitted.update({c: {} for c in cols})
        _fit_power(df, p, x, yeo_johnson, lam, standardize)
    elif method == "quantile":
        knots = fit_knots(df, x, n_quantiles)
        fitted.update({c: {"knots": k} for c, k in knots.items()})
        p["output"] = output
    elif method == "winsor":
        for c, (a, b) in quantiles(df, x, [q_low / 100, q_high / 100]).items():
            fitted[c] = {"lo": a, "hi": b}
    elif method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return p


def _fit_power(df, p, x, fn, lam, standardize) -> None:
    lams = {c: lam for c in x} if lam is not None else fit_lambdas(df, x, p["method"])
    stats = agg_dict(df, {(c, s): f(fn(e, lams[c])) for c, e in x.items()
                          for s, f in (("m", F.avg), ("s", F.stddev_pop))}) if standardize else {}
    for c in x:
        p["fitted"][c].update({"lambda": lams[c], "mean": stats.get((c, "m"), 0.0), "sd": stats.get((c, "s"), 1.0) or 1.0})


def fit_knots(df: DataFrame, x: dict[str, Column], n_quantiles: int) -> dict[str, list[float]]:
    """Evenly spaced exact quantiles. Above the limit of one array they come from value counts in
    running order, so a thousand of them cost one sort by ranges."""
    n = df.count()
    k = max(2, min(n_quantiles, n))
    probs = [i / (k - 1) for i in range(k)]
    if n <= EXACT_ROWS:
        return quantiles(df, x, probs)
    return {c: _knots_by_counts(df, e, k) for c, e in x.items()}


def _knots_by_counts(df: DataFrame, x: Column, k: int) -> list[float]:
    """The values at ranks floor and ceil of (n - 1) i / (k - 1), from values and the rows below each."""
    one = df.select(x.cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    n = one.count()
    table = rank_table(one, "__x")
    # the few values that a rank may fall on, then the exact test
    last = F.col("below") + F.col("cnt") - 1
    step = (k - 1) / max(n - 1, 1)
    low, high = (F.col("below") - 1) * step, (last + 1) * step
    i = F.explode(F.sequence(F.greatest(F.lit(0), F.floor(low).cast("int")), F.least(F.lit(k - 1), F.ceil(high).cast("int")))).alias("i")
    some = table.filter(F.floor(high) >= F.ceil(low)).select("v", "below", last.alias("last"), i)
    h = F.lit(float(n - 1)) * (F.col("i") / F.lit(float(k - 1)))
    picked = some.select("i", "v", *[f(h).between(F.col("below"), F.col("last")).alias(s) for s, f in (("lo", F.floor), ("hi", F.ceil))]).filter("lo OR hi")
    got = picked.groupBy("i").agg(F.max(F.when(F.col("lo"), F.col("v"))).alias("a"), F.max(F.when(F.col("hi"), F.col("v"))).alias("b")).collect()
    out = [0.0] * k
    for r in got:
        rank = (n - 1) * (r["i"] / (k - 1))
        out[r["i"]] = r["a"] + (r["b"] - r["a"]) * (rank - math.floor(rank))
    return out


def div(a: Column, b) -> Column:
    """Scale by a fitted number; zero width scales by one."""
    return a / F.lit(float(b) if b else 1.0)


def knot_map(c: Column, knots: Sequence[float], output: str) -> Column:
    """Monotone map of values to [0, 1] (or normal scores) through the knots."""
    k, ref = np.asarray(knots, float), np.linspace(0, 1, len(knots))
    inv = NormalDist().inv_cdf

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        v = s.to_numpy(float)
        ok = ~np.isnan(v)
        out = np.full(len(v), np.nan)
        # ties take the middle of their step
        up = np.interp(v[ok], k, ref)
        down = -np.interp(-v[ok], -k[::-1], -ref[::-1])
        out[ok] = (up + down) / 2
        if output == "normal":
            out[ok] = [inv(min(max(u, 1e-7), 1 - 1e-7)) for u in out[ok]]
        return pd.Series(out)

    mapped = run(c)
    return F.when(c.isNotNull(), mapped)


@operation("normalize_scale")
def apply(df: DataFrame, p: dict) -> DataFrame:
    m, out = p["method"], {}
    for c in p["columns"]:
        x, f = value(df, c).cast("double"), p["fitted"].get(c, {})
        if m == "minmax":
            out[c] = p["low"] + div(x - f["min"], f["max"] - f["min"]) * (p["high"] - p["low"])
        elif m == "standard":
            out[c] = div(x - f["mean"], f["sd"])
        elif m == "robust":
            out[c] = div(x - f["median"], f["range"])
        elif m == "log":
            fn = {"e": F.ln, "2": F.log2, "10": F.log10}[p["base"]]
            out[c] = fn(x + f["offset"])
        elif m == "boxcox":
            out[c] = (box_cox(x + f["offset"], f["lambda"]) - f["mean"]) / f["sd"]
        elif m == "yeojohnson":
            out[c] = (yeo_johnson(x, f["lambda"]) - f["mean"]) / f["sd"]
        elif m == "quantile":
            out[c] = knot_map(x, f["knots"], p["output"])
        elif m == "winsor":
            out[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(f["lo"])), F.lit(f["hi"])))
        elif m == "log1p_clip":
            out[c] = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
        else:
            out[c] = F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))
    return df.withColumns(out)


def scale(df: DataFrame, method: str, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    return apply(df, fit(df, method, columns, **kw))


