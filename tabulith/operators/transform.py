"""Column transforms: cleaned input, guarded expression, cleaned output.

Missing reads as 0 and infinities as +-1e10, before and after.  Statistics come
from one aggregate over the cleaned values; everything else is one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import agg_dict, is_float, q, value
from ..functions.ordering import order_bucket, rank_table
from ..functions.quantiles import quantiles
from ..plans.ledger import operation
from .normalize import div, fit_knots, knot_map
from .power import box_cox, fit_lambdas, yeo_johnson

_BIG, _INF = 1e10, float("inf")


def clean(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.0).when(c == _INF, _BIG).when(c == -_INF, -_BIG).otherwise(c)


def cleaned(df: DataFrame, name: str) -> Column:
    c = q(name) if is_float(df, name) else q(name).try_cast("double")
    return clean(c.cast("double"))


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    c = c if lo is None else F.greatest(c, F.lit(lo))
    return c if hi is None else F.least(c, F.lit(hi))


def _guard(cond: Column, c: Column) -> Column:
    return F.when(cond, c).otherwise(0.0)


def _logistic(c: Column, limit: float) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(c, -limit, limit)))


def _power(k: int) -> Callable[[Column], Column]:
    return lambda c: F.pow(c, F.lit(float(k)))


# key -> expression of the cleaned column; limits are fixed values
ROWWISE: dict[str, Callable[[Column], Column]] = {
    "original": lambda c: c,
    "absolute": F.abs,
    "negative": lambda c: -c,
    "square": lambda c: F.pow(clip(c, -1e5, 1e5), F.lit(2.0)),
    "cube": lambda c: F.pow(clip(c, -1e4, 1e4), F.lit(3.0)),
    "sqrt": lambda c: F.sqrt(clip(c, 0.0, None)),
    "cbrt": F.cbrt,
    "fourth_root": lambda c: F.pow(clip(c, 0.0, None), F.lit(0.25)),
    "reciprocal": lambda c: _guard(F.abs(c) > 2.220446049250313e-16, F.try_divide(F.lit(1.0), c)),
    "inv_square": lambda c: _guard(c * c > 1e-8, F.try_divide(F.lit(1.0), c * c)),
    "inv_cube": lambda c: _guard(F.abs(c * c * c) > 1e-8, F.try_divide(F.lit(1.0), c * c * c)),
    "log1p": lambda c: F.log1p(clip(c, -1 + 1e-9, None)),
    "expm1": F.expm1,
    "sign": F.signum,
    "weibull": lambda c: F.exp(-F.pow(clip(c, 0.0, None), F.lit(2.0))),
    "pow_025": lambda c: F.signum(c) * F.pow(F.abs(c), F.lit(0.25)),
    "pow_033": lambda c: F.cbrt(clip(c, 0.0, None)),
    "pow_05": lambda c: F.sqrt(clip(c, 0.0, None)),
    "pow_2": _power(2),
    "pow_3": _power(3),
    "pow_4": _power(4),
    "log_nat": lambda c: F.ln(clip(c, 1e-8, None)),
    "log2": lambda c: F.log2(clip(c, 1e-8, None)),
    "log10": lambda c: F.log10(clip(c, 1e-8, None)),
    "log_exp": lambda c: F.log1p(F.exp(clip(c, -700.0, 700.0))),
    "log_log": lambda c: F.ln(F.ln(clip(c + 1.1, 1.1, None))),
    "inv_log": lambda c: _logistic(c, 500.0),
    "shifted_log": lambda c: F.ln(clip(c + 2, 1e-8, None)),
    "exp": lambda c: F.exp(clip(c, -700.0, 700.0)),
    "exp2": lambda c: F.pow(F.lit(2.0), clip(c, -700.0, 700.0)),
    "expm1_exp": lambda c: F.exp(clip(c, -700.0, 700.0)) - 1.0,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": lambda c: F.asin(clip(c, -1.0, 1.0)),
    "arccos": lambda c: F.acos(clip(c, -1.0, 1.0)),
    "arctan": F.atan,
    "sinh": lambda c: F.sinh(clip(c, -700.0, 700.0)),
    "cosh": lambda c: F.cosh(clip(c, -700.0, 700.0)),
    "tanh": F.tanh,
    "gen_hyp": lambda c: F.ln(F.cosh(clip(c, -700.0, 700.0))),
    "arcsinh": F.asinh,
    "arccosh": lambda c: F.acosh(clip(c, 1.0, None)),
    "arctanh": lambda c: F.atanh(clip(c, -1 + 1e-9, 1 - 1e-9)),
    "sigmoid": lambda c: _logistic(c, 700.0),
    "logit": lambda c: F.ln(clip(c, 1e-8, 1 - 1e-8) / (1.0 - clip(c, 1e-8, 1 - 1e-8))),
    "gaussian": lambda c: F.exp(-(c * c)),
}
FITTED = ("binarize", "log_norm", "softmax", "zscore", "standard", "minmax", "robust", "boxcox", "yeojohnson", "quantile")
ORDERED = ("rank", "pct_rank", "ema")
#: In-place set used by replayed steps; here missing stays missing.
IN_PLACE = ("log", "log1p", "sqrt", "square", "reciprocal", "standardize", "minmax")


def fit(df: DataFrame, key: str, columns: Sequence[str], *, in_place: bool = False, order_by: Sequence[str] = (),
        span: int = 5, output: str = "uniform", n_quantiles: int = 1000, lam: float | None = None) -> dict:
    """Statistics one transform needs; none for row-wise keys."""
    cols = list(columns)
    p: dict = {"transform_type": key, "columns": cols, "in_place": in_place, "fitted": {c: {} for c in cols}}
    if in_place:
        return _fit_in_place(df, p)
    x = {c: cleaned(df, c) for c in cols}
    if key in ("binarize", "robust"):
        for c, v in quantiles(df, x, [0.25, 0.5, 0.75]).items():
            p["fitted"][c] = {"q1": v[0], "median": v[1], "q3": v[2]}
    elif key in ("zscore", "standard"):
        got = agg_dict(df, {(c, s): f(e) for c, e in x.items() for s, f in (("m", F.avg), ("s", F.stddev_pop))})
        p["fitted"] = {c: {"mean": got[(c, "m")], "sd": got[(c, "s")]} for c in cols}
    elif key in ("minmax", "log_norm", "softmax", "boxcox"):
        got = agg_dict(df, {(c, s): f(e) for c, e in x.items() for s, f in (("a", F.min), ("b", F.max))})
        p["fitted"] = {c: {"min": got[(c, "a")], "max": got[(c, "b")]} for c in cols}
        if key == "softmax":
            tot = agg_dict(df, {c: F.sum(F.exp(e - got[(c, "b")])) for c, e in x.items()})
            for c in cols:
                p["fitted"][c]["total"] = tot[c]
        if key == "boxcox":
            varied = {c: _positive(x[c], got[(c, "a")]) for c in cols if got[(c, "b")] > got[(c, "a")]}
            lams = {c: lam for c in varied} if lam is not None else fit_lambdas(df, varied, "boxcox")
            for c in cols:
                p["fitted"][c]["lambda"] = lams.get(c)
    elif key == "yeojohnson":
        lams = {c: lam for c in cols} if lam is not None else fit_lambdas(df, x, "yeojohnson")
        p["fitted"] = {c: {"lambda": lams[c]} for c in cols}
    elif key == "quantile":
        p["fitted"] = {c: {"knots": k} for c, k in fit_knots(df, x, n_quantiles).items()}
        p["output"] = output
    elif key == "ema":
        if not order_by:
            raise ValueError("ema needs order_by")
        p.update(order_by=list(order_by), span=span)
    elif key == "pct_rank":
        p["rows"] = df.count()
    elif key not in ROWWISE and key != "rank":
        raise ValueError(f"unknown transform: {key}")
    return p


def _positive(x: Column, low: float) -> Column:
    return clip(x - low + 1 if low <= 0 else x, 1e-8, None)


def expression(key: str, x: Column, f: dict, output: str = "uniform") -> Column:
    """The cleaned result for one column from its fitted numbers."""
    if key in ROWWISE:
        r = ROWWISE[key](x)
    elif key == "binarize":
        r = (x > f["median"]).cast("double")
    elif key in ("zscore", "standard"):
        r = (x - f["mean"]) / max(f["sd"], 1e-9)
    elif key == "minmax":
        r = div(x - f["min"], f["max"] - f["min"])
    elif key == "robust":
        r = (x - f["median"]) / (f["q3"] - f["q1"] + 1e-9)
    elif key == "log_norm":
        top = F.ln(F.lit(max(f["max"] + 1, 1e-8)))
        r = F.ln(clip(x + 1, 1e-8, None)) / F.when(top > 1e-9, top).otherwise(1.0)
    elif key == "softmax":
        r = F.exp(x - f["max"]) / f["total"]
    elif key == "boxcox":
        r = x if f["lambda"] is None else box_cox(_positive(x, f["min"]), f["lambda"])
    elif key == "yeojohnson":
        r = yeo_johnson(x, f["lambda"])
    else:
        r = knot_map(x, f["knots"], output)
    return clean(r)


@operation("transform_columns")
def apply(df: DataFrame, p: dict) -> DataFrame:
    """Append ``<column>_<key>`` (or replace in place for the replay set)."""
    key, cols = p["transform_type"], p["columns"]
    if p.get("in_place"):
        return _apply_in_place(df, p)
    if key == "ema":
        return _ema(df, p)
    if key in ("rank", "pct_rank"):
        return _ranks(df, p)
    return df.withColumns({f"{c}_{key}": expression(key, cleaned(df, c), p["fitted"][c], p.get("output", "uniform"))
                           for c in cols})


def transform(df: DataFrame, key: str, columns: Sequence[str], **kw) -> DataFrame:
    return apply(df, fit(df, key, columns, **kw))


def _ranks(df: DataFrame, p: dict) -> DataFrame:
    key, out = p["transform_type"], df
    for i, c in enumerate(p["columns"]):
        name = f"__r{i}"
        out = out.withColumn(name, cleaned(df, c))
        table = rank_table(out, name).select(F.col("v").alias(name), F.col("rank").alias("__rk"))
        rank = F.col("__rk") / p["rows"] if key == "pct_rank" else F.col("__rk")
        out = out.join(table, name, "left").withColumn(f"{c}_{key}", rank).drop(name, "__rk")
    return out


def _ema(df: DataFrame, p: dict) -> DataFrame:
    """Exponential mean in key order.

    Over a value range the recursion is affine in the value carried in, so each
    range reports its length and its end value from zero; the carries follow
    from those few numbers and a second pass starts each range from its carry."""
    cols, span, order = p["columns"], p["span"], p["order_by"]
    keep = 1 - 2.0 / (span + 1)
    xs = [f"__x{i}" for i in range(len(cols))]
    rows = order_bucket(df.withColumns({x: cleaned(df, c) for x, c in zip(xs, cols)}), order)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = {"b": [pdf["__bucket"].iloc[0]], "n": [len(pdf)], "first": [[float(pdf[x].iloc[0]) for x in xs]]}
        out["end"] = [[float(_ewm(0.0, pdf[x], span)[-1]) for x in xs]]
        return pd.DataFrame(out)

    slim = rows.select("__bucket", *order, *xs)
    got = slim.groupBy("__bucket").applyInPandas(ends, "b bigint, n bigint, first array<double>, end array<double>") \
        .orderBy("b").collect()  # one row per value range
    carry: dict[int, list[float]] = {}
    now = list(got[0]["first"]) if got else []
    for r in got:
        carry[r["b"]] = now
        now = [keep ** r["n"] * a + e for a, e in zip(now, r["end"])]
    names = [f"{c}_ema" for c in cols]
    schema = rows.drop(*xs, "__bucket").schema
    for n in names:
        schema = schema.add(n, "double")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        start = carry[int(pdf["__bucket"].iloc[0])]
        for i, (x, n) in enumerate(zip(xs, names)):
            pdf[n] = _ewm(start[i], pdf[x], span)
        return pdf.drop(columns=[*xs, "__bucket"])

    return rows.groupBy("__bucket").applyInPandas(fill, schema)


def _ewm(start: float, s: pd.Series, span: int):
    return pd.concat([pd.Series([start]), s]).ewm(span=span, adjust=False).mean().to_numpy()[1:]


def _fit_in_place(df: DataFrame, p: dict) -> dict:
    key, cols = p["transform_type"], p["columns"]
    if key not in IN_PLACE:
        raise ValueError(f"unknown transform: {key}")
    if key in ("standardize", "minmax"):
        x = {c: value(df, c).cast("double") for c in cols}
        fns = (("a", F.avg), ("b", F.stddev_samp)) if key == "standardize" else (("a", F.min), ("b", F.max))
        got = agg_dict(df, {(c, s): f(e) for c, e in x.items() for s, f in fns})
        p["fitted"] = {c: {"a": got[(c, "a")], "b": got[(c, "b")]} for c in cols}
    return p


def _apply_in_place(df: DataFrame, p: dict) -> DataFrame:
    key, out = p["transform_type"], {}
    for c in p["columns"]:
        x, f = value(df, c).cast("double"), p["fitted"].get(c, {})
        if key in ("standardize", "minmax"):
            width = f["b"] if key == "standardize" else f["b"] - f["a"]
            out[c] = (x - f["a"]) / width if width else x
        else:
            out[c] = {"log": F.ln, "log1p": F.log1p, "sqrt": F.sqrt, "square": lambda v: v * v,
                      "reciprocal": lambda v: F.try_divide(F.lit(1.0), v)}[key](x)
    return df.withColumns(out)


