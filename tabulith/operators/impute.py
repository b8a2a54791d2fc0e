"""Missing values: fitted fills, directional fills and interpolation.

``fit`` reads the table and returns JSON-ready parameters; ``apply`` is a lazy
projection (fills) or ordered joins (interpolation) using them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import agg_dict, drop_missing, missing, numeric_columns, q, value
from ..functions.ordering import fill_edges, halo, home_rows, running
from ..functions.quantiles import quantiles
from ..plans.ledger import operation

STATISTICS = ("mean", "median", "mode")
ORDERED = ("linear", "pchip", "akima", "spline", "ffill", "bfill")


def fit(df: DataFrame, method: str, columns: Sequence[str] | None = None, *, fill_value=None,
        order_by: Sequence[str] = (), partition_by: Sequence[str] = (), limit: int | None = None,
        min_non_null: int | None = None) -> dict:
    """Parameters of one missing-value step."""
    params: dict = {"method": method}
    nums = [c for c in (columns or numeric_columns(df)) if c not in set(order_by) | set(partition_by)]
    if method == "drop_rows":
        params["columns"] = list(columns) if columns else None
    elif method == "drop_cols":
        got = agg_dict(df, {"rows": F.count("*"), **{c: F.count_if(missing(df, c)) for c in df.columns}})
        need = got["rows"] if min_non_null is None else min_non_null
        params["columns"] = [c for c in df.columns if got["rows"] - got[c] < need]
    elif method == "mean":
        params["values"] = agg_dict(df, {c: F.avg(value(df, c).cast("double")) for c in nums})
    elif method == "median":
        params["values"] = {c: v[0] for c, v in quantiles(df, nums, [0.5]).items()}
    elif method == "mode":
        # counts combine before the shuffle; smallest value wins a tie
        params["values"] = {c: column_mode(df, c) for c in (columns or df.columns)
                            if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))}
    elif method == "constant":
        params.update(fill_value=fill_value, columns=list(columns) if columns else None)
    elif method in ORDERED:
        if not order_by:
            raise ValueError("an ordered fill needs order_by")
        cols = nums if method not in ("ffill", "bfill") else [
            c for c in (columns or df.columns) if c not in set(order_by) | set(partition_by)]
        params.update(columns=cols, order_by=list(order_by), partition_by=list(partition_by), limit=limit)
    else:
        raise ValueError(f"unknown method: {method}")
    return params


def column_mode(df: DataFrame, name: str):
    """Most frequent value, smallest on ties; value counts spread over the shuffle."""
    counts = df.select(value(df, name).alias("v")).filter("v is not null").groupBy("v").count()
    row = counts.orderBy(F.desc("count"), "v").first()
    return row["v"] if row else None


@operation("handle_missing_values")
def apply(df: DataFrame, params: dict) -> DataFrame:
    m = params["method"]
    if m == "drop_rows":
        return drop_missing(df, params.get("columns"))
    if m == "drop_cols":
        return df.drop(*params["columns"])
    if m in STATISTICS:
        return df.withColumns({c: F.coalesce(value(df, c), F.lit(v).cast(_fill_type(df, c, m)))
                               for c, v in params["values"].items() if v is not None})
    if m == "constant":
        v = params["fill_value"]
        out = {}
        for c in params.get("columns") or df.columns:
            t = df.schema[c].dataType
            fits = isinstance(t, T.StringType) if isinstance(v, str) else isinstance(t, T.NumericType)
            if fits:
                out[c] = F.coalesce(value(df, c), F.lit(v).cast(t))
        return df.withColumns(out)
    if m in ("ffill", "bfill"):
        return _directional(df, params, m == "ffill")
    return _interpolate(df, params)


def _fill_type(df: DataFrame, name: str, method: str):
    t = df.schema[name].dataType
    return t if method == "mode" or isinstance(t, (T.DoubleType, T.FloatType)) else T.DoubleType()


def impute(df: DataFrame, method: str, **kw) -> DataFrame:
    return apply(df, fit(df, method, **kw))


def _positions(df: DataFrame, params: dict) -> DataFrame:
    """Row position and, per column, the number of known values before the row."""
    sums = {"__pos": F.lit(1).cast("long")}
    sums.update({f"__n_{c}": (~missing(df, c)).cast("long") for c in params["columns"]})
    return running(df, params["order_by"], sums, params["partition_by"])


def _directional(df: DataFrame, params: dict, forward: bool) -> DataFrame:
    cols, part, limit = params["columns"], params["partition_by"], params.get("limit")
    if limit is None:
        names = {f"__f_{c}": value(df, c) for c in cols}
        out = fill_edges(df, params["order_by"], names, forward, part)
        return out.withColumns({c: q(f"__f_{c}") for c in cols}).drop(*names)
    pos = _positions(df, params)
    names = {f"__f_{c}": F.when(~missing(df, c), F.struct(q("__pos").alias("p"), q(c).alias("v"))) for c in cols}
    out = fill_edges(pos, ["__pos"], names, forward, part, dense=True)
    near = {c: F.abs(q("__pos") - q(f"__f_{c}")["p"]) <= limit for c in cols}
    return out.withColumns({c: F.when(near[c], q(f"__f_{c}")["v"]) for c in cols}).drop("__pos", *names, *[f"__n_{c}" for c in cols])


def _interpolate(df: DataFrame, params: dict) -> DataFrame:
    """Fill gaps between known values by position, piecewise cubic or linear.

    Known values carry (position, value, slope); each gap row finds the known
    value before and after it through range-wise carries, never by collecting
    the series."""
    method, cols, part, limit = params["method"], params["columns"], params["partition_by"], params.get("limit")
    out = _positions(df, params)
    for c in cols:
        v = value(df, c).cast("double")
        if method != "linear":
            knots = out.select(*part, "__pos", q(f"__n_{c}").alias("k"), v.alias("v")).filter("v is not null")
            slopes = _slopes(knots, method, part)
            if method != "akima":
                out = _with_ends(out, slopes, part, f"__e_{c}")
            out = out.join(slopes.select(*part, "__pos", "slope"), [*part, "__pos"], "left")
        else:
            out = out.withColumn("slope", F.lit(0.0))
        out = out.withColumn(f"__k_{c}", F.when(v.isNotNull(), F.struct(
            q("__pos").alias("p"), v.alias("v"), q("slope").alias("d")))).drop("slope")
    out = fill_edges(out, ["__pos"], {f"__a_{c}": q(f"__k_{c}") for c in cols}, True, part, dense=True)
    out = fill_edges(out, ["__pos"], {f"__b_{c}": q(f"__k_{c}") for c in cols}, False, part, dense=True)
    new = {}
    for c in cols:
        a, b = q(f"__a_{c}"), q(f"__b_{c}")
        filled = _between(method, q("__pos"), a, b, q(f"__e_{c}") if f"__e_{c}" in out.columns else None)
        if limit is not None:
            close = (F.coalesce(q("__pos") - a["p"] <= limit, F.lit(False))
                     | F.coalesce(b["p"] - q("__pos") <= limit, F.lit(False)))
            filled = F.when(close, filled)
        new[c] = F.coalesce(value(df, c).cast("double"), filled)
    return out.withColumns(new).drop("__pos", *[f"__{k}_{c}" for c in cols for k in "kabne"])


def _with_ends(df: DataFrame, knots: DataFrame, part: Sequence[str], name: str) -> DataFrame:
    """Attach the two first and two last known points (four at most per series)."""
    part = list(part)
    span = knots.groupBy(*part).agg(F.max("k").alias("last")) if part else knots.agg(F.max("k").alias("last"))
    tagged = knots.join(span, part) if part else knots.crossJoin(F.broadcast(span))  # one row
    edge = tagged.filter((F.col("k") < 2) | (F.col("k") >= F.col("last") - 1))
    point = F.struct(F.col("k"), F.col("__pos").alias("p"), F.col("v"), F.col("slope").alias("d"))
    ends = edge.groupBy(*part).agg(F.sort_array(F.collect_list(point)).alias(name))
    return df.join(ends, part, "left") if part else df.crossJoin(F.broadcast(ends))  # one row


def _cubic(pos: Column, a: Column, b: Column) -> Column:
    """Cubic through two points with given slopes."""
    h = b["p"] - a["p"]
    t = (pos - a["p"]) / h
    return ((1 + 2 * t) * (1 - t) * (1 - t) * a["v"] + t * (1 - t) * (1 - t) * h * a["d"]
            + t * t * (3 - 2 * t) * b["v"] + t * t * (t - 1) * h * b["d"])


def _between(method: str, pos: Column, a: Column, b: Column, ends: Column | None) -> Column:
    """Value at ``pos`` from the known points before and after it.

    Outside the known range a line holds the nearest value, Akima leaves the
    gap, and the other cubics continue their end piece."""
    both = a.isNotNull() & b.isNotNull()
    if method == "linear":
        inner = a["v"] + (b["v"] - a["v"]) * (pos - a["p"]) / (b["p"] - a["p"])
        return F.when(both, inner).otherwise(F.coalesce(a["v"], b["v"]))
    inside = F.when(both, _cubic(pos, a, b))
    if ends is None:
        return inside
    n = F.size(ends)
    before = _cubic(pos, F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.lit(2)))
    after = _cubic(pos, F.try_element_at(ends, F.lit(-2)), F.try_element_at(ends, F.lit(-1)))
    one = F.try_element_at(ends, F.lit(1))["v"]
    return F.coalesce(inside, F.when(n == 1, one).when(a.isNull(), before).otherwise(after))


def _slopes(k: DataFrame, method: str, part: Sequence[str]) -> DataFrame:
    """``__pos, k, v, slope`` per known value; neighbours come from overlapping blocks."""
    part = list(part)
    if method == "spline":
        return _spline_slopes(k, part)
    blocks, w = halo(k, "k", 2, 2, part)
    x = {j: (F.lag if j < 0 else F.lead)(q("__pos"), abs(j)).over(w) for j in (-2, -1, 1, 2)}
    y = {j: (F.lag if j < 0 else F.lead)(q("v"), abs(j)).over(w) for j in (-2, -1, 1, 2)}
    cols = {f"x{j}": e for j, e in x.items()} | {f"y{j}": e for j, e in y.items()}
    t = home_rows(blocks.withColumns(cols))

    def m(i, j):  # secant between knots i and j
        xi, yi = (q("__pos"), q("v")) if i == 0 else (q(f"x{i}"), q(f"y{i}"))
        xj, yj = (q("__pos"), q("v")) if j == 0 else (q(f"x{j}"), q(f"y{j}"))
        return (yj - yi) / (xj - xi)

    m_a, m_b, m_c, m_d = m(-2, -1), m(-1, 0), m(0, 1), m(1, 2)
    if method == "akima":
        # secants missing at the ends continue the trend of their neighbours
        b = F.coalesce(m_b, 2 * m_c - m_d, m_c)
        c = F.coalesce(m_c, 2 * m_b - m_a, m_b)
        a = F.coalesce(m_a, 2 * b - c)
        d = F.coalesce(m_d, 2 * c - b)
        wa, wb = F.abs(d - c), F.abs(b - a)
        slope = F.when(wa + wb > 1e-12, (wa * b + wb * c) / (wa + wb)).otherwise((b + c) / 2)
    else:
        hb, hc = q("__pos") - q("x-1"), q("x1") - q("__pos")
        w1, w2 = 2 * hc + hb, hc + 2 * hb
        mid = F.when(m_b * m_c <= 0, 0.0).otherwise((w1 + w2) / (w1 / m_b + w2 / m_c))

        def end(h0, h1, s0, s1):
            d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            d = F.when(F.signum(d) != F.signum(s0), 0.0).when(
                (F.signum(s0) != F.signum(s1)) & (F.abs(d) > 3 * F.abs(s0)), 3 * s0).otherwise(d)
            return F.coalesce(d, s0)
        left = end(hc, q("x2") - q("x1"), m_c, m_d)
        right = end(hb, q("x-1") - q("x-2"), m_b, m_a)
        slope = F.when(m_b.isNull(), left).when(m_c.isNull(), right).otherwise(mid)
    return t.select(*part, "__pos", "k", "v", F.coalesce(slope, F.lit(0.0)).alias("slope"))


#: Knots shared between neighbouring blocks; a spline forgets a boundary by a factor 3.7 per knot.
_SPLINE_REACH = 48


def _spline_slopes(k: DataFrame, part: list[str]) -> DataFrame:
    """Slopes of the not-a-knot cubic spline, solved on overlapping blocks."""
    last = k.groupBy(*part).agg(F.max("k").alias("last")) if part else k.agg(F.max("k").alias("last"))
    k = k.join(last, part) if part else k.crossJoin(F.broadcast(last))  # one row
    blocks, _ = halo(k, "k", _SPLINE_REACH, _SPLINE_REACH, part, rows=100_000)
    keys = [f.name for f in k.schema.fields if f.name in part]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in k.schema.fields if f.name in keys),
                        "`__pos` bigint", "k bigint", "v double", "slope double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x, y = pdf["__pos"].to_numpy(float), pdf["v"].to_numpy(float)
        d = spline_slopes(x, y, pdf["k"].iloc[0] == 0, pdf["k"].iloc[-1] == pdf["last"].iloc[0])
        return pdf.assign(slope=d)[pdf["__home"]][[*keys, "__pos", "k", "v", "slope"]]

    return blocks.groupBy(*part, "__bucket").applyInPandas(solve, schema)


def spline_slopes(x: np.ndarray, y: np.ndarray, true_left: bool = True, true_right: bool = True) -> np.ndarray:
    """Derivatives of a cubic spline at its knots (not-a-knot at true ends)."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    if n == 2:
        return np.array([s[0], s[0]])
    if n == 3 and true_left and true_right:  # one parabola
        c = (s[1] - s[0]) / (x[2] - x[0])
        return np.array([s[0] - c * h[0], s[0] + c * h[0], s[1] + c * h[1]])
    lo, di, up, r = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    lo[1:-1], up[1:-1] = h[1:], h[:-1]
    di[1:-1] = 2 * (h[1:] + h[:-1])
    r[1:-1] = 3 * (h[1:] * s[:-1] + h[:-1] * s[1:])
    if true_left:
        di[0], up[0] = h[1], h[0] + h[1]
        r[0] = ((h[0] + 2 * up[0]) * h[1] * s[0] + h[0] ** 2 * s[1]) / up[0]
    else:
        r[0] = s[0]
    if true_right:
        di[-1], lo[-1] = h[-2], h[-1] + h[-2]
        r[-1] = (h[-1] ** 2 * s[-2] + (2 * lo[-1] + h[-1]) * h[-2] * s[-1]) / lo[-1]
    else:
        r[-1] = s[-1]
    for i in range(1, n):
        f = lo[i] / di[i - 1]
        di[i] -= f * up[i - 1]
        r[i] -= f * r[i - 1]
    d = np.zeros(n)
    d[-1] = r[-1] / di[-1]
    for i in range(n - 2, -1, -1):
        d[i] = (r[i] - up[i] * d[i + 1]) / di[i]
    return d


