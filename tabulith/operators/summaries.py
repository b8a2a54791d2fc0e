"""The tables behind plots: bins, boxes, densities, fits, projections."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solvers, special
from ..functions.columns import agg_dict, drop_missing, q, rows_frame, value
from ..functions.folds import unit_hash
from ..functions.gram import gram
from ..functions.quantiles import quantiles


def _ends(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    x = {c: value(df, c).cast("double") for c in cols}
    got = agg_dict(df, {(c, s): f(e) for c, e in x.items() for s, f in (("a", F.min), ("b", F.max), ("n", F.count))})
    return {c: (got[(c, "a")], got[(c, "b")], got[(c, "n")]) for c in cols}


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin, the top edge inside the last one."""
    if hi <= lo:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """``bin, lo, hi, n, density, cumulative`` including empty bins."""
    lo, hi, n = _ends(df, [col])[col]
    x = value(df, col).cast("double")
    width = (hi - lo) / bins if hi > lo else 1.0
    counts = df.filter(x.isNotNull()).groupBy(bin_index(x, lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row per bin
    return out.select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "n",
                      (F.col("n") / (n * width)).alias("density"), F.sum("n").over(w).alias("cumulative"))


def box(df: DataFrame, cols: Sequence[str], whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at data, flier counts and mean per column."""
    qs = quantiles(df, cols, (0.25, 0.5, 0.75))
    aggs = {}
    for c in cols:
        x, (a, _, b) = value(df, c).cast("double"), qs[c]
        lo, hi = a - whis * (b - a), b + whis * (b - a)
        aggs.update({(c, "lo"): F.min(F.when(x >= lo, x)), (c, "hi"): F.max(F.when(x <= hi, x)),
                     (c, "out"): F.count_if((x < lo) | (x > hi)), (c, "mean"): F.avg(x)})
    got = agg_dict(df, aggs)
    return rows_frame(df.sparkSession, [(c, *qs[c], got[(c, "lo")], got[(c, "hi")], got[(c, "out")], got[(c, "mean")]) for c in cols],
                      "column string, q1 double, median double, q3 double, whisker_lo double, whisker_hi double, fliers bigint, mean double")


def density(df: DataFrame, col: str, grid: int = 300, by: str | None = None, margin: float = 0.0,
            span: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian density (Scott bandwidth) on a fixed grid, per group if asked.

    Tasks add kernel sums for the few grid points; distinct values are counted
    first so repeated values cost one evaluation."""
    x = value(df, col).cast("double")
    g = q(by).cast("string") if by else F.lit("")
    stats = {r["g"]: r for r in df.groupBy(g.alias("g")).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("a"),
                                                             F.max(x).alias("b")).collect()}
    a, b = min(r["a"] for r in stats.values()), max(r["b"] for r in stats.values())
    if span is None:
        span = (a - margin * (b - a), b + margin * (b - a))
    pts = np.linspace(*span, grid)
    scale = {k: (r["n"], (r["sd"] or 1.0) * r["n"] ** -0.2) for k, r in stats.items()}

    def sums(batches):
        acc: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby("g"):
                n, h = scale[k]
                v, m = part["v"].to_numpy(float), part["m"].to_numpy(float)
                for at in range(0, len(v), 4096):
                    z = (pts[None, :] - v[at:at + 4096, None]) / h
                    s = m[at:at + 4096] @ np.exp(-0.5 * z * z)
                    acc[k] = acc.get(k, 0) + s
        for k, s in acc.items():
            n, h = scale[k]
            yield pd.DataFrame({"g": k, "i": np.arange(grid), "s": s / (n * h * math.sqrt(2 * math.pi))})

    counts = df.select(g.alias("g"), x.alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("m"))
    out = counts.mapInPandas(sums, "g string, i int, s double").groupBy("g", "i").agg(F.sum("s").alias("density"))
    out = out.withColumn("x", F.lit(span[0]) + F.col("i") * ((span[1] - span[0]) / (grid - 1)))
    return out.select(*([F.col("g").alias(by)] if by else []), "i", "x", "density")


def violin(df: DataFrame, col: str, grid: int = 100) -> DataFrame:
    """Density rows with the box of the column beside them."""
    return density(df, col, grid).withColumn("column", F.lit(col)).join(F.broadcast(box(df, [col])), "column")


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int = 1, grid: int = 300, level: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(coefficients, curve with a confidence band) from one Gram of powers."""
    rows = drop_missing(df.select(value(df, x).cast("double").alias("x"), value(df, y).cast("double").alias("y")))
    a, b, n = _ends(rows, ["x"])["x"]
    mid, half = (a + b) / 2, (b - a) / 2 or 1.0
    z = (F.col("x") - mid) / half  # powers of a scaled variable stay well conditioned
    g = gram(rows, {**{f"p{k}": F.pow(z, F.lit(float(k))) for k in range(1, degree + 1)}, "y": F.col("y")})[None]
    names = [f"p{k}" for k in range(1, degree + 1)]
    coef, b0 = solvers.fit(g, "y", names, lambda m, v, _n: solvers.ols(m, v))
    rss, _, n = solvers.sse(g, "y", names, coef, b0)
    poly = np.poly1d([*coef[::-1], b0])(np.poly1d([1 / half, -mid / half]))
    spark = df.sparkSession
    coefs = rows_frame(spark, [(k, float(c)) for k, c in enumerate(poly.coeffs[::-1])], "power int, coefficient double")
    xs = np.linspace(a, b, grid)
    zs = np.column_stack([((xs - mid) / half) ** k for k in range(1, degree + 1)])
    inv = np.linalg.pinv(g.pick(names).centred())
    dev = zs - g.pick(names).mean
    dof = n - degree - 1
    t = _t_point((1 + level) / 2, dof)
    se = np.sqrt(rss / dof * (1 / n + np.einsum("ij,jk,ik->i", dev, inv, dev)))
    fitted = zs @ coef + b0
    curve = rows_frame(spark, list(zip(xs.tolist(), fitted.tolist(), (fitted - t * se).tolist(), (fitted + t * se).tolist())),
                       "x double, y double, low double, high double")
    return coefs, curve


def _t_point(p: float, dof: float) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - special.t_two_sided(mid, dof) / 2 < p else (lo, mid)
    return lo


def bins_2d(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """``bx, by, n`` for occupied cells."""
    ends = _ends(df, [x, y])
    cells = [bin_index(value(df, c).cast("double"), *ends[c][:2], bins).alias(n) for c, n in ((x, "bx"), (y, "by"))]
    return df.select(*cells).na.drop().groupBy("bx", "by").agg(F.count("*").alias("n"))


def joint(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Cells with both margins, by ``kind``."""
    cells = bins_2d(df, x, y, bins)
    null = F.lit(None).cast("int")
    mx = cells.groupBy("bx").agg(F.sum("n").alias("n")).select(F.lit("x").alias("kind"), "bx", null.alias("by"), "n")
    my = cells.groupBy("by").agg(F.sum("n").alias("n")).select(F.lit("y").alias("kind"), null.alias("bx"), "by", "n")
    return cells.select(F.lit("xy").alias("kind"), "bx", "by", "n").unionByName(mx).unionByName(my)


def pair_grid(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """Histograms on the diagonal, cells off it; all panels in one scan."""
    ends = _ends(df, cols)
    b = {c: bin_index(value(df, c).cast("double"), *ends[c][:2], bins) for c in cols}
    items = [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), b[c].alias("ba"), b[c].alias("bb")) for c in cols]
    items += [F.struct(F.lit(a).alias("col_a"), F.lit(c).alias("col_b"), b[a].alias("ba"), b[c].alias("bb")) for a, c in combinations(cols, 2)]
    return df.select(F.inline(F.array(*items))).na.drop().groupBy("col_a", "col_b", "ba", "bb").agg(F.count("*").alias("n"))


def parallel_coordinates(df: DataFrame, cols: Sequence[str], key: Sequence[str], mode: str = "minmax") -> DataFrame:
    """Scaled values in long form, one row per key and axis."""
    rows = drop_missing(df.select(*[q(k) for k in key], *[q(c).cast("double").alias(c) for c in cols]), cols)
    fns = (F.min, F.max) if mode == "minmax" else (F.avg, F.stddev_samp)
    got = agg_dict(rows, {(c, i): f(q(c)) for c in cols for i, f in enumerate(fns)})
    items = []
    for i, c in enumerate(cols):
        a, b = got[(c, 0)], got[(c, 1)]
        width = (b - a if mode == "minmax" else b) + 1e-12
        items.append(F.struct(F.lit(i).alias("axis"), F.lit(c).alias("column"), ((q(c) - a) / width).alias("value")))
    return rows.select(*[q(k) for k in key], F.inline(F.array(*items)))


def stacked_area(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Running sum across columns with missing as zero."""
    acc, out = F.lit(0.0), {}
    for c in cols:
        acc = acc + F.coalesce(value(df, c).cast("double"), F.lit(0.0))
        out[f"top_{c}"] = acc
    return df.select(*[q(k) for k in key], *[e.alias(n) for n, e in out.items()])


def candles(df: DataFrame, order_by: Sequence[str], open_: str, high: str, low: str, close: str, last: int = 300,
            widths: Sequence[int] = (5, 20, 50)) -> DataFrame:
    """The last rows with an up flag and trailing means over those rows."""
    tail = df.orderBy(*[F.desc(q(k)) for k in order_by]).limit(last)
    w = Window.orderBy(*[q(k) for k in order_by])  # at most ``last`` rows
    out = tail.select(*[q(k) for k in order_by], *[q(c) for c in (open_, high, low, close)], (q(close) >= q(open_)).alias("up"))
    for k in widths:
        f = w.rowsBetween(1 - k, 0)
        out = out.withColumn(f"ma_{k}", F.when(F.count(q(close)).over(f) == k, F.avg(q(close)).over(f)))
    return out


def point_sample(df: DataFrame, key: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """A repeatable sample by key hash."""
    return df.filter(unit_hash(list(key), seed) < share)


def pca(df: DataFrame, cols: Sequence[str], k: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, explained variance, loadings) of standardised complete rows."""
    rows = drop_missing(df, cols)
    g = gram(rows, {c: q(c) for c in cols})[None]
    scale = g.sd(0) + 1e-8
    cov = g.cov(1) / np.outer(scale, scale)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:k]
    vecs = vecs[:, order]
    vecs = vecs * np.where(vecs[np.abs(vecs).argmax(0), np.arange(vecs.shape[1])] < 0, -1, 1)
    scores = rows
    for j in range(vecs.shape[1]):
        s = reduce(lambda a, b: a + b, [float(vecs[i, j] / scale[i]) * (q(c) - float(g.mean[i])) for i, c in enumerate(cols)])
        scores = scores.withColumn(f"pc{j + 1}", s)
    spark = df.sparkSession
    var = rows_frame(spark, [(j + 1, float(vals[o]), float(vals[o] / vals.sum())) for j, o in enumerate(order)],
                     "component int, variance double, ratio double")
    load = rows_frame(spark, [(j + 1, c, float(vecs[i, j])) for j in range(vecs.shape[1]) for i, c in enumerate(cols)],
                      "component int, column string, loading double")
    return scores, var, load


def variant_density(df: DataFrame, stacked: DataFrame, col: str, best: int, grid: int = 200) -> DataFrame:
    """Density of the raw column and of each variant on one grid, best marked."""
    raw = df.select(F.lit("original").alias("variant"), value(df, col).cast("double").alias(col))
    var = stacked.select(q("variant_id").cast("string").alias("variant"), q(col))
    return density(raw.unionByName(var), col, grid, by="variant", margin=0.05).withColumn("best", F.col("variant") == str(best))


def shap_points(phi: DataFrame, top: int = 10) -> DataFrame:
    """Long attribution rows of the leading features, scaled by the largest size."""
    lead = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("m")).orderBy(F.desc("m"), "feature").limit(top)
    peak = phi.agg(F.max(F.abs("phi")).alias("peak"))
    return (phi.join(F.broadcast(lead.select("feature")), "feature").crossJoin(F.broadcast(peak))  # one row
            .withColumn("phi_scaled", F.try_divide("phi", "peak")).drop("peak"))

