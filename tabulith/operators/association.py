"""Dependence between columns.  Results are long ``col_a, col_b, value`` rows, one
per unordered pair (column order) or per ordered pair for directed measures."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import accumulate, combinations, permutations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import contingency as ct
from ..functions import grids, solvers, special
from ..functions.columns import agg_dict, drop_missing, fin, numeric_columns, q, rows_frame, string_columns, value
from ..functions.dominance import dominance_sums
from ..functions.folds import fold, unit_hash
from ..functions.gram import gram, total
from ..functions.neighbors import distinct_points, knn
from ..functions.ordering import dense_index, halo, home_rows, order_bucket, running, with_lags, with_ranks
from ..functions.quantiles import quantiles
from ..session import cut_lineage

PAIR = "col_a string, col_b string, value double"


def _cols(df: DataFrame, columns) -> list[str]:
    return list(columns) if columns is not None else numeric_columns(df)


def _complete(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    keep = [k for k in dict.fromkeys(keep) if k not in cols]
    return drop_missing(df.select(*[q(k) for k in keep], *[q(c).cast("double").alias(c) for c in cols]), cols)


def _exprs(cols: Sequence[str]) -> dict[str, Column]:
    return {c: q(c) for c in cols}


def matrix_rows(spark, names: Sequence[str], m: np.ndarray) -> DataFrame:
    return rows_frame(spark, [(a, b, fin(m[i][j])) for (i, a), (j, b) in combinations(enumerate(names), 2)], PAIR)


def symmetric(pairs: DataFrame, names: Sequence[str], diagonal: float = 1.0) -> DataFrame:
    """Both directions and the diagonal of an unordered-pair result."""
    flip = pairs.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "value")
    diag = rows_frame(pairs.sparkSession, [(n, n, diagonal) for n in names], PAIR)
    return pairs.select("col_a", "col_b", "value").unionByName(flip).unionByName(diag)


# ---- linear and rank -------------------------------------------------------

def pearson(df: DataFrame, columns=None) -> DataFrame:
    """Pairwise-complete linear correlation; NULL where a side is constant."""
    cols = _cols(df, columns)
    x = {c: value(df, c).cast("double") for c in cols}
    first = agg_dict(df, {**{("n", c): F.count(e) for c, e in x.items()}, **{("m", c): F.avg(e) for c, e in x.items()},
                          "rows": F.count("*")})
    if all(first[("n", c)] == first["rows"] for c in cols):
        centre = {c: first[("m", c)] for c in cols}
        return matrix_rows(df.sparkSession, cols, gram(df, x, centre=centre)[None].corr()) if first["rows"] else rows_frame(df.sparkSession, [], PAIR)
    z = {c: e - (first[("m", c)] or 0.0) for c, e in x.items()}
    sums = {}
    for a, b in combinations(cols, 2):
        both = z[a].isNotNull() & z[b].isNotNull()
        u, v = F.when(both, z[a]), F.when(both, z[b])
        for s, e in (("n", F.count(u)), ("u", F.sum(u)), ("v", F.sum(v)), ("uu", F.sum(u * u)), ("vv", F.sum(v * v)), ("uv", F.sum(u * v))):
            sums[(a, b, s)] = e
    got = agg_dict(df, sums)
    rows = []
    for a, b in combinations(cols, 2):
        n, u, v, uu, vv, uv = (got[(a, b, s)] or 0.0 for s in ("n", "u", "v", "uu", "vv", "uv"))
        du, dv = n * uu - u * u, n * vv - v * v
        rows.append((a, b, (n * uv - u * v) / math.sqrt(du * dv) if du > 0 and dv > 0 else None))
    return rows_frame(df.sparkSession, rows, PAIR)


def _null_counts(df: DataFrame, cols) -> dict:
    return agg_dict(df, {c: F.count_if(value(df, c).isNull()) for c in cols})


def _of_ranks(rows: DataFrame, cols: list[str]) -> DataFrame:
    ranked = with_ranks(rows, cols).select(*[q(f"{c}_rank") for c in cols]).persist()
    out = pearson(ranked, [f"{c}_rank" for c in cols])
    ranked.unpersist()
    return out


def spearman(df: DataFrame, columns=None) -> DataFrame:
    """Linear correlation of average ranks, ranks taken within complete pairs."""
    cols = _cols(df, columns)
    nulls = _null_counts(df, cols)
    clean = [c for c in cols if not nulls[c]]
    rename = {f"{c}_rank": c for c in cols}
    parts = []
    if len(clean) > 1:
        parts.append(_of_ranks(df.select(*[q(c) for c in clean]), clean))
    for a, b in combinations(cols, 2):
        if nulls[a] or nulls[b]:
            parts.append(_of_ranks(_complete(df, [a, b]), [a, b]))
    out = reduce(DataFrame.unionByName, parts)
    back = F.create_map(*[F.lit(v) for kv in rename.items() for v in kv])
    return out.withColumns({"col_a": back[F.col("col_a")], "col_b": back[F.col("col_b")]})


def kendall_pair(df: DataFrame, a: str, b: str) -> float | None:
    """Tau-b from dominance counts and tie counts; no row pairs are formed."""
    rows = _complete(df, [a, b])
    n = rows.count()
    pts = dominance_sums(rows, q(a), q(b), [F.lit(1)], rows=n).persist()

    def ties(key):
        return pts.groupBy(*key).agg(F.sum("cnt").cast("double").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0] or 0.0

    got = agg_dict(pts, {"c": F.sum(F.col("cnt") * F.col("d0")),
                         "xy": F.sum(F.col("cnt").cast("double") * (F.col("cnt") - 1) / 2)})
    tx, ty, all_pairs = ties(["x"]), ties(["y"]), n * (n - 1) / 2
    pts.unpersist()
    if n < 2:
        return None
    disc = all_pairs - tx - ty + got["xy"] - got["c"]
    den = math.sqrt((all_pairs - tx) * (all_pairs - ty))
    return (got["c"] - disc) / den if den > 0 else None


def kendall(df: DataFrame, columns=None) -> DataFrame:
    cols = _cols(df, columns)
    return rows_frame(df.sparkSession, [(a, b, kendall_pair(df, a, b)) for a, b in combinations(cols, 2)], PAIR)


def blomqvist(df: DataFrame, columns=None) -> DataFrame:
    """Mean sign product around the medians, values on a median left out."""
    cols = _cols(df, columns)
    rows = _complete(df, cols)
    med = {c: v[0] for c, v in quantiles(rows, cols, [0.5]).items()}
    s = {c: F.signum(q(c) - med[c]) for c in cols}
    got = agg_dict(rows, {(a, b): F.avg(F.when(s[a] * s[b] != 0, s[a] * s[b])) for a, b in combinations(cols, 2)})
    return rows_frame(df.sparkSession, [(a, b, fin(v)) for (a, b), v in got.items()], PAIR)


def chatterjee_pair(df: DataFrame, x: str, y: str, tie_key: str) -> float | None:
    """1 - 3 sum|rank steps| / (n^2 - 1) along x; ties in x by the key.

    Steps inside a value range come from a window, steps between ranges from
    each range's first and last rank."""
    rows = _complete(df, [x, y], [tie_key])
    n = rows.count()
    if n < 3:
        return None
    ranked = order_bucket(with_ranks(rows, [y], {y: "__r"}), [x, tie_key])
    order = [q(x), q(tie_key)]
    w = Window.partitionBy("__bucket").orderBy(*order)
    per = (ranked.withColumn("__d", F.abs(F.col("__r") - F.lag("__r").over(w)))
           .groupBy("__bucket").agg(F.sum("__d").alias("s"), F.min_by("__r", F.struct(*order)).alias("a"),
                                    F.max_by("__r", F.struct(*order)).alias("b")))
    edge = F.abs(F.col("a") - F.lag("b").over(Window.orderBy("__bucket")))  # one row per range
    steps = per.withColumn("e", edge).agg(F.sum(F.coalesce("s", F.lit(0.0)) + F.coalesce("e", F.lit(0.0)))).first()[0]
    return 1 - 3 * steps / (n * n - 1.0)


def chatterjee(df: DataFrame, columns, tie_key: str) -> DataFrame:
    cols = _cols(df, columns)
    rows = _complete(df, cols, [tie_key])
    return rows_frame(df.sparkSession, [(a, b, chatterjee_pair(rows, a, b, tie_key)) for a, b in combinations(cols, 2)], PAIR)


# ---- dominance based ---------------------------------------------------------

def _row_sums(pts: DataFrame, v: str, n: float, out: str) -> DataFrame:
    """``v, out``: sum of absolute distances from each value to all rows."""
    vals = pts.groupBy(v).agg(F.sum("cnt").alias("c"))
    run = running(vals, [v], {"__n": F.col("c"), "__s": F.col("c") * F.col(v)})
    tot = pts.agg(F.sum(F.col("cnt") * F.col(v)).alias("t"))
    run = run.crossJoin(F.broadcast(tot))  # one row
    below = F.col(v) * F.col("__n") - F.col("__s")
    above = (F.col("t") - F.col("__s")) - F.col(v) * (F.lit(float(n)) - F.col("__n"))
    return run.select(v, (below + above).alias(out))


def distance_correlation_pair(df: DataFrame, a: str, b: str) -> float | None:
    """Exact n log n distance correlation from dominance and prefix sums."""
    rows = _complete(df, [a, b])
    base = agg_dict(rows, {"n": F.count("*"), "ma": F.avg(q(a)), "mb": F.avg(q(b)), "sa": F.stddev_pop(q(a)), "sb": F.stddev_pop(q(b))})
    n = base["n"]
    if n < 2 or not base["sa"] or not base["sb"]:
        return 0.0 if n > 1 else None
    x, y = (q(a) - base["ma"]) / base["sa"], (q(b) - base["mb"]) / base["sb"]
    base_pts = dominance_sums(rows, x, y, [F.lit(1), x, y, x * y], rows=n).persist()
    pts = base_pts.join(_row_sums(base_pts, "x", n, "ax"), "x").join(_row_sums(base_pts, "y", n, "by"), "y")
    m, c = F.col, F.col("cnt")
    got = agg_dict(pts, {
        "conc": F.sum(c * (m("x") * m("y") * m("d0") - m("x") * m("d2") - m("y") * m("d1") + m("d3"))),
        "x": F.sum(c * m("x")), "y": F.sum(c * m("y")), "xx": F.sum(c * m("x") * m("x")), "yy": F.sum(c * m("y") * m("y")),
        "xy": F.sum(c * m("x") * m("y")), "a": F.sum(c * m("ax")), "b": F.sum(c * m("by")),
        "aa": F.sum(c * m("ax") * m("ax")), "bb": F.sum(c * m("by") * m("by")), "ab": F.sum(c * m("ax") * m("by"))})
    base_pts.unpersist()

    def dcov(s, ab, ta, tb):
        return s / n ** 2 - 2 * ab / n ** 3 + ta * tb / n ** 4

    s_xy = 4 * got["conc"] - 2 * (n * got["xy"] - got["x"] * got["y"])
    cov = dcov(s_xy, got["ab"], got["a"], got["b"])
    vx = dcov(2 * (n * got["xx"] - got["x"] ** 2), got["aa"], got["a"], got["a"])
    vy = dcov(2 * (n * got["yy"] - got["y"] ** 2), got["bb"], got["b"], got["b"])
    return math.sqrt(min(1.0, max(cov, 0.0) / math.sqrt(vx * vy))) if vx > 0 and vy > 0 else 0.0


def distance_correlation(df: DataFrame, columns=None) -> DataFrame:
    cols = _cols(df, columns)
    rows = _complete(df, cols)
    return rows_frame(df.sparkSession, [(a, b, distance_correlation_pair(rows, a, b)) for a, b in combinations(cols, 2)], PAIR)


# fixed values: validity limits of Hoeffding's statistic
MODAL_LIMIT, D_RANGE, D_MIN_ROWS = 0.5, (-0.5, 1.0), 5


def hoeffding_pair(df: DataFrame, a: str, b: str) -> float | None:
    rows = _complete(df, [a, b])
    n = rows.count()
    if n < D_MIN_ROWS:
        return None
    base = dominance_sums(rows, q(a), q(b), [F.lit(1)], rows=n).persist()
    pts = base
    for v in ("x", "y"):
        vals = base.groupBy(v).agg(F.sum("cnt").alias("c"))
        if vals.agg(F.max("c")).first()[0] / n > MODAL_LIMIT:
            return None
        ranks = running(vals, [v], {"lt": F.col("c")}).select(v, (F.col("lt") + (F.col("c") + 1) / 2.0).alias(f"r{v}"))
        pts = pts.join(ranks, v)
    c, r, s, d = F.col("cnt"), F.col("rx"), F.col("ry"), F.col("d0")
    got = agg_dict(pts, {"d1": F.sum(c * d * (d - 1)), "d2": F.sum(c * (r - 1) * (r - 2) * (s - 1) * (s - 2)),
                         "d3": F.sum(c * (r - 2) * (s - 2) * d)})
    base.unpersist()
    num = (n - 2) * (n - 3) * got["d1"] + got["d2"] - 2 * (n - 2) * got["d3"]
    raw = 30 * num / (float(n) * (n - 1) * (n - 2) * (n - 3) * (n - 4))
    return min(D_RANGE[1], max(D_RANGE[0], raw))


def hoeffding(df: DataFrame, columns=None) -> DataFrame:
    cols = _cols(df, columns)
    rows = _complete(df, cols)
    return rows_frame(df.sparkSession, [(a, b, hoeffding_pair(rows, a, b)) for a, b in combinations(cols, 2)], PAIR)


# ---- binned ------------------------------------------------------------------

def mic(df: DataFrame, columns=None, cap: int | None = None, alpha: float = 0.6) -> DataFrame:
    """Best normalised mutual information over equal-frequency grids nx*ny <= B.

    B = n^alpha, or at most ``cap`` if given (reported).  One side of a grid has at most the root of B bins and is coded;
    the rows then pass in the order of the other side, whose bins are cut on the way, see functions.grids."""
    cols = _cols(df, columns)
    rows = _complete(df, cols)
    n = rows.count()
    budget = max(4, int(n ** alpha) if cap is None else min(int(n ** alpha), cap))
    schema, pairs = PAIR + ", budget int", list(combinations(cols, 2))
    if n < 2 or not pairs:
        return rows_frame(df.sparkSession, [(a, b, 0.0, budget) for a, b in pairs] if n else [], schema)
    ks = range(2, math.isqrt(budget) + 1)
    probs = sorted({i / k for k in ks for i in range(1, k)} | {0.0, 1.0})
    qs = quantiles(rows, cols, probs)
    at = {p: i for i, p in enumerate(probs)}
    edges = {c: {k: ct.quantile_edges([qs[c][at[i / k]] for i in range(k + 1)]) for k in ks} for c in cols}
    fine = {c: sorted({e for es in edges[c].values() for e in es}) for c in cols}
    coded = rows
    for i, c in enumerate(cols):
        # right-closed bins for a left-closed cutter
        cuts = [math.nextafter(e, math.inf) for e in fine[c]]
        coded = (Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=c, outputCol=f"__f{i}").transform(coded) if cuts
                 else coded.withColumn(f"__f{i}", F.lit(0)))
    codes = {c: grids.coarse_codes(edges[c], fine[c]) for c in cols}
    # grids with as many or more bins on the second column, then those with more on the first
    turns = [t for a, b in pairs for t in ((a, b, False), (b, a, True))]
    place = {c: i for i, c in enumerate(cols)}
    items = F.array(*[F.struct(F.lit(o).alias("o"), (q(y) + 0.0).alias("v"), F.col(f"__f{place[x]}").cast("int").alias("f")) for o, (x, y, _) in enumerate(turns)])
    points = coded.select(F.explode(items).alias("p")).select("p.*").groupBy("o", "v", "f").agg(F.count("*").alias("m"))
    best = grids.best_grids(points, n, budget, [(codes[x], strict) for x, _, strict in turns])
    return rows_frame(df.sparkSession, [(a, b, min(1.0, max(best[2 * i], best[2 * i + 1])), budget) for i, (a, b) in enumerate(pairs)], schema)


def binned_mutual_information(df: DataFrame, columns=None, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) of equal-frequency bins for all pairs."""
    cols = _cols(df, columns)
    rows = _complete(df, cols)
    counts = ct.pair_counts(rows, ct.quantile_codes(rows, _exprs(cols), bins), list(combinations(cols, 2)))
    return ct.mutual_information(counts).select("col_a", "col_b", F.col("mi").alias("value"))


def range_counts(values: DataFrame, probes: DataFrame) -> DataFrame:
    """``id, tag, below``: rows of ``values(part, v, m)`` under each probe ``(id, part, v, tag)``, all earlier parts included.

    Tag 0 counts strictly below, tag 2 counts up to and including."""
    both = values.select(F.lit(None).cast("string").alias("id"), "part", "v", F.lit(1).alias("tag"), F.col("m").cast("double").alias("m")) \
        .unionByName(probes.select("id", "part", "v", "tag", F.lit(0.0).alias("m")))
    both = both.groupBy("id", "part", "v", "tag").agg(F.sum("m").alias("m"))
    return running(both, ["part", "v", "tag"], {"below": F.col("m")}).filter("tag <> 1").select("id", "tag", "below")


@F.pandas_udf(T.DoubleType())
def _digamma(s: pd.Series) -> pd.Series:
    x = s.to_numpy(float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return pd.Series(out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240))))


def _within(points: DataFrame, x: str, out: str) -> DataFrame:
    """``points`` (part, pid, m, eps and x) with the rows of the same part nearer than eps in ``x`` alone, the point's own included.

    The neighbour that sets eps often lies on the edge, so the radius is a little less than eps, by more than sums are rounded;
    a zero radius counts the copies."""
    values = points.groupBy("part", F.col(x).alias("v")).agg(F.sum("m").alias("m"))
    less, name = F.greatest(F.col("eps") * 1e-9, (F.abs(x) + F.col("eps")) * 1e-15), F.hex("pid")
    radius = F.greatest(F.col("eps") - less, F.lit(0.0))
    ends = F.explode(F.array(F.struct(F.lit("lo").alias("s"), (F.col(x) - radius).alias("v"), F.lit(0).alias("tag")),
                             F.struct(F.lit("hi").alias("s"), (F.col(x) + radius).alias("v"), F.lit(2).alias("tag"))))
    probes = points.select(name.alias("id"), "part", ends.alias("e")).select(F.concat_ws(":", "id", "e.s").alias("id"), "part", "e.v", "e.tag")
    below = range_counts(values, probes).select(F.substring_index("id", ":", 1).alias("id"), F.substring_index("id", ":", -1).alias("s"), "below")
    count = below.groupBy("id").agg(F.sum(F.when(F.col("s") == "hi", F.col("below")).otherwise(-F.col("below"))).alias(out))
    return points.join(count.withColumn("pid", F.unhex("id")).drop("id"), "pid")


def knn_information(df: DataFrame, pairs: Sequence[tuple[str, str]], k: int = 3) -> dict[tuple[str, str], float]:
    """Nearest-neighbour estimate of the information (nats) between the numeric columns of each pair.

    All pairs share one search: a third coordinate keeps them farther apart than any two points of a pair."""
    pairs = list(pairs)
    cols = sorted({c for p in pairs for c in p})
    rows = _complete(df, cols)
    got = agg_dict(rows, {"n": F.count("*"), **{(c, s): f(q(c)) for c in cols for s, f in (("s", F.stddev_pop), ("a", F.min), ("b", F.max))}})
    n = got["n"]
    if n < 2 or not pairs:
        return {p: 0.0 for p in pairs}
    k = int(max(1, min(k, n - 1)))
    unit = {c: q(c) / (got[(c, "s")] or 1.0) for c in cols}
    span = max((got[(c, "b")] - got[(c, "a")]) / (got[(c, "s")] or 1.0) for c in cols)
    far = 2.0 * span + 1.0
    stacked = rows.select(F.explode(F.array(*[F.struct(unit[a].alias("u"), unit[b].alias("v"), F.lit(i * far).alias("w")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")
    pts = distinct_points(stacked, ["u", "v", "w"])
    eps = knn(pts, 3, k, metric="max", within=1.5 * span + 0.5).select("pid", F.element_at("nn", -1)["d"].alias("eps"))
    pts = cut_lineage(pts.join(eps, "pid").withColumn("part", F.round(F.col("x2") / far).cast("int")))
    for x in ("x0", "x1"):
        pts = _within(pts, x, f"n_{x}")
    out = pts.groupBy("part").agg(*[F.sum(F.col("m") * _digamma(F.greatest(f"n_{x}", F.lit(1.0)))).alias(x) for x in ("x0", "x1")]).collect()
    found = {r["part"]: special.digamma(n) + special.digamma(k) - (r["x0"] + r["x1"]) / n for r in out}
    return {p: max(0.0, found.get(i, 0.0)) for i, p in enumerate(pairs)}


def knn_class_information(df: DataFrame, columns: Sequence[str], label: str, k: int = 3) -> dict[str, float]:
    """Nearest-neighbour estimate of the information (nats) between each numeric column and the classes of ``label`` (0, 1, ...).

    The distance to the k-th nearest value of the same class (fewer in small classes) bounds a count over all classes. Rows
    that are alone in their class are left out. All columns and classes share one search, on coordinates of their own."""
    cols = list(columns)
    rows = _complete(df, [*cols, label])
    sizes = {int(r[0]): r[1] for r in rows.groupBy(q(label).cast("int")).count().collect() if r[1] > 1}
    n = sum(sizes.values())
    if not n:
        return {c: 0.0 for c in cols}
    rows = rows.where(q(label).isin([float(c) for c in sizes]))
    ends = agg_dict(rows, {(c, s): f(q(c)) for c in cols for s, f in (("a", F.min), ("b", F.max))})
    unit = {c: (q(c) - ends[(c, "a")]) / ((ends[(c, "b")] - ends[(c, "a")]) or 1.0) for c in cols}
    width = max(sizes) + 1
    stacked = rows.select(F.explode(F.array(*[F.struct(unit[c].alias("u"), (4.0 * (i * width + q(label))).alias("w")) for i, c in enumerate(cols)])).alias("r")).select("r.*")
    pts = distinct_points(stacked, ["u", "w"])
    near = knn(pts, 2, k, within=2.0).select("pid", F.element_at("nn", -1)["d"].alias("eps"), F.aggregate("nn", F.lit(0).cast("long"), lambda a, t: a + t["m"]).alias("k"))
    pts = cut_lineage(pts.join(near, "pid").withColumn("part", F.floor(F.round(F.col("x1") / 4.0) / width).cast("int")))
    out = _within(pts, "x0", "near").groupBy("part").agg(F.sum(F.col("m") * (_digamma(F.col("k").cast("double")) - _digamma(F.greatest("near", F.lit(1.0))))).alias("s")).collect()
    base = special.digamma(n) - sum(c * special.digamma(c) for c in sizes.values()) / n
    found = {r["part"]: base + r["s"] / n for r in out}
    return {c: max(0.0, found.get(i, 0.0)) for i, c in enumerate(cols)}


def mutual_information(df: DataFrame, columns=None, estimator: str = "binned", bins: int = 10, k: int = 3) -> DataFrame:
    cols = _cols(df, columns)
    if estimator == "binned":
        return binned_mutual_information(df, cols, bins).withColumn("estimator", F.lit("binned"))
    rows = _complete(df, cols)
    got = knn_information(rows, list(combinations(cols, 2)), k)
    return rows_frame(df.sparkSession, [(a, b, v, "knn") for (a, b), v in got.items()], PAIR + ", estimator string")


def polychoric(df: DataFrame, columns=None, bins: int = 5) -> DataFrame:
    """Two-step latent correlation; 25 counts per pair reach the driver."""
    cols = _cols(df, columns)
    rows = _complete(df, cols)
    codes = ct.quantile_codes(rows, _exprs(cols), bins)
    counts = ct.pair_counts(rows, codes, list(combinations(cols, 2))).toPandas()
    plain = {(r["col_a"], r["col_b"]): r["value"] for r in pearson(rows, cols).collect()}
    out = []
    for (a, b), part in counts.groupby(["col_a", "col_b"]):
        t = part.pivot_table(index="ca", columns="cb", values="cnt", fill_value=0).to_numpy(float)
        out.append((a, b, plain[(a, b)] if min(t.shape) < 2 else olsson(t)))
    return rows_frame(df.sparkSession, out, PAIR)


def olsson(t: np.ndarray) -> float:
    """Correlation maximising the likelihood of a contingency table."""
    n = t.sum()
    cut_a = [-math.inf, *[special.phi_inv(p) for p in np.cumsum(t.sum(1))[:-1] / n], math.inf]
    cut_b = [-math.inf, *[special.phi_inv(p) for p in np.cumsum(t.sum(0))[:-1] / n], math.inf]

    def loss(rho):
        c = np.array([[special.bvn_cdf(a, b, rho) for b in cut_b] for a in cut_a])
        p = np.maximum(c[1:, 1:] - c[:-1, 1:] - c[1:, :-1] + c[:-1, :-1], 1e-12)
        return -float((t * np.log(p)).sum())

    return special.golden(loss, -0.999, 0.999, tol=1e-7)


# ---- kernels -----------------------------------------------------------------

def hsic_linear(df: DataFrame, columns=None) -> DataFrame:
    """Normalised linear-kernel independence criterion: the squared correlation."""
    cols = _cols(df, columns)
    return pearson(_complete(df, cols), cols).withColumn("value", F.col("value") * F.col("value"))


#: thresholds that one pass counts pairs for, and pairs of different values that are listed at the end
PROBES, LISTED = 62, 200_000
#: sorted values of a run, runs of a column at most, and runs that one task compares with another run
RUN, RUNS, BESIDE = 4_096, 2_000, 16


def _runs(values: DataFrame, kinds: Mapping[int, int]) -> DataFrame:
    """Runs of neighbouring values: ``part, run, lo, hi, n`` (rows), ``k`` (values) and the values with their rows, ``v, m``, as bytes."""
    count = {i: max(1, min(RUNS, -(-k // RUN))) for i, k in kinds.items()}
    most = max(count.values())
    cuts = {r["part"]: np.unique(r["at"]) for r in values.groupBy("part").agg(
        F.percentile_approx("v", [j / most for j in range(1, most)] or [1.0], max(10_000, 10 * most)).alias("at")).collect()}
    cuts = {i: c[::-(-most // count[i])] if count[i] > 1 else c[:0] for i, c in cuts.items()}

    @F.pandas_udf("int")
    def run_of(part: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        for i, c in cuts.items():
            mine = (part == i).to_numpy()
            out[mine] = np.searchsorted(c, v.to_numpy()[mine])
        return pd.Series(out)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, m = pdf["v"].to_numpy(float), pdf["m"].to_numpy(np.int64)
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "run": pdf["run"].iloc[:1].to_numpy(), "lo": v[:1], "hi": v[-1:], "n": [m.sum()], "k": [len(v)],
                             "v": [v.tobytes()], "m": [m.tobytes()]})

    return cut_lineage(values.withColumn("run", run_of("part", "v")).groupBy("part", "run").applyInPandas(
        packed, "part int, run int, lo double, hi double, n bigint, k bigint, v binary, m binary"))


def _gap_bounds(ends: pd.DataFrame, ranks: Sequence[int]) -> tuple[float, float]:
    """Between which differences the pairs of these ranks lie, from the ends and rows of the runs alone."""
    lo, hi, n = ends["lo"].to_numpy(), ends["hi"].to_numpy(), ends["n"].to_numpy(float)
    i, j = np.triu_indices(len(n))
    pairs = np.where(i == j, 0.0, n[i] * n[j])
    # pairs of one run may all be alike, or all as far apart as its ends; sums of floats are off by far less than the slack
    inner = float((n * (n - 1) / 2).sum())
    slack = 1e-9 * (float(pairs.sum()) + inner)

    def reached(gap: np.ndarray, weight: np.ndarray, want: float) -> float:
        order = np.argsort(gap)
        at = np.searchsorted(np.cumsum(weight[order]), want)
        return float(gap[order][at]) if at < len(gap) else math.inf

    least = reached(np.where(i == j, 0.0, lo[j] - hi[i]), np.where(i == j, n[i] * (n[i] - 1) / 2, pairs), min(ranks) - slack)
    most = reached(hi[j] - lo[i], pairs, max(ranks) + 1 + slack)
    off = 1e-14 * float(np.abs([lo[0], hi[-1]]).max())
    return max(0.0, least - off), most + off


def _beside(ends: pd.DataFrame, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """For each run the first and last run in which its values, moved by ``low`` to ``high``, come to lie; runs before are passed whole."""
    lo, hi = ends["lo"].to_numpy(), ends["hi"].to_numpy()
    return np.searchsorted(hi, lo + low, "right"), np.searchsorted(lo, hi + high, "right") - 1


def _compared(runs: DataFrame, asked: Sequence[tuple[int, np.ndarray, np.ndarray]], fn: Callable, schema: str) -> DataFrame:
    """``fn(g, v, m, v of the runs beside, m of the runs beside)`` for each run of the table of (part, first, last), in blocks of runs beside.

    A task holds one run and at most BESIDE others."""
    spark = runs.sparkSession
    rows = [(g, part, run, int(a), int(b)) for g, (part, first, last) in enumerate(asked) for run, (a, b) in enumerate(zip(first, last)) if a <= b]
    plan = rows_frame(spark, rows, "g int, part int, run int, a int, b int").withColumn("beside", F.explode(F.sequence("a", "b"))).withColumn("block", F.floor((F.col("beside") - F.col("a")) / BESIDE).cast("int"))
    tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, len(rows)))
    own = plan.select("g", "part", "run", "block").distinct().join(runs.select("part", "run", "v", "m"), ["part", "run"]).repartition(tasks, "g", "run", "block")
    others = plan.select(F.col("g").alias("g2"), F.col("part").alias("part2"), F.col("run").alias("run2"), F.col("block").alias("block2"), "beside").join(
        runs.select(F.col("part").alias("part2"), F.col("run").alias("beside"), F.col("v").alias("u"), F.col("m").alias("c")), ["part2", "beside"]).repartition(tasks, "g2", "run2", "block2")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("beside")
        v, m, u, c = (np.frombuffer(b"".join(f[x]), t) for f, x, t in ((a, "v", np.float64), (a, "m", np.int64), (b, "u", np.float64), (b, "c", np.int64)))
        return fn(int(a["g"].iloc[0]), v, m, u, c)

    return own.groupBy("g", "run", "block").cogroup(others.groupBy("g2", "run2", "block2")).applyInPandas(run, schema)


def median_distances(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The median squared difference between two rows, of all pairs that differ, for each column (1 if none do).

    Pairs are never formed to be counted: values are sorted in runs, and the pairs at most t apart are found by a binary search
    for v + t. The ends of the runs tell which runs v + t may lie in, and bound the median from both sides; each pass counts for
    several t and keeps the bracket that holds the median, for all columns at once; the few pairs of values left in it are
    listed. The driver gets the ends of runs, counts, and at the end one row for each difference in the bracket."""
    cols = list(columns)
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), q(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("r")).select("r.*")
    values = cut_lineage(rows.where("v IS NOT NULL").groupBy("part", "v").agg(F.count("*").alias("m")))
    sums = {r["part"]: r for r in values.groupBy("part").agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("decimal(38,0)") * F.col("m")).alias("s"),
                                                             F.count("*").alias("k"), F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    out, want = {c: 1.0 for c in cols}, {}
    for i, r in sums.items():
        pairs = (int(r["n"]) ** 2 - int(r["s"])) // 2
        if pairs:
            want[i] = sorted({(pairs - 1) // 2, pairs // 2})
    if not want:
        return out
    runs = _runs(values.where(F.col("part").isin(list(want))), {i: sums[i]["k"] for i in want})
    found = runs.select("part", "run", "lo", "hi", "n", "k").toPandas().sort_values(["part", "run"])
    ends = {i: f.reset_index(drop=True) for i, f in found.groupby("part")}
    # runs are numbered anew, as a cut may have no values
    runs = runs.join(F.broadcast(rows_frame(df.sparkSession, [(i, int(r), at) for i, f in ends.items() for at, r in enumerate(f["run"])], "part int, run int, at int")), ["part", "run"]).drop("run").withColumnRenamed("at", "run")
    # by column: threshold -> pairs of rows, and of values, at most so far apart
    known = {i: {0.0: (0, 0), (sums[i]["b"] - sums[i]["a"]) * (1 + 1e-12): ((int(sums[i]["n"]) ** 2 - int(sums[i]["s"])) // 2, sums[i]["k"] * (sums[i]["k"] - 1) // 2)} for i in want}

    def bracket(i: int, rank: int) -> tuple[float, float]:
        return max(t for t, c in known[i].items() if c[0] <= rank), min(t for t, c in known[i].items() if c[0] > rank)

    def count(asked: list[tuple[int, list[float]]]) -> None:
        """Adds to ``known`` the counts for thresholds of columns."""
        beside = [(i, *_beside(ends[i], ts[0], ts[-1])) for i, ts in asked]

        def counted(g, v, m, u, c):
            upto = np.concatenate([[0], np.cumsum(c)])
            at = [np.searchsorted(u, v + t, "right") for t in asked[g][1]]
            # high and low halves, so that no product is too large
            pairs = [upto[a] for a in at]
            return pd.DataFrame({"g": g, "j": range(len(at)), "high": [int(m @ (p >> 31)) for p in pairs], "low": [int(m @ (p & 0x7FFFFFFF)) for p in pairs], "k": [int(a.sum()) for a in at]})

        total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "k")]
        got = {(r["g"], r["j"]): ((int(r["high"]) << 31) + int(r["low"]), int(r["k"])) for r in _compared(runs, beside, counted, "g int, j int, high bigint, low bigint, k bigint").groupBy("g", "j").agg(*total).collect()}
        for g, (i, ts) in enumerate(asked):
            n, k = ([int(x) for x in ends[i][c]] for c in "nk")
            below = [(0, 0), *accumulate(zip(n, k), lambda s, x: (s[0] + x[0], s[1] + x[1]))]
            whole = [sum(own[r] * below[a][part] for r, a in enumerate(beside[g][1])) for part, own in enumerate((n, k))]
            # every value with those up to itself, which are no pairs
            self_n, self_k = (int(sums[i]["n"]) ** 2 + int(sums[i]["s"])) // 2, sums[i]["k"] * (sums[i]["k"] + 1) // 2
            for j, t in enumerate(ts):
                more = got.get((g, j), (0, 0))
                known[i][t] = (whole[0] + more[0] - self_n, whole[1] + more[1] - self_k)

    first = True
    while True:
        asked = []
        for i, ranks in want.items():
            for low, high in dict.fromkeys(bracket(i, r) for r in ranks):
                fine = (high - low) > 4e-16 * max(abs(sums[i]["a"]), abs(sums[i]["b"]))
                if known[i][high][1] - known[i][low][1] <= LISTED or not fine:
                    continue
                if first:
                    a, b = _gap_bounds(ends[i], ranks)
                    ts = np.linspace(max(a, low), min(b, high), PROBES + 2)
                else:
                    ts = np.linspace(low, high, PROBES + 2)
                ts = [t for t in np.unique(ts).tolist() if low < t < high]
                a, b = _beside(ends[i], ts[0], ts[-1]) if ts else (np.zeros(0), np.zeros(0))
                if (b - a + 1).clip(0).sum() <= 8 * len(a):
                    asked += [(i, ts)] if ts else []
                else:  # values come to lie in many runs: few thresholds, each with the two runs or so where it leads
                    asked += [(i, [t]) for t in ts[::max(1, len(ts) // 7)]]
        first = False
        if not asked:
            break
        count(asked)

    last = [(i, *b) for i, ranks in want.items() for b in dict.fromkeys(bracket(i, r) for r in ranks)]

    def listed(g, v, m, u, c):
        _, low, high = last[g]
        a, b = np.searchsorted(u, v + low, "right"), np.searchsorted(u, v + high, "right")
        size = b - a
        j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - a, size)
        gap = u[j] - np.repeat(v, size)
        ok = gap > 0
        return pd.DataFrame({"g": g, "d": (gap * gap)[ok], "m": np.repeat(m, size)[ok], "c": c[j][ok]})

    near = _compared(runs, [(i, *_beside(ends[i], low, high)) for i, low, high in last], listed, "g int, d double, m bigint, c bigint")
    at: dict[int, list] = {g: [] for g in range(len(last))}
    for r in near.groupBy("g", "d").agg(F.sum(F.col("m").cast("decimal(38,0)") * F.col("c")).alias("c")).orderBy("g", "d").collect():
        at[r["g"]].append((r["d"], int(r["c"])))
    picks: dict[int, dict[int, float]] = {i: {} for i in want}
    for g, (i, low, high) in enumerate(last):
        seen = known[i][low][0]
        for d, c in at[g]:
            picks[i].update({r: d for r in want[i] if seen <= r < seen + c})
            seen += c
    for i, got in picks.items():
        out[cols[i]] = float(np.mean(list(got.values()))) if got else 1.0
    return out


def hsic_rbf(df: DataFrame, columns, key: Sequence[str], nodes: int = 32, bandwidth: Mapping[str, float] | None = None) -> DataFrame:
    """Gaussian-kernel criterion from cosine features, one Gram job.

    The kernel is an average of cosines over normal frequencies; symmetric
    quadrature nodes replace random ones, so the result is deterministic.  The
    default bandwidth is the median squared distance of all pairs that differ,
    used as the scale itself."""
    cols = _cols(df, columns)
    rows = _complete(df, cols, key)
    bandwidth = bandwidth or median_distances(rows, cols)
    pts, wts = np.polynomial.hermite_e.hermegauss(2 * nodes)
    pts, wts = pts[nodes:], 2 * wts[nodes:] / wts.sum()
    feats, owner = {}, []
    centre = agg_dict(rows, {c: F.avg(q(c)) for c in cols})
    for c in cols:
        x = (q(c) - centre[c]) / bandwidth[c]
        for k, (p, w) in enumerate(zip(pts, wts)):
            if w < 1e-14:
                continue
            for nm, fn in (("c", F.cos), ("s", F.sin)):
                feats[f"{nm}{k}_{c}"] = fn(x * float(p)) * float(math.sqrt(w))
                owner.append(c)
    cov = gram(rows, feats)[None].cov(0)
    owner = np.array(owner)
    h = {(a, b): float((cov[np.ix_(owner == a, owner == b)] ** 2).sum()) for a in cols for b in cols}
    out = [(a, b, h[(a, b)] / math.sqrt(h[(a, a)] * h[(b, b)]) if h[(a, a)] * h[(b, b)] > 0 else 0.0) for a, b in combinations(cols, 2)]
    return rows_frame(df.sparkSession, out, PAIR)


# ---- covariance based ----------------------------------------------------------

def partial_correlation(df: DataFrame, columns=None) -> DataFrame:
    cols = _cols(df, columns)
    m, valid = solvers.partial_corr(gram(_complete(df, cols), _exprs(cols))[None].cov(1))
    return matrix_rows(df.sparkSession, cols, m).withColumn("valid", F.lit(valid))


def sparse_partial_correlation(df: DataFrame, columns, key: Sequence[str], cv: int = 5, alphas: int = 8) -> DataFrame:
    """Penalised precision with the penalty chosen by held-out likelihood over folds."""
    cols = _cols(df, columns)
    rows = _complete(df, cols, key)
    folds = gram(rows, _exprs(cols), fold(list(key), cv))
    whole = solvers.scaled(total(folds))
    sd, mean = total(folds).sd(0), total(folds).mean
    std = {k: solvers.rescale(g, mean, np.where(sd > 0, sd, 1)) for k, g in folds.items()}
    c0 = whole.cov(0)
    top = np.max(np.abs(c0 - np.diag(np.diag(c0)))) or 1e-3
    best = None
    for alpha in np.geomspace(top, top * 0.01, alphas):
        score = 0.0
        for g in std.values():
            rest = total(std) - g
            prec, _ = solvers.graphical_lasso(rest.xx / rest.n, alpha)
            sign, logdet = np.linalg.slogdet(prec)
            score += logdet - float(np.trace(prec @ (g.xx / g.n))) if sign > 0 else -1e9
        if best is None or score > best[0]:
            best = (score, alpha)
    prec, _ = solvers.graphical_lasso(c0, best[1])
    d = np.sqrt(np.diag(prec))
    return matrix_rows(df.sparkSession, cols, -prec / np.outer(d, d)).withColumn("alpha", F.lit(float(best[1])))


def cross_set_correlation(df: DataFrame, columns=None) -> DataFrame:
    """Correlation inside each half of the columns, its size across the halves."""
    cols = _cols(df, columns)
    left = cols[:len(cols) // 2]
    across = F.col("col_a").isin(left) & ~F.col("col_b").isin(left)
    return pearson(_complete(df, cols), cols).withColumn("value", F.when(across, F.abs("value")).otherwise(F.col("value")))


def lasso_coefficients(df: DataFrame, target: str, columns=None, alpha: float = 0.1, key: Sequence[str] = (), cv: int = 5) -> DataFrame:
    """Coefficients on standardised columns and target, largest first."""
    cols = [c for c in _cols(df, columns) if c != target]
    rows = _complete(df, [*cols, target], key)
    if alpha > 0:
        g = solvers.scaled(gram(rows, _exprs([*cols, target]))[None])
    else:
        folds = gram(rows, _exprs([*cols, target]), fold(list(key), cv))
        whole = total(folds)
        sd = np.where(whole.sd(0) > 0, whole.sd(0), 1)
        std = {k: solvers.rescale(f, whole.mean, sd) for k, f in folds.items()}
        alpha, g = solvers.cv_alpha(std, target, cols), total(std)
    xtx, xty, _, n, _, _ = solvers.xy(g, target, cols)
    b = solvers.elastic_net(xtx, xty, n, alpha)
    rows_out = sorted(zip(cols, b.tolist()), key=lambda t: (-abs(t[1]), t[0]))
    return rows_frame(df.sparkSession, [(c, v, float(alpha)) for c, v in rows_out], "feature string, coefficient double, alpha double")


# ---- targets -------------------------------------------------------------------

def is_class_target(df: DataFrame, target: str, levels: int = 10) -> bool:
    """Text, or whole numbers with few levels."""
    if target in string_columns(df):
        return True
    v = value(df, target).cast("double")
    got = agg_dict(df, {"frac": F.count_if(v != F.floor(v)), "n": F.count(v), "u": F.approx_count_distinct(v)})
    return bool(got["n"]) and not got["frac"] and got["u"] <= levels


def target_information(df: DataFrame, target: str, columns=None, bins: int = 10) -> DataFrame:
    """Binned mutual information of each feature with the target, largest first."""
    cols = [c for c in _cols(df, columns) if c != target]
    classes = is_class_target(df, target)
    y = value(df, target)
    rows = drop_missing(df.select(*[q(c).cast("double").alias(c) for c in cols], y.alias("__y")))
    codes = ct.quantile_codes(rows, _exprs(cols), bins)
    if classes:
        # class text to a small number by its hash; collisions over few levels do not occur at 31 bits
        codes["__y"] = F.pmod(F.xxhash64("__y"), F.lit(2147483647)).cast("int")
    else:
        codes["__y"] = ct.quantile_codes(rows, {"__y": F.col("__y").cast("double")}, bins)["__y"]
    counts = ct.pair_counts(rows, codes, [(c, "__y") for c in cols])
    return (ct.mutual_information(counts, ["col_a"]).select(F.col("col_a").alias("feature"), F.col("mi").alias("score"))
            .orderBy(F.desc("score"), "feature"))


# ---- ordered series --------------------------------------------------------------

def _series(df: DataFrame, col: str, order_by: Sequence[str]) -> DataFrame:
    """``i, v`` for the non-missing values of one series in key order."""
    s = df.select(*[q(k) for k in order_by], value(df, col).cast("double").alias("v")).filter("v is not null")
    return dense_index(s, order_by, "i").select("i", "v")


def cross_correlation(df: DataFrame, x: str, y: str, order_by: Sequence[str], lags: int = 40) -> DataFrame:
    """``lag, value``: sum of x at t+lag times y at t over the full-length scale."""
    sx, sy = _series(df, x, order_by), _series(df, y, order_by)
    n = min(sx.count(), sy.count())
    both = sx.select("i", F.col("v").alias("x")).join(sy.select("i", F.col("v").alias("y")), "i").filter(F.col("i") < n)
    m = agg_dict(both, {"x": F.avg("x"), "y": F.avg("y"), "sx": F.stddev_pop("x"), "sy": F.stddev_pop("y")})
    reach = min(lags, n - 1)
    blocks, w = halo(both.select("i", (F.col("x") - m["x"]).alias("x"), (F.col("y") - m["y"]).alias("y")), "i", reach, reach)
    prods = {f"p{k}": F.col("y") * (F.lead("x", k).over(w) if k >= 0 else F.lag("x", -k).over(w)) for k in range(-reach, reach + 1)}
    got = agg_dict(home_rows(blocks.withColumns(prods)), {k: F.sum(F.col(f"p{k}")) for k in range(-reach, reach + 1)})
    norm = m["sx"] * m["sy"] * n
    return rows_frame(df.sparkSession, [(k, (v or 0.0) / norm if norm else v) for k, v in got.items()], "lag int, value double")


def granger(df: DataFrame, columns, order_by: Sequence[str], max_lag: int = 5) -> DataFrame:
    """``col_a`` helping to predict ``col_b``: F statistics per lag from one Gram job."""
    cols = _cols(df, columns)
    rows = _complete(df, cols, order_by)
    idx = dense_index(rows, order_by, "i").select("i", *[q(c) for c in cols])
    lagged = with_lags(idx, "i", {f"{c}|{k}": (c, k) for c in cols for k in range(1, max_lag + 1)})
    feats = {f"{c}|{k}": F.coalesce(q(f"{c}|{k}" if k else c), F.lit(0.0)) for c in cols for k in range(max_lag + 1)}
    grams = gram(lagged, feats, F.least(F.col("i"), F.lit(max_lag)).cast("int"))
    out = []
    for a, b in permutations(cols, 2):
        for k in range(1, max_lag + 1):
            parts = {g: v for g, v in grams.items() if g >= k}
            if not parts:
                continue
            g, own = total(parts), [f"{b}|{j}" for j in range(1, k + 1)]
            other = [f"{a}|{j}" for j in range(1, k + 1)]
            rss = []
            for names in (own, own + other):
                xtx, xty, yty, n, _, _ = solvers.xy(g, f"{b}|0", names)
                rss.append(yty - float(xty @ solvers.ols(xtx, xty)))
            dof = n - 2 * k - 1
            f = (rss[0] - rss[1]) / k / (rss[1] / dof) if dof > 0 and rss[1] > 0 else float("nan")
            out.append((a, b, k, float(rss[0]), float(rss[1]), fin(f), special.f_tail(f, k, dof) if f == f else None))
    return rows_frame(df.sparkSession, out, "col_a string, col_b string, lag int, rss_own double, rss_both double, f double, p double")


def granger_matrix(df: DataFrame, columns, order_by: Sequence[str], max_lag: int = 5) -> DataFrame:
    return granger(df, columns, order_by, max_lag).groupBy("col_a", "col_b").agg((1 - F.min("p")).alias("value"))


def transfer_entropy(df: DataFrame, columns, order_by: Sequence[str], bins: int = 4) -> DataFrame:
    """Bits that ``col_a`` now adds about ``col_b`` next, beyond ``col_b`` now."""
    cols = _cols(df, columns)
    rows = _complete(df, cols, order_by)
    codes = ct.quantile_codes(rows, _exprs(cols), bins)
    coded = dense_index(rows.select(*[q(k) for k in order_by], *[c.alias(f"k_{n}") for n, c in codes.items()]), order_by, "i")
    pairs = with_lags(coded.select("i", *[q(f"k_{n}") for n in cols]), "i", {f"p_{n}": (f"k_{n}", 1) for n in cols}).filter(F.col("i") > 0)
    tup = pairs.groupBy(*[q(f"{s}_{n}") for n in cols for s in "kp"]).agg(F.count("*").alias("m"))
    items = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), q(f"k_{b}").alias("y1"),
                               q(f"p_{b}").alias("y0"), q(f"p_{a}").alias("x0")) for a, b in permutations(cols, 2)])
    base = tup.select("m", F.inline(items)).groupBy("col_a", "col_b", "y1", "y0", "x0").agg(F.sum("m").alias("m"))
    key = ["col_a", "col_b"]

    def margin(names, out):
        return base.groupBy(*key, *names).agg(F.sum("m").alias(out))

    j = (base.join(margin(["y0", "x0"], "m_yx"), [*key, "y0", "x0"]).join(margin(["y1", "y0"], "m_yy"), [*key, "y1", "y0"])
         .join(margin(["y0"], "m_y"), [*key, "y0"]).join(margin([], "n"), key))
    term = F.col("m") / F.col("n") * F.log2(F.col("m") * F.col("m_y") / (F.col("m_yx") * F.col("m_yy")))
    return j.groupBy(*key).agg(F.sum(term).alias("value"))


# ---- structure -------------------------------------------------------------------

def bayesian_network(df: DataFrame, columns=None, bins: int = 5, max_parents: int = 3, max_steps: int = 100) -> DataFrame:
    """Hill-climbed discrete network; each round scores its new families in one job."""
    cols = _cols(df, columns)
    rows = _complete(df, cols)
    codes = ct.uniform_codes(rows, _exprs(cols), bins)
    tup = rows.select(*[codes[c].alias(f"k{i}") for i, c in enumerate(cols)]).groupBy(*[f"k{i}" for i in range(len(cols))]) \
        .agg(F.count("*").alias("m")).cache()
    levels = agg_dict(tup, {i: F.count_distinct(f"k{i}") for i in range(len(cols))})
    known: dict = {}

    @F.pandas_udf("double")
    def log_gamma(s: pd.Series) -> pd.Series:
        return s.map(math.lgamma)

    def score(families):
        """Families are (child, parents); a family's counts never leave the executors."""
        new = [f for f in dict.fromkeys(families) if f not in known]
        if not new:
            return
        items = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"k{c}").alias("v"), F.lit(float(levels[c])).alias("r"),
                                   F.concat_ws("|", *[F.col(f"k{p}").cast("string") for p in ps], F.lit("")).alias("pa"))
                          for i, (c, ps) in enumerate(new)])
        cell = tup.select("m", F.inline(items)).groupBy("f", "r", "pa", "v").agg(F.sum("m").cast("double").alias("m"))
        per = cell.withColumn("g", log_gamma(F.col("m") + 1)).groupBy("f", "r", "pa").agg(F.sum("m").alias("m"), F.sum("g").alias("g"))
        got = per.withColumn("s", F.col("g") + log_gamma(F.col("r")) - log_gamma(F.col("m") + F.col("r"))) \
            .groupBy("f").agg(F.sum("s").alias("s")).collect()
        known.update({new[r["f"]]: r["s"] for r in got})

    parents: dict[int, tuple] = {i: () for i in range(len(cols))}

    def reaches(a, b, graph):
        """Is b an ancestor-or-self of a?"""
        return a == b or any(reaches(p, b, graph) for p in graph[a])

    def moves():
        for a, b in permutations(range(len(cols)), 2):
            if a in parents[b]:
                less = tuple(p for p in parents[b] if p != a)
                yield ("-", a, b), {b: less}
                rev = {**parents, b: less}
                if not reaches(a, b, rev) and len(parents[a]) < max_parents:
                    yield ("~", a, b), {b: less, a: tuple(sorted((*parents[a], b)))}
            elif not reaches(a, b, parents) and len(parents[b]) < max_parents:
                yield ("+", a, b), {b: tuple(sorted((*parents[b], a)))}

    for _ in range(max_steps):
        options = list(moves())
        score([(c, parents[c]) for c in parents] + [f for _, ch in options for f in ch.items()])
        gain, pick = max(((sum(known[(c, ps)] - known[(c, parents[c])] for c, ps in ch.items()), ch) for _, ch in options),
                         key=lambda t: t[0], default=(0.0, None))
        if pick is None or gain <= 1e-4:
            break
        parents.update(pick)
    tup.unpersist()
    return rows_frame(df.sparkSession, [(cols[p], cols[c]) for c, ps in parents.items() for p in ps], "src string, dst string")


def threshold_graph(pairs: DataFrame, names: Sequence[str], threshold: float = 0.30) -> DataFrame:
    """Edges above a threshold; a negative weight points back in column order."""
    strong = pairs.filter(F.abs("value") > threshold)
    fwd = F.col("value") > 0
    return strong.select(F.when(fwd, F.col("col_a")).otherwise(F.col("col_b")).alias("src"),
                         F.when(fwd, F.col("col_b")).otherwise(F.col("col_a")).alias("dst"), F.col("value").alias("weight"))


def strong_pairs(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pairs.filter(F.abs("value") > threshold).orderBy(F.desc(F.abs("value")), "col_a", "col_b")


def column_map(pairs: DataFrame, names: Sequence[str], eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    """Plane coordinates and groups of columns from a p x p association matrix."""
    p, at = len(names), {n: i for i, n in enumerate(names)}
    m = np.eye(p)
    for r in pairs.collect():  # one row per column pair
        m[at[r["col_a"]], at[r["col_b"]]] = m[at[r["col_b"]], at[r["col_a"]]] = r["value"] or 0.0
    c = m - m.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    xy = (u * s)[:, :2] if p > 1 else np.zeros((p, 2))
    xy = xy * np.where(np.take_along_axis(vt[:2], np.abs(vt[:2]).argmax(1)[:, None], 1)[:, 0] < 0, -1, 1)
    xy = xy / (np.abs(xy).max() or 1.0)
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) <= eps
    core, group, cur = near.sum(1) >= min_samples, np.full(p, -1), 0
    for i in range(p):
        if core[i] and group[i] < 0:
            stack = [i]
            while stack:
                k = stack.pop()
                if group[k] < 0:
                    group[k] = cur
                    if core[k]:
                        stack += np.flatnonzero(near[k] & (group < 0)).tolist()
            cur += 1
    return rows_frame(pairs.sparkSession, [(n, float(xy[i, 0]), float(xy[i, 1]), int(group[i])) for i, n in enumerate(names)],
                      "column string, pc1 double, pc2 double, grp int")
