"""Weighted dominance sums: for every row, the weight of rows strictly below it
in both x and y.  Exact, without pairing rows.

Both axes are cut into value ranges.  Rows in earlier ranges of both axes come
from prefix sums over the grid of range totals; rows sharing one of the row's
ranges come from a sort-based count inside that range.  A value so frequent
that it fills a range has one to itself, and such a range needs no inner count
because equal values never dominate each other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import order_bucket

ROWS_PER_BLOCK = 150_000
#: Ranges per axis; the grid of range totals stays below 4 * MAX_BLOCKS^2 cells.
MAX_BLOCKS = 4000


def dominated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of w[j] over x[j] < x[i] and y[j] < y[i]; a bit-wise sweep over ranks.

    Two ranks differ first at one bit: pairs are split by that bit, so each
    level is one sorted prefix sum."""
    n = len(x)
    out = np.zeros_like(w, dtype=float)
    if n < 2:
        return out
    rx = np.unique(x, return_inverse=True)[1]
    order = np.argsort(y, kind="stable")
    rx, ry, ws = rx[order], np.unique(y, return_inverse=True)[1][order], w[order]
    acc = np.zeros_like(ws, dtype=float)
    for level in range(int(rx.max()).bit_length()):
        group, bit = rx >> (level + 1), (rx >> level) & 1
        by = np.argsort(group, kind="stable")       # keeps y order inside a group
        g, yy = group[by], ry[by]
        lower = np.where((bit[by] == 0)[:, None], ws[by], 0.0)
        before = np.cumsum(lower, axis=0) - lower
        fresh = np.r_[True, (g[1:] != g[:-1]) | (yy[1:] != yy[:-1])]
        start = np.r_[True, g[1:] != g[:-1]]
        first_of_tie = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        first_of_group = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        inside = before[first_of_tie] - before[first_of_group]
        acc[by] += np.where((bit[by] == 1)[:, None], inside, 0.0)
    out[order] = acc
    return out


def dominance_sums(df: DataFrame, x: Column, y: Column, weights: Sequence[Column],
                   rows: int | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Aggregated by distinct (x, y): ``x, y, cnt, w0.. (own sums), d0.. (dominated)``.

    Rows with a null coordinate are dropped."""
    k = len(weights)
    ws, ds = [f"w{i}" for i in range(k)], [f"d{i}" for i in range(k)]
    pts = (df.select(x.cast("double").alias("x"), y.cast("double").alias("y"),
                     *[w.cast("double").alias(n) for n, w in zip(ws, weights)])
           .na.drop(subset=["x", "y"])
           .groupBy("x", "y").agg(F.count("*").alias("cnt"), *[F.sum(n).alias(n) for n in ws]))
    rows = rows if rows is not None else df.count()
    schema = "x double, y double, " + ", ".join(f"{d} double" for d in ds)
    if rows <= rows_per_block:  # one bounded block
        own = ", ".join(["x double", "y double", "cnt bigint", *(f"{w} double" for w in ws), *(f"{d} double" for d in ds)])

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            res = dominated(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf[ws].to_numpy(float))
            return pdf[["x", "y", "cnt", *ws]].assign(**{d: res[:, i] for i, d in enumerate(ds)})

        return pts.withColumn("one", F.col("cnt") < 0).groupBy("one").applyInPandas(block, own)
    pts = cut_lineage(pts)  # read by several branches below
    blocks = min(MAX_BLOCKS, max(4, -(-rows // rows_per_block)))
    pts = order_bucket(pts, ["x"], "bx", blocks)
    pts = order_bucket(pts, ["y"], "by", blocks)

    # whole ranges below on both axes
    cells = pts.groupBy("bx", "by").agg(*[F.sum(n).alias(n) for n in ws])
    grid = _grid_prefix(cells, ws)

    def inner(own: str, other: str, below_only: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[own].to_numpy(), pdf[other].to_numpy()
            w = pdf[ws].to_numpy(float)
            # along ``own`` the value decides; along the other axis either the
            # value (same cell counted here) or the range (same cell counted there)
            axis = pdf["b" + other].to_numpy() if below_only else b
            res = dominated(a, axis, w)
            out = pdf[["x", "y"]].copy()
            for i, d in enumerate(ds):
                out[d] = res[:, i]
            return out
        return run

    def multi(b: str, v: str) -> DataFrame:
        """Points in ranges holding more than one value of this axis."""
        spread = pts.groupBy(b).agg((F.min(v) < F.max(v)).alias("many")).filter("many").select(b)
        return pts.join(F.broadcast(spread), b)

    in_x = multi("bx", "x").groupBy("bx").applyInPandas(inner("x", "y", False), schema)
    in_y = multi("by", "y").groupBy("by").applyInPandas(inner("y", "x", True), schema)
    base = pts.join(grid, ["bx", "by"]).select("x", "y", "cnt", *ws, *ds)
    parts = (base.unionByName(in_x, allowMissingColumns=True)
             .unionByName(in_y, allowMissingColumns=True))
    return parts.groupBy("x", "y").agg(
        F.max("cnt").alias("cnt"), *[F.max(n).alias(n) for n in ws], *[F.sum(d).alias(d) for d in ds])


def _grid_prefix(cells: DataFrame, ws: list[str]) -> DataFrame:
    """Per occupied cell, the totals over cells with smaller bx and smaller by.

    Step 1 spreads each cell over the by-ranges of its row through a running
    sum along by; step 2 adds the earlier bx-ranges."""
    bys = sorted(r["by"] for r in cells.select("by").distinct().collect())  # one number per range
    full = cells.select("bx").distinct().select("bx", F.explode(F.lit(bys)).alias("by")).join(cells, ["bx", "by"], "left")
    along = Window.partitionBy("bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    row = full.select("bx", "by", *[F.coalesce(F.sum(n).over(along), F.lit(0.0)).alias(n) for n in ws])
    down = Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    return row.select("bx", "by", *[F.coalesce(F.sum(n).over(down), F.lit(0.0)).alias(f"d{i}")
                                    for i, n in enumerate(ws)])
