"""Grouped summaries, moving windows, top-n and set operations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial, reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q, value
from ..functions.ordering import dense_index, halo, home_rows, running


def join_tables(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "inner")


def grouped_medians(df: DataFrame, by: str, col: str) -> DataFrame:
    """Exact median per group from value counts, so a hot group spans many tasks."""
    counts = (df.select(q(by).alias("g"), value(df, col).cast("double").alias("v")).filter("v is not null")
              .groupBy("g", "v").agg(F.count("*").alias("c")))
    run = running(counts, ["v"], {"below": F.col("c")}, ["g"])
    n = counts.groupBy("g").agg(F.sum("c").alias("n"))
    j = run.join(n, "g")
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def covers(r):
        return (F.col("below") <= r) & (r < F.col("below") + F.col("c"))

    return j.filter(covers(lo) | covers(hi)).groupBy("g").agg(
        (F.sum(F.when(covers(lo), F.col("v")).otherwise(0.0) + F.when(covers(hi), F.col("v")).otherwise(0.0)) / 2).alias("median")) \
        .withColumnRenamed("g", by)


def grouped(df: DataFrame, by: str, col: str, estimator: str = "mean", z: float = 1.959963984540054) -> DataFrame:
    """Estimate per group with deviation, standard error and a normal interval."""
    v = value(df, col).cast("double")
    base = df.groupBy(q(by)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.stddev_samp(v).alias("sd"))
    if estimator == "median":
        base = base.join(grouped_medians(df, by, col), by, "left")
    est = {"mean": q("mean"), "sum": q("sum"), "count": q("n").cast("double"), "median": q("median")}[estimator]
    se = F.col("sd") / F.sqrt("n")
    return base.select(q(by), "n", est.alias("estimate"), "sd", se.alias("se"), (est - z * se).alias("low"), (est + z * se).alias("high"))


def _poisson(h: np.ndarray, reps: int) -> np.ndarray:
    """rows x reps Poisson(1) counts, a hash of the row's hash and the replicate's number each."""
    z = h.view(np.uint64)[:, None] + np.arange(1, reps + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(odd)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
#: groups whose sums a task holds before it hands them on
_GROUPS_HELD = 2_000


def _replicates(batches, reps: int):
    held: dict = {}

    def out():
        for g, s in held.items():
            yield pd.DataFrame({"g": [g] * reps, "b": np.arange(reps), "w": s[0], "wv": s[1]})
        held.clear()

    for pdf in batches:
        codes, groups = pd.factorize(pdf["g"], use_na_sentinel=False)
        for at in range(0, len(pdf), 2_000):  # bounds rows x reps
            part = slice(at, at + 2_000)
            w = _poisson(pdf["h"].to_numpy(np.int64)[part], reps)
            wv = w * pdf["v"].to_numpy(np.float64)[part, None]
            for c in np.unique(codes[part]):
                mine = codes[part] == c
                g = groups[c] if not pd.isna(groups[c]) else None
                sums = held.setdefault(g, np.zeros((2, reps)))
                sums[0] += w[mine].sum(axis=0)
                sums[1] += wv[mine].sum(axis=0)
        if len(held) > _GROUPS_HELD:
            yield from out()
    yield from out()


def bootstrap(df: DataFrame, by: str, col: str, key: Sequence[str], estimator: str = "mean", reps: int = 1000, level: float = 0.95) -> DataFrame:
    """Estimate per group with the percentile interval of its bootstrap distribution.

    Each replicate weighs each row by a Poisson count that a hash of the key and the replicate's number draws, so all replicates
    come from one scan that adds up weights, and reruns give the same. Repeated keys share their draws. The median needs no
    draws: in a resample of n rows it is at most x with the chance that a binomial count of rows up to x reaches half of n."""
    v = value(df, col).cast("double")
    rows = df.select(q(by).alias("g"), v.alias("v"), F.xxhash64(*[q(k) for k in key]).alias("h")).where("v IS NOT NULL")
    tail = (1 - level) / 2
    if estimator == "median":
        counts = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
        run = running(counts, ["v"], {"below": F.col("c")}, ["g"]).join(counts.groupBy("g").agg(F.sum("c").alias("n")), "g")
        share = (F.col("below") + F.col("c")) / F.col("n")
        # the normal limit of the binomial, as a bound on the count of rows up to x
        z = (F.col("n") * share - F.col("n") / 2) / F.sqrt(F.greatest(F.col("n") * share * (1 - share), F.lit(1e-12)))
        edge = NormalDist().inv_cdf(1 - tail)
        ends = run.groupBy("g").agg(F.min(F.when(z >= -edge, F.col("v"))).alias("low"), F.min(F.when(z >= edge, F.col("v"))).alias("high"))
        return ends.join(grouped(df, by, col, "median").select(q(by).alias("g"), "n", "estimate"), "g").select(F.col("g").alias(by), "n", "estimate", "low", "high")
    kind = rows.schema["g"].dataType.simpleString()
    sums = rows.mapInPandas(partial(_replicates, reps=reps), f"g {kind}, b int, w double, wv double").groupBy("g", "b").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"))
    drawn = {"mean": F.try_divide("wv", "w"), "sum": F.col("wv"), "count": F.col("w")}[estimator]
    ends = sums.groupBy(F.col("g").alias("g2")).agg(F.percentile(drawn, [tail, 1 - tail]).alias("p"))
    return grouped(df, by, col, estimator).select(q(by).alias("g"), "n", "estimate").join(ends, F.col("g").eqNullSafe(F.col("g2")), "left").select(
        F.col("g").alias(by), "n", "estimate", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(q(col).alias("value")).agg(F.count("*").alias("n"))


def rolling_mean(df: DataFrame, col: str, order_by: Sequence[str], width: int, centred: bool = True,
                 min_periods: int = 1, partition_by: Sequence[str] = (), out: str = "rolling") -> DataFrame:
    """Moving mean over row positions; blocks overlap by the window width only."""
    back = width // 2 if centred else width - 1
    fwd = width - 1 - back if centred else 0
    idx = dense_index(df, order_by, "__i", partition_by)
    blocks, w = halo(idx, "__i", back, fwd, partition_by)
    frame, v = w.rowsBetween(-back, fwd), value(df, col).cast("double")
    mean = F.when(F.count(v).over(frame) >= min_periods, F.avg(v).over(frame))
    return home_rows(blocks.withColumn(out, mean)).drop("__i")


def moving_averages(df: DataFrame, col: str, order_by: Sequence[str], widths: Sequence[int] = (5, 20, 50),
                    partition_by: Sequence[str] = ()) -> DataFrame:
    """Trailing means, NULL until a window is full, all from one block layout."""
    idx = dense_index(df, order_by, "__i", partition_by)
    blocks, w = halo(idx, "__i", max(widths) - 1, 0, partition_by)
    v = value(df, col).cast("double")
    cols = {}
    for k in widths:
        frame = w.rowsBetween(1 - k, 0)
        cols[f"ma_{k}"] = F.when((F.count(v).over(frame) == k), F.avg(v).over(frame))
    return home_rows(blocks.withColumns(cols)).drop("__i")


def top_n(df: DataFrame, by: str, n: int, tie: str, absolute: bool = False) -> DataFrame:
    return df.orderBy(F.desc(F.abs(q(by)) if absolute else q(by)), q(tie)).limit(n)


def sort_by_score(df: DataFrame, score: str, name: str, absolute: bool = False) -> DataFrame:
    return df.orderBy(F.desc(F.abs(q(score)) if absolute else q(score)), q(name))


def feature_union(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), sets).distinct()


def feature_intersection(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), sets)


