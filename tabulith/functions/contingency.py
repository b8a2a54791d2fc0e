"""Binning and contingency tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import agg_dict
from .quantiles import quantiles


def codes(c: Column, edges: Sequence[float]) -> Column:
    """Bin number for right-closed bins, lowest value included; inner edges only."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(c <= edges[i], F.lit(i)).otherwise(out)
    return F.when(c.isNotNull(), out).cast("int")


def quantile_edges(values: Sequence[float]) -> list[float]:
    """Inner edges of equal-frequency bins with repeated edges dropped.

    ``values`` are the quantiles 0, 1/q .. 1 of the column."""
    uniq = sorted({v for v in values if v is not None})
    return uniq[1:-1]


def quantile_codes(df: DataFrame, exprs: Mapping[str, Column], bins: int) -> dict[str, Column]:
    """Equal-frequency bin code per expression; one quantile job for all."""
    got = quantiles(df, exprs, [i / bins for i in range(bins + 1)])
    return {k: codes(e, quantile_edges(got[k])) for k, e in exprs.items()}


def uniform_codes(df: DataFrame, exprs: Mapping[str, Column], bins: int) -> dict[str, Column]:
    """Equal-width bin code per expression, the top edge inside the last bin."""
    ends = agg_dict(df, {(k, s): f(e) for k, e in exprs.items() for s, f in (("a", F.min), ("b", F.max))})
    out = {}
    for k, e in exprs.items():
        a, b = ends[(k, "a")], ends[(k, "b")]
        width = (b - a) / bins if a is not None and b > a else 0
        code = F.least(F.floor((e - a) / width), F.lit(bins - 1)) if width else F.lit(0)
        out[k] = F.when(e.isNotNull(), code).cast("int")
    return out


def pair_counts(df: DataFrame, code_cols: Mapping[str, Column],
                pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``col_a, col_b, ca, cb, cnt`` for all pairs in one scan and one shuffle.

    Rows first collapse to distinct code tuples, so the explode over pairs runs
    on the table of tuples and not on the rows."""
    names = list(code_cols)
    pos = {n: i for i, n in enumerate(names)}
    tup = (df.select(*[c.cast("int").alias(f"k{i}") for i, c in enumerate(code_cols.values())])
           .groupBy(*[f"k{i}" for i in range(len(names))]).agg(F.count("*").alias("m")))
    items = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                               F.col(f"k{pos[a]}").alias("ca"), F.col(f"k{pos[b]}").alias("cb"))
                      for a, b in pairs])
    return (tup.select("m", F.explode(items).alias("p")).select("p.*", "m")
            .filter("ca is not null and cb is not null")
            .groupBy("col_a", "col_b", "ca", "cb").agg(F.sum("m").alias("cnt")))


def mutual_information(counts: DataFrame, keys: Sequence[str] = ("col_a", "col_b"),
                       base: float = math.e) -> DataFrame:
    """Plug-in mutual information per key from ``ca, cb, cnt`` rows."""
    keys = list(keys)
    a = counts.groupBy(*keys, "ca").agg(F.sum("cnt").alias("na"))
    b = counts.groupBy(*keys, "cb").agg(F.sum("cnt").alias("nb"))
    n = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.count_distinct("ca").alias("ka"),
                                  F.count_distinct("cb").alias("kb"))
    j = counts.join(a, [*keys, "ca"]).join(b, [*keys, "cb"]).join(n, keys)
    term = F.col("cnt") / F.col("n") * F.ln(F.col("cnt") * F.col("n") / (F.col("na") * F.col("nb")))
    return j.groupBy(*keys).agg((F.sum(term) / math.log(base)).alias("mi"), F.max("n").alias("n"),
                                F.max("ka").alias("ka"), F.max("kb").alias("kb"))
