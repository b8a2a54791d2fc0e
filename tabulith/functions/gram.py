"""Sums and cross products of a numeric block, optionally per group.

The table is read once; only (p+1)x(p+1) sums per group reach the driver.
Narrow blocks use plain aggregates; wide ones sum NumPy products per Arrow
batch on the executors.  Columns are shifted by a rough centre first, which
keeps the later subtraction of means accurate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .columns import agg_dict

_NARROW = 18


@dataclass
class Gram:
    """Sufficient statistics: count, sums, cross products (about ``shift``)."""
    names: list[str]
    n: float
    s: np.ndarray
    xx: np.ndarray
    shift: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.s / self.n + self.shift

    def centred(self) -> np.ndarray:
        """Sum of products about the mean."""
        return self.xx - np.outer(self.s, self.s) / self.n

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.centred() / (self.n - ddof)

    def sd(self, ddof: int = 0) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov(ddof)), 0.0))

    def corr(self) -> np.ndarray:
        c = self.centred()
        d = np.sqrt(np.maximum(np.diag(c), 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            return c / np.outer(d, d)

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.names, self.n + other.n, self.s + other.s, self.xx + other.xx, self.shift)

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(self.names, self.n - other.n, self.s - other.s, self.xx - other.xx, self.shift)

    def pick(self, names: Sequence[str]) -> "Gram":
        i = [self.names.index(n) for n in names]
        return Gram(list(names), self.n, self.s[i], self.xx[np.ix_(i, i)], self.shift[i])


def total(parts: Mapping[object, Gram]) -> Gram:
    grams = list(parts.values())
    out = grams[0]
    for g in grams[1:]:
        out = out + g
    return out


def gram(df: DataFrame, exprs: Mapping[str, Column], by: Column | None = None,
         weight: Column | None = None, centre: Mapping[str, float] | None = None, costly: bool = False) -> dict[object, Gram]:
    """``{group: Gram}`` over rows where every expression is non-null.

    The group key is None when ``by`` is not given; groups must be few (folds,
    classes).  A known rough ``centre`` per column saves the first scan.
    ``costly`` expressions are computed once a row and summed in NumPy at any width."""
    names = list(exprs)
    p = len(names)
    cols = [e.cast("double").alias(f"x{i}") for i, e in enumerate(exprs.values())]
    block = df.select(*cols, (by if by is not None else F.lit(0)).alias("g"),
                      (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"))
    if costly or p > _NARROW:
        return _wide(block, names, p, np.array([centre[n] for n in names]) if centre else None, by is not None)
    block = block.na.drop(subset=[f"x{i}" for i in range(p)])
    mid = dict(enumerate(centre[n] for n in names)) if centre else agg_dict(block, {i: F.avg(f"x{i}") for i in range(p)})
    shift = np.array([mid[i] if mid[i] is not None else 0.0 for i in range(p)])
    shifted = block.select("g", "w", *[(F.col(f"x{i}") - float(shift[i])).alias(f"x{i}") for i in range(p)])
    aggs = [F.sum("w").alias("n")]
    aggs += [F.sum(F.col("w") * F.col(f"x{i}")).alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}")
             for i in range(p) for j in range(i, p)]
    rows = shifted.groupBy("g").agg(*aggs).collect()
    out = {}
    for r in rows:
        s = np.array([r[f"s{i}"] for i in range(p)])
        xx = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                xx[i, j] = xx[j, i] = r[f"p{i}_{j}"]
        out[r["g"] if by is not None else None] = Gram(names, float(r["n"]), s, xx, shift)
    return out


def _wide(block: DataFrame, names, p, shift, grouped) -> dict[object, Gram]:
    """Rows are found complete in NumPy too: a filter would compute every expression a second time."""
    def complete(batch):
        x = np.column_stack([batch[f"x{i}"].to_numpy(zero_copy_only=False) for i in range(p)]).astype(float)
        return x, ~np.isnan(x).any(axis=1)

    def sums(batches):
        acc = np.zeros(p + 1)
        for batch in batches:
            x, ok = complete(batch)
            acc += np.append(x[ok].sum(axis=0), ok.sum())
        yield pa.RecordBatch.from_pydict({"i": np.arange(p + 1, dtype=np.int32), "v": acc})

    if shift is None:
        got = {r["i"]: r["v"] for r in block.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        shift = np.array([got[i] / got[p] if got.get(p) else 0.0 for i in range(p)])

    def partial(batches):
        acc: dict = {}
        for batch in batches:
            x, ok = complete(batch)
            if not ok.any():
                continue
            x = np.column_stack([np.ones(ok.sum()), x[ok] - shift])
            w = batch["w"].to_numpy(zero_copy_only=False)[ok]
            codes, groups = pd.factorize(batch["g"].to_pandas()[ok], use_na_sentinel=False)
            for k, g in enumerate(groups.tolist()):
                at = codes == k
                m = (x[at] * w[at, None]).T @ x[at]
                acc[g] = acc[g] + m if g in acc else m
        for g, m in acc.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * (p + 1), type=g_arrow, from_pandas=True), pa.array(np.arange(p + 1, dtype=np.int32)),
                                              pa.array(list(m))], ["g", "i", "m"])

    g_type = block.schema["g"].dataType
    g_arrow = to_arrow_type(g_type)
    rows = block.mapInArrow(partial, f"g {g_type.simpleString()}, i int, m array<double>")
    summed = (rows.select("g", "i", F.posexplode("m").alias("j", "v"))
              .groupBy("g", "i", "j").agg(F.sum("v").alias("v")).toPandas())
    out = {}
    for g, part in summed.groupby("g", dropna=False):
        m = np.zeros((p + 1, p + 1))
        m[part["i"], part["j"]] = part["v"]
        out[g if grouped else None] = Gram(names, m[0, 0], m[0, 1:], m[1:, 1:], shift)
    return out
