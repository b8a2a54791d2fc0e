"""All grids up to the budget, against tables made one by one."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tabulith.catalog import association as catalog
from tabulith.functions import grids
from tabulith.functions.contingency import quantile_edges
from tabulith.operators import association as A


def table():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=1500), 2)
    return pd.DataFrame({"x": x, "y": x ** 2 + rng.normal(size=1500) * .2, "t": rng.integers(0, 9, 1500) / 10.0 + (x > 0),
                         # values one step apart, where quantiles between them round
                         "u": np.where(rng.random(1500) < .6, 1.0, np.nextafter(1.0, 2.0)) + (rng.random(1500) < .3) * np.round(x, 1)})


def bins(v, k):
    s, n = np.sort(v), len(v)
    h = [(n - 1) * (i / k) for i in range(k + 1)]
    at = [s[math.floor(p)] + (s[math.ceil(p)] - s[math.floor(p)]) * (p - math.floor(p)) for p in h]
    return np.unique(np.searchsorted(quantile_edges(at), v, side="left"), return_inverse=True)[1]


def plain(a, b, budget):
    of, top = {}, 0.0
    for k in range(2, budget // 2 + 1):
        of[k] = bins(a, k), bins(b, k)
    for nx in of:
        for ny in range(2, budget // nx + 1):
            t = np.zeros((of[nx][0].max() + 1, of[ny][1].max() + 1))
            np.add.at(t, (of[nx][0], of[ny][1]), 1 / len(a))
            if min(t.shape) > 1:
                pos = t > 0
                top = max(top, (t[pos] * np.log2(t[pos] / np.outer(t.sum(1), t.sum(0))[pos])).sum() / math.log2(min(t.shape)))
    return min(1.0, top)


@pytest.mark.parametrize("slice_points", [7, 400, 10 ** 6])
def test_slices_give_what_the_tables_give(monkeypatch, slice_points):
    monkeypatch.setattr(grids, "SLICE_POINTS", slice_points)
    pdf = table()
    n, budget = len(pdf), int(len(pdf) ** 0.6)
    for a, b in combinations(pdf.columns, 2):
        got = 0.0
        for x, y, strict in ((a, b, False), (b, a, True)):
            s = np.sort(pdf[x])
            edges = {k: quantile_edges([s[math.floor(p)] + (s[math.ceil(p)] - s[math.floor(p)]) * (p - math.floor(p)) for p in ((n - 1) * (i / k) for i in range(k + 1))])
                     for k in range(2, math.isqrt(budget) + 1)}
            fine = sorted({e for es in edges.values() for e in es})
            rows = pd.DataFrame({"o": 0, "v": pdf[y], "f": np.searchsorted(fine, pdf[x], side="left")})
            points = rows.groupby(["o", "v", "f"]).size().rename("m").reset_index()
            slices = pd.concat(grids._packed([points.iloc[i * len(points) // 5:(i + 1) * len(points) // 5] for i in range(5)]), ignore_index=True)
            assert len(slices) > 1 or slice_points > len(points)
            g = grids.Grids(n, budget, grids.coarse_codes(edges, fine), strict)
            for i, r in enumerate(slices.to_dict("records")):
                g.add(*(np.frombuffer(r[c], t) for c, t in (("values", float), ("points", np.int64), ("code", np.int32), ("count", np.int64))),
                      slices["v"].iloc[i + 1] if i + 1 < len(slices) else math.nan)
            got = max(got, g.best())
        assert min(1.0, got) == pytest.approx(plain(pdf[a].to_numpy(), pdf[b].to_numpy(), budget), abs=1e-10)


def test_all_grids_of_the_budget_are_scored(spark):
    pdf = table()
    df = spark.createDataFrame(pdf).repartition(3)
    for cap in (None, 9):
        budget = cap or int(len(pdf) ** 0.6)
        got = {(r.col_a, r.col_b): (r.value, r.budget) for r in A.mic(df, cap=cap).collect()}
        assert got == {(a, b): (pytest.approx(plain(pdf[a].to_numpy(), pdf[b].to_numpy(), budget), abs=1e-10), budget) for a, b in combinations(pdf.columns, 2)}
    one = A.mic(df.selectExpr("x", "double(1) as c")).collect()
    assert [(r.col_a, r.col_b, r.value) for r in one] == [("x", "c", 0.0)]


def test_the_query_has_no_cap(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(catalog.A, "mic", lambda df, columns=None, cap=None, alpha=0.6: asked.update(cap=cap, alpha=alpha) or spark.createDataFrame([], A.PAIR))
    monkeypatch.setattr(catalog, "frame", lambda spark, d: None)
    catalog.query.__globals__["QUERIES"]["r04_mic"](spark, "")
    assert asked == {"cap": None, "alpha": 0.6}
