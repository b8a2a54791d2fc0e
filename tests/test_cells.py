"""Neighbours stay in the cell of the point that asks: no table has a row for each pair of neighbours."""

import numpy as np
import pandas as pd
import pytest

from tabulith.functions import neighbors
from tabulith.operators import outliers
from tabulith.operators import ranking as K


@pytest.fixture
def cells(monkeypatch):
    def listed(*_a, **_k):
        raise AssertionError("a row for each pair of neighbours")

    for module in (outliers, K):
        monkeypatch.setattr(module, "knn", listed)
    for name, n in (("CELL_POINTS", 30), ("QUERIES_PER_TASK", 25), ("BOXES", 10)):
        monkeypatch.setattr(neighbors, name, n)


def test_outlier_factor_over_many_cells(spark, cells):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(220, 2)), rng.normal(size=(60, 2)) * .01 + 3, [[40.0, -40.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, 1)[:, :7]
    near = np.take_along_axis(d, nn, 1)
    lrd = 1 / (np.maximum(near, near[:, -1][nn]).mean(1) + 1e-10)
    got = outliers.lof_flags(df, ["a", "b"], 7).toPandas().sort_values("id")
    assert list(got.columns) == ["id", "a", "b", "score", "is_outlier"] and np.allclose(got.score, lrd[nn].mean(1) / lrd)
    # copies count as neighbours of each other
    twice = outliers.lof_flags(df.unionByName(df), ["a", "b"], 7).toPandas()
    assert len(twice) == 2 * len(x) and (twice.groupby("id").score.nunique() == 1).all()


def test_class_relief_over_many_cells(spark, cells):
    rng = np.random.default_rng(6)
    n, k = 200, 4
    x = rng.random((n, 2))
    c = np.where(x[:, 0] + rng.normal(size=n) * .2 > .5, "p", "q")
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "c": c}))
    u = (x - x.min(0)) / (x.max(0) - x.min(0))
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.zeros(2)
    for i in range(n):
        for other in "pq":
            at = np.flatnonzero(c == other)
            at = at[np.argsort(d[i, at])[:k]]
            share = -1 if other == c[i] else (c == other).mean() / (1 - (c == c[i]).mean() + 1e-10)
            want += share * np.abs(u[i] - u[at]).mean(0) / n
    got = {r.feature: r.score for r in K.relieff(K.task(df, "c", ["id"], ["a", "b"]), k).collect()}
    assert np.allclose([got["a"], got["b"]], want)
