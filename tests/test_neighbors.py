"""Neighbour search, nearest-neighbour information and relief weights against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulith.functions import neighbors, special, trees
from tabulith.operators import association as A
from tabulith.operators import models as M
from tabulith.operators import ranking as K
from tabulith.operators import relational as Rel


def far(a, b, metric):
    gap = np.abs(a[:, None] - b[None])
    return gap.max(-1) if metric == "max" else np.sqrt((gap ** 2).sum(-1))


@pytest.mark.parametrize("metric", ["euclid", "max"])
def test_the_tree_finds_what_all_pairs_find(spark, monkeypatch, metric):
    """Three levels of cells, a dense clump, copies, strangers as queries far outside, and a bound on the distance."""
    monkeypatch.setattr(neighbors, "CELL_POINTS", 12)
    monkeypatch.setattr(neighbors, "PARTS", 3)
    monkeypatch.setattr(neighbors, "QUERIES_PER_TASK", 40)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(500, 2)), rng.normal(size=(300, 2)) * 1e-6, np.repeat([[0.5, 0.5]], 40, 0), [[0.0, -0.0]]])
    pts = neighbors.distinct_points(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"])
    d = far(x, x, metric)
    np.fill_diagonal(d, np.inf)
    want = pd.DataFrame({"x0": x[:, 0] + 0.0, "x1": x[:, 1] + 0.0, "kd": np.sort(d, 1)[:, 4]}).drop_duplicates(["x0", "x1"])
    got = neighbors.knn(pts, 2, 5, metric=metric).join(pts, "pid").toPandas().merge(want, on=["x0", "x1"])
    assert len(got) == len(want) and np.allclose([t[-1]["d"] for t in got.nn], got.kd, rtol=1e-12, atol=0)
    assert all(sum(t["m"] for t in r) == 5 for r in got.nn)
    y = np.vstack([rng.normal(size=(60, 2)) * 3, [[50.0, 50.0], [0.5, 0.5]]])
    asked = neighbors.distinct_points(spark.createDataFrame(pd.DataFrame(y, columns=["a", "b"])), ["a", "b"])
    d = far(y, x, metric)
    for within in (None, 0.4):
        got = neighbors.knn(pts, 2, 3, asked.drop("m"), metric=metric, within=within).join(asked, "pid").toPandas()
        assert within or len(got) == len(y)
        for r in got.itertuples():
            i = np.flatnonzero((y == [r.x0, r.x1]).all(1))[0]
            near = np.sort(d[i])[:3]
            near = near if within is None else near[near <= within]
            assert np.allclose(np.repeat([t["d"] for t in r.nn], [t["m"] for t in r.nn]), near)


def digammas(v):
    return np.array([special.digamma(float(c)) for c in np.atleast_1d(v)])


def test_class_information_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    n = 600
    c = np.r_[rng.integers(0, 3, n - 3), 3, 4, 4]  # one row alone in its class, and a class smaller than k
    x = np.column_stack([c + rng.normal(size=n), np.round(rng.normal(size=n), 1), rng.exponential(size=n) * 1e4])
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "d": x[:, 2], "c": c.astype(float)}))
    got = A.knn_class_information(df, ["a", "b", "d"], "c", 3)
    keep = np.bincount(c)[c] > 1
    for j, name in enumerate("abd"):
        v, k = x[keep, j], c[keep]
        v = (v - v.min()) / (v.max() - v.min())
        gap, terms = np.abs(v[:, None] - v[None]), []
        for i in range(len(v)):
            own = np.flatnonzero((k == k[i]) & (np.arange(len(v)) != i))
            m = min(3, len(own))
            r = np.sort(gap[i, own])[m - 1]
            near = (gap[i] <= r * (1 - 1e-9)).sum()
            terms.append(digammas(m)[0] - digammas((k == k[i]).sum())[0] - digammas(near)[0])
        assert np.isclose(got[name], max(0.0, digammas(len(v))[0] + np.mean(terms)), atol=1e-9), name
    assert got["a"] > 0.2 > 0.1 > got["d"]


def test_all_pairs_share_one_search(spark):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"u": rng.normal(size=n), "w": np.round(rng.normal(size=n) * 50)})
    pdf["v"] = pdf.u * 2 + rng.normal(size=n) * .3
    got = A.knn_information(spark.createDataFrame(pdf), [("u", "v"), ("u", "w"), ("w", "v")], 3)
    for (a, b), value in got.items():
        x, y = pdf[a].to_numpy() / pdf[a].std(ddof=0), pdf[b].to_numpy() / pdf[b].std(ddof=0)
        dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
        d = np.maximum(dx, dy) + np.where(np.eye(n), np.inf, 0)
        eps = np.sort(d, 1)[:, 2]
        nx, ny = ((g <= eps[:, None] * (1 - 1e-9)).sum(1) for g in (dx, dy))
        want = digammas(n)[0] + digammas(3)[0] - np.mean(digammas(nx)) - np.mean(digammas(ny))
        assert np.isclose(value, max(0, want), atol=1e-9), (a, b)


@pytest.fixture(scope="module")
def relief(spark):
    rng = np.random.default_rng(7)
    n = 2_000
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=list("abc")).assign(id=range(n))
    pdf.loc[1_990:, list("abc")] = pdf.loc[:9, list("abc")].to_numpy()  # copies
    pdf["y"] = pdf.a * 2 + rng.normal(size=n) * .1
    pdf["k"] = np.where(pdf.a > .3, "x", np.where(pdf.b > 0, "y", "z"))
    pdf.loc[0, "k"] = "alone"
    return pdf, spark.createDataFrame(pdf)


def unit(pdf):
    x = pdf[list("abc")].to_numpy()
    return (x - x.min(0)) / (x.max(0) - x.min(0))


def test_class_relief_equals_all_pairs(relief):
    pdf, df = relief
    x, k, n, w = unit(pdf), pdf.k.to_numpy(), len(pdf), np.zeros(3)
    d = far(x, x, "euclid") + np.where(np.eye(len(x)), np.inf, 0)
    share = {c: (k == c).mean() for c in set(k)}
    for i in range(n):
        if (k == k[i]).sum() < 2:
            continue
        for c in share:
            of = np.flatnonzero((k == c) & (np.arange(n) != i))
            near = of[np.argsort(d[i, of], kind="stable")[:10]]
            gap = np.abs(x[near] - x[i]).mean(0)
            w += (-gap if c == k[i] else share[c] / (1 - share[k[i]] + 1e-10) * gap) / n
    got = {r.feature: r.score for r in K.relieff(K.task(df.drop("y"), "k", ["id"])).collect()}
    assert np.allclose([got[c] for c in "abc"], w, atol=1e-9)


def test_number_relief_equals_all_pairs(relief):
    pdf, df = relief
    x, n = unit(pdf), len(pdf)
    r = (pdf.y.rank().to_numpy() - 1) / (n - 1)
    d = far(x, x, "euclid") + np.where(np.eye(n), np.inf, 0)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    dc, da = np.abs(r[:, None] - r[near]), np.abs(x[:, None] - x[near])
    c, a, b = dc.sum() / 10, da.sum((0, 1)) / 10, (da * dc[:, :, None]).sum((0, 1)) / 10
    want = b / (c + 1e-12) - (a - b) / (n - c + 1e-12)
    got = {q.feature: q.score for q in K.relieff(K.task(df.drop("k"), "y", ["id"])).collect()}
    assert np.allclose([got[f] for f in "abc"], want, atol=1e-9)
    some = {q.feature: q.score for q in K.relieff(K.task(df.drop("k"), "y", ["id"]), n_iter=300).collect()}
    assert max(some, key=some.get) == "a"


# ---- trees as arrays

@pytest.mark.parametrize("target", ["y", "k"])
def test_arrays_predict_as_the_model(spark, relief, target):
    _, df = relief
    t = K.task(df.drop("k" if target == "y" else "y"), target, ["id"])
    fitted = K._forest(K._prepared(t), 7, 5, 3)
    arrays = trees.forest(spark, fitted.model, len(t.classes) if t.classes else 0)
    got = fitted.predict(K._prepared(t).train.limit(300)).toPandas()
    mine = arrays.predict(got[t.xs].to_numpy())
    if t.classes:
        assert np.allclose(np.vstack(got.probability.map(lambda v: v.toArray())), mine) and (mine.argmax(1) == got.prediction).all()
    else:
        assert np.allclose(got.prediction, mine[:, 0])


def test_permutation_has_a_spread_and_leaves_useless_features_low(relief):
    _, df = relief
    for target in ("y", "k"):
        t = K.task(df.drop("k" if target == "y" else "y"), target, ["id"])
        got = {r.feature: r for r in K.permutation_importance(t, 4, 10, 5).collect()}
        assert got["a"].score > 0.2 and abs(got["c"].score) < 0.05 and got["a"].std > 0 and got["a"].std < got["a"].score / 5
        shown = K.presentation(K.permutation_importance(t, 4, 10, 5)).collect()
        assert shown[0].relative == 1.0 and np.isclose(shown[0].error, got[shown[0].feature].std / got[shown[0].feature].score)


def test_interactions_equal_numpy(relief):
    _, df = relief
    t = K.task(df.drop("k"), "y", ["id"])
    f, rows = K._trees(t, 5, 5, 42), t.rows.toPandas()
    x = rows[t.xs].to_numpy()
    mean = x.mean(0)

    def at(*swap):
        z = x.copy()
        z[:, list(swap)] = mean[list(swap)]
        return f.score(z)

    want = np.zeros(3)
    for i in range(3):
        for j in range(i + 1, 3):
            h = np.var(at() - at(i, j) - at(i) - at(j)) / (np.var(at() - at(i, j)) + 1e-12)
            want[[i, j]] += h
    got = {r.feature: r.score for r in K.interactions(t, 5, 5).collect()}
    assert np.allclose([got[c] for c in "abc"], want, rtol=1e-6)


def test_plans_of_explanations_move_no_rows(relief):
    _, df = relief
    phi = K.shap(K.task(df.drop("k"), "y", ["id"]), 3, 3, 5)
    plan = phi._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Exchange" not in plan and "Generate" not in plan


# ---- bootstrap

def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(9)
    n = 4_000
    pdf = pd.DataFrame({"id": range(n), "g": rng.choice(["a", "b", None], n, p=[.6, .3, .1]), "v": rng.exponential(size=n)})
    pdf.loc[5, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = {r.g: r for r in Rel.bootstrap(df, "g", "v", ["id"], reps=600).collect()}
    for g in ("a", "b", None):
        v = pdf.v[pdf.g.isna() if g is None else pdf.g == g].dropna()
        half = 1.96 * v.std() / np.sqrt(len(v))
        assert got[g].n == len(v) and np.isclose(got[g].estimate, v.mean())
        assert np.allclose([got[g].estimate - got[g].low, got[g].high - got[g].estimate], half, rtol=.25)
    again = {r.g: r for r in Rel.bootstrap(df.repartition(7), "g", "v", ["id"], reps=600).collect()}
    assert all(np.isclose(again[g].low, got[g].low) for g in got)
    draws = np.sort([np.median(rng.choice(pdf.v[pdf.g == "a"].dropna(), (pdf.g == "a").sum())) for _ in range(800)])
    median = {r.g: r for r in Rel.bootstrap(df.where("g = 'a'"), "g", "v", ["id"], "median").collect()}["a"]
    assert abs(median.low - draws[20]) < 0.03 and abs(median.high - draws[779]) < 0.03
    assert {r.g for r in Rel.bootstrap(df, "g", "v", ["id"], "sum", reps=50).collect()} == {"a", "b", None}
    assert Rel.bootstrap(df.limit(0), "g", "v", ["id"], reps=10).collect() == []


@pytest.mark.parametrize("listed", [A.LISTED, 60])
def test_median_distances_equal_all_pairs(spark, monkeypatch, listed):
    monkeypatch.setattr(A, "LISTED", listed)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=701), "b": rng.integers(0, 9, 701) * 1.0, "c": np.exp(rng.normal(size=701) * 3) + 1e6, "d": np.ones(701)})
    pdf.loc[:200, "a"] = 0.25
    got = A.median_distances(spark.createDataFrame(pdf), list("abcd"))
    for c in "abc":
        d = (pdf[c].to_numpy()[:, None] - pdf[c].to_numpy()[None]) ** 2
        assert np.isclose(got[c], np.median(d[d > 0]), rtol=1e-12), c
    assert got["d"] == 1.0


def test_median_distances_by_runs(spark, monkeypatch):
    """Many small runs, a crowd of values far from the others, and middle pairs of two differences; a pass meets few runs."""
    for name, n in (("LISTED", 60), ("RUN", 16), ("BESIDE", 2), ("PROBES", 10)):
        monkeypatch.setattr(A, name, n)
    met, plain = [], A._compared

    def watched(runs, asked, *rest):
        met.append((sum(int((b - a + 1).clip(0).sum()) for _, a, b in asked), sum(len(a) for _, a, _ in asked)))
        return plain(runs, asked, *rest)

    monkeypatch.setattr(A, "_compared", watched)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=900), "b": np.concatenate([rng.normal(size=450) * 1e-9, rng.exponential(size=450) * 1e3]),
                        "c": rng.integers(0, 300, 900) / 7.0, "e": np.repeat([0.0, 1.0, 11.0], [896, 2, 2])})
    got = A.median_distances(spark.createDataFrame(pdf), list("abce"))
    for c in "abce":
        d = (pdf[c].to_numpy()[:, None] - pdf[c].to_numpy()[None]) ** 2
        assert np.isclose(got[c], np.median(d[d > 0]), rtol=1e-12), c
    assert all(pairs <= 8 * runs for pairs, runs in met[:-1])


def test_a_cell_returns_only_what_lies_within_the_limit():
    """A query that knows k points from its own cell takes nearer ones, and those as near, from other cells, and no others."""
    px = np.arange(20.0)[:, None]
    ids = np.array([bytes([i]) for i in range(20)], object)
    got = neighbors._search(np.array([[0.0], [-3.0], [5.0]]), px, ids, np.ones(20, np.int64), 4, [None, None, ids[5]], "euclid", np.array([2.0, 1.0, np.inf]))
    assert got[0] == [[ids[0], ids[1], ids[2]], [], [ids[4], ids[6], ids[3], ids[7]]]
