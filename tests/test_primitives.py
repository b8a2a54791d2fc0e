"""Shared primitives against NumPy and pandas, with small blocks so every path runs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulith.functions import dominance, gram, neighbors, ordering, quantiles, solvers, special
from tabulith.functions import contingency as ct

N = 6000


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(N), "a": np.round(rng.normal(size=N), 2), "b": rng.exponential(size=N),
                        "c": np.where(rng.random(N) < .4, 3.0, rng.normal(size=N))})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 900)
    monkeypatch.setattr(quantiles, "BRACKET_VALUES", 50)


def test_quantiles_both_paths_equal_numpy(data):
    pdf, df = data
    probs = [0, .01, .05, .25, .5, .69, .95, .999, 1]
    for limit in (10, 10 ** 9):
        got = quantiles.quantiles(df, ["a", "b", "c"], probs, exact_rows=limit)
        for c in "abc":
            assert np.allclose(got[c], np.quantile(pdf[c], probs)), (limit, c)


def test_quantiles_with_one_hot_value(spark):
    v = np.r_[np.full(4000, 7.0), np.arange(2000) / 1000]
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = quantiles.quantiles(df, ["v"], [.1, .333, .5, .9], exact_rows=10)["v"]
    assert np.allclose(got, np.quantile(v, [.1, .333, .5, .9]))


def test_order_stats(data):
    pdf, df = data
    for limit in (10, 10 ** 9):
        n, got = quantiles.order_stats(df, ["b"], lambda n: {0, 5, n - 1}, exact_rows=limit)
        s = np.sort(pdf["b"])
        assert np.allclose([got["b"][0], got["b"][5], got["b"][n["b"] - 1]], [s[0], s[5], s[-1]])


def test_ranks_index_lags_and_fill(data):
    pdf, df = data
    got = ordering.with_ranks(df, ["a", "b", "c"]).toPandas().sort_values("id")
    for c in "abc":
        assert np.allclose(got[c + "_rank"], pdf[c].rank())
    idx = ordering.dense_index(df, ["c", "id"]).toPandas().sort_values("idx")
    assert (idx["id"].values == pdf.sort_values(["c", "id"])["id"].values).all()
    lag = ordering.with_lags(ordering.dense_index(df, ["id"]), "idx", {"a1": ("a", 1), "a3": ("a", 3)}).toPandas().sort_values("id")
    assert np.allclose(lag.a1.values[1:], pdf.a.values[:-1]) and np.allclose(lag.a3.values[3:], pdf.a.values[:-3])
    hole = pdf.a.where(pdf.id % 1500 == 3)
    for forward in (True, False):
        f = ordering.fill_edges(df, ["id"], {"f": F.expr("case when id % 1500 = 3 then a end")}, forward).toPandas().sort_values("id")
        want = hole.ffill() if forward else hole.bfill()
        assert np.allclose(f.f.astype(float), want, equal_nan=True)


def test_text_keys_keep_their_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("abcdefgz",), ("abcdefga",), ("zz",)], "k string")
    got = ordering.dense_index(df, ["k"]).orderBy("idx").toPandas()["k"].tolist()
    assert got == sorted(got)


@pytest.mark.parametrize("block", [150, 10 ** 6])
def test_dominance_matches_pairs(spark, data, block):
    s = data[0].head(1200)
    got = dominance.dominance_sums(spark.createDataFrame(s), F.col("a"), F.col("c"), [F.lit(1), F.col("b")], rows_per_block=block).toPandas()
    x, y = s.a.values, s.c.values
    low = (x[None] < x[:, None]) & (y[None] < y[:, None])
    want = pd.DataFrame({"x": x, "y": y, "r0": low.sum(1), "r1": low @ s.b.values}).drop_duplicates(["x", "y"])
    m = got.merge(want, on=["x", "y"])
    assert len(m) == len(got) == len(want) and np.allclose(m.d0, m.r0) and np.allclose(m.d1, m.r1)


def test_gram_narrow_and_wide(data, monkeypatch):
    pdf, df = data
    cols = {c: F.col(c) for c in "abc"}
    for narrow in (18, 1):
        monkeypatch.setattr(gram, "_NARROW", narrow)
        g = gram.gram(df, cols)[None]
        assert np.allclose(g.cov(), np.cov(pdf[list("abc")].T)) and np.allclose(g.mean, pdf[list("abc")].mean())
        by = gram.gram(df, cols, F.col("id") % 3)
        assert np.allclose(by[1].cov(), np.cov(pdf[pdf.id % 3 == 1][list("abc")].T))
        assert np.allclose(gram.total(by).cov(), g.cov())


@pytest.mark.parametrize("metric", ["euclid", "max"])
def test_knn_matches_pairs(spark, data, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "CELL_POINTS", 80)
    monkeypatch.setattr(neighbors, "QUERIES_PER_TASK", 60)
    s, k = data[0].head(1000), 4
    pts = neighbors.distinct_points(spark.createDataFrame(s), ["a", "c"])
    nn = neighbors.knn(pts, 2, k, metric=metric).join(pts, "pid").toPandas()
    p = s[["a", "c"]].to_numpy()
    gap = np.abs(p[:, None] - p[None])
    d = gap.max(-1) if metric == "max" else np.sqrt((gap ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = pd.DataFrame({"x0": p[:, 0], "x1": p[:, 1], "kd": np.sort(d, 1)[:, k - 1]}).drop_duplicates()
    m = nn.merge(want, on=["x0", "x1"])
    assert len(m) == len(nn) and np.allclose(m.kd, [t[-1]["d"] for t in m.nn])
    assert all(sum(t["m"] for t in r) == k for r in m.nn)


def test_special_functions():
    assert math.isclose(special.f_tail(3.5, 2, 20), 0.0497, abs_tol=1e-4)
    assert math.isclose(special.t_two_sided(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(special.chi2_tail(5.991, 2), 0.05, abs_tol=1e-4)
    assert math.isclose(special.bvn_cdf(0, 0, 0.5), 1 / 4 + math.asin(0.5) / (2 * math.pi), abs_tol=1e-10)
    assert math.isclose(special.digamma(1.0), -0.5772156649, abs_tol=1e-9)


def test_elastic_net_satisfies_its_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    x -= x.mean(0)
    y = x @ [3, 0, -2, 0, .1] + rng.normal(size=300)
    y -= y.mean()
    b = solvers.elastic_net(x.T @ x, x.T @ y, 300, 0.2, 0.7)
    grad = x.T @ (y - x @ b) / 300 - 0.2 * 0.3 * b
    on = b != 0
    assert np.allclose(grad[on], 0.2 * 0.7 * np.sign(b[on]), atol=1e-6) and (np.abs(grad[~on]) <= 0.2 * 0.7 + 1e-6).all()


def test_fold_scores_equal_refits(spark, data):
    pdf, df = data
    folds = gram.gram(df, {c: F.col(c) for c in "abc"}, F.col("id") % 4)
    got = solvers.fold_scores(folds, "b", ["a", "c"], lambda m, v, n: solvers.ridge(m, v, 2.0))
    for f, (r2, rmse) in zip(folds, got):
        tr, te = pdf[pdf.id % 4 != f], pdf[pdf.id % 4 == f]
        xc, yc = tr[["a", "c"]] - tr[["a", "c"]].mean(), tr.b - tr.b.mean()
        b = np.linalg.solve(xc.T @ xc + 2 * np.eye(2), xc.T @ yc)
        e = te.b - (tr.b.mean() + (te[["a", "c"]] - tr[["a", "c"]].mean()) @ b)
        assert np.isclose(r2, 1 - (e ** 2).sum() / ((te.b - te.b.mean()) ** 2).sum()) and np.isclose(rmse, np.sqrt((e ** 2).mean()))


def test_codes_equal_pandas(spark, data):
    pdf, df = data
    got = df.select("id", *[e.alias(c) for c, e in ct.quantile_codes(df, {c: F.col(c) for c in "abc"}, 9).items()]).toPandas().sort_values("id")
    for c in "abc":
        assert (got[c].values == pd.qcut(pdf[c], 9, labels=False, duplicates="drop").values).all()


@pytest.mark.parametrize("values", [3, 45])
def test_few_hot_first_keys_are_cut_by_the_second(spark, monkeypatch, values):
    """Rows sharing a first key spread over ranges by the second one."""
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 30)
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"d": rng.integers(0, values, 5000), "id": rng.permutation(5000)})
    df = spark.createDataFrame(pdf)
    sizes = ordering.order_bucket(df, ["d", "id"]).groupBy("__bucket").count().toPandas()["count"]
    assert sizes.max() < 5000 / values / 2
    got = ordering.dense_index(df, ["d", "id"], "i").toPandas().sort_values("i")
    assert (got[["d", "id"]].to_numpy() == pdf.sort_values(["d", "id"]).to_numpy()).all()


@pytest.mark.parametrize("kind", ["text", "wide", "decimal", "hot_text", "nulls"])
def test_order_holds_for_keys_that_share_their_start(spark, monkeypatch, kind):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 250)
    n, r = 4_000, np.random.default_rng(8)
    place = r.permutation(n)
    keys = {"text": [f"Customer#{i:09d}" for i in place], "wide": [2 ** 60 + int(i) for i in place], "decimal": [f"{10 ** 17 + int(i)}.{i % 10}" for i in place],
            "hot_text": ["same" if i < n // 2 else f"same{i:05d}" for i in place], "nulls": [None if i < 900 else f"Customer#{i:09d}" for i in place]}[kind]
    rows = [(k, int(p), float(v) if v > -0.5 else None) for k, p, v in zip(keys, place if kind in ("hot_text", "nulls") else r.permutation(n), r.normal(size=n))]
    df = spark.createDataFrame(rows, f"k {'bigint' if kind == 'wide' else 'string'}, id bigint, v double")
    if kind == "decimal":
        df = df.withColumn("k", F.col("k").cast("decimal(38,4)"))
    got = ordering.dense_index(df, ["k", "id"]).collect()
    want = sorted(got, key=lambda x: (x.k is not None, x.k if x.k is not None else 0, x.id))
    assert [x.idx for x in want] == list(range(n))
    sizes = [x["count"] for x in ordering.order_bucket(df, ["k", "id"]).groupBy("__bucket").count().collect()]
    assert max(sizes) <= 3 * 250 and len(sizes) >= 8
    filled = {x.id: x.f for x in ordering.fill_edges(df, ["k", "id"], {"f": F.col("v")}, True).collect()}
    last = None
    for x in want:
        last = x.v if x.v is not None else last
        assert filled[x.id] == last


def test_costly_gram_equals_plain_sums(spark):
    rows = [("x", 1.0, 2.0), ("x", 2.0, None), ("y", 3.0, 5.0), (None, 4.0, 1.0), ("x", 5.0, float("nan")), ("x", 7.0, -2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    cols = {"a": F.col("a"), "b": F.col("b")}
    plain, costly = gram.gram(df, cols, F.col("g")), gram.gram(df, cols, F.col("g"), costly=True)
    assert {str(k) for k in costly} >= {"x", "y"} and len(costly) == len(plain) == 3
    for k in ("x", "y"):
        assert plain[k].n == costly[k].n
        np.testing.assert_allclose(plain[k].mean, costly[k].mean)
        np.testing.assert_allclose(plain[k].centred(), costly[k].centred(), atol=1e-12)


def test_many_ranks_take_few_scans(spark, monkeypatch):
    """Hundreds of ranks, hot values, both infinities and NaN: each scan counts for all of them, not one expression for each."""
    wide, plain = [], quantiles.agg_dict
    monkeypatch.setattr(quantiles, "agg_dict", lambda df, exprs: wide.append(len(exprs)) or plain(df, exprs))
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=3000), np.full(700, 0.5), np.repeat([np.inf, -np.inf, -0.0], [120, 90, 80])])
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": rng.exponential(size=len(v)) ** 9, "s": np.r_[np.arange(30.0), np.full(len(v) - 30, np.nan)]}))
    cols = {"v": F.col("v"), "w": F.col("w"), "s": F.when(~F.isnan("s"), F.col("s")), "n": F.when(F.col("s") < 0, 0.0).otherwise(F.when(F.col("v") > 0, F.lit(float("nan"))).otherwise(F.col("v")))}
    sizes, got = quantiles.order_stats(df, cols, lambda n: set(range(0, n, 7)) | {n - 1}, exact_rows=10)
    pdf = df.toPandas()
    want = {"v": pdf.v, "w": pdf.w, "s": pdf.s.dropna(), "n": pdf.v.where(~(pdf.v > 0))}
    for c, x in want.items():
        x = np.sort(x.to_numpy())
        assert sizes[c] == len(x) and np.array_equal([got[c][r] for r in sorted(got[c])], x[sorted(got[c])], equal_nan=True), c
    assert max(wide) <= len(cols)
