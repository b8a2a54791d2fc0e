"""Operators without a SQL twin: brute force, properties, replay and streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulith.functions import dominance, ordering
from tabulith.operators import association as A
from tabulith.operators import audit, conditioning, descriptors, impute, normalize, outliers, power, profile, ranking, stability, transform
from tabulith.operators import contracts as C
from tabulith.operators import models as M
from tabulith.plans import ledger
from tabulith.sources import readers, writers
from tabulith.streaming import apply as stream


def frame(spark, pdf, parts=4):
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=400), 2)
    pdf = pd.DataFrame({"id": range(400), "x": x, "y": x ** 2 + rng.normal(size=400) * .3, "z": rng.normal(size=400)})
    return pdf, spark.createDataFrame(pdf).cache()


def gapped(n=400, seed=3):
    rng = np.random.default_rng(seed)
    v = np.cumsum(rng.normal(size=n))
    return pd.DataFrame({"id": np.arange(n), "g": np.arange(n) % 2, "v": np.where(rng.random(n) < .3, np.nan, v)})


# ---- interpolation ------------------------------------------------------------------

def pchip_slopes(x, y):
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(len(x))
    for k in range(1, len(x) - 1):
        if s[k - 1] * s[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            d[k] = (w1 + w2) / (w1 / s[k - 1] + w2 / s[k])

    def end(h0, h1, a, b):
        e = ((2 * h0 + h1) * a - h0 * b) / (h0 + h1)
        return 0.0 if np.sign(e) != np.sign(a) else 3 * a if np.sign(a) != np.sign(b) and abs(e) > 3 * abs(a) else e
    d[0], d[-1] = end(h[0], h[1], s[0], s[1]), end(h[-1], h[-2], s[-1], s[-2])
    return d


def hermite(x, y, d, t):
    k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    u = (t - x[k]) / h
    return ((1 + 2 * u) * (1 - u) ** 2 * y[k] + u * (1 - u) ** 2 * h * d[k] + u ** 2 * (3 - 2 * u) * y[k + 1] + u ** 2 * (u - 1) * h * d[k + 1])


@pytest.mark.parametrize("rows", [60, 250_000])
def test_pchip_and_spline_match_a_direct_solve(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows)
    pdf = gapped()
    known = pdf.dropna()
    x, y = known.id.to_numpy(float), known.v.to_numpy()
    for method, d in (("pchip", pchip_slopes(x, y)), ("spline", impute.spline_slopes(x, y))):
        got = impute.impute(frame(spark, pdf), method, columns=["v"], order_by=["id"]).toPandas().sort_values("id")
        want = np.where(pdf.v.isna(), hermite(x, y, d, pdf.id.to_numpy(float)), pdf.v)
        assert np.allclose(got.v, want), method


def test_spline_reproduces_a_cubic_and_akima_a_line(spark):
    n = np.arange(60.0)
    keep = (np.arange(60) % 7 != 3) | (np.arange(60) == 59)
    cubic = 0.01 * n ** 3 - n ** 2 + 3
    pdf = pd.DataFrame({"id": np.arange(60), "v": np.where(keep, cubic, np.nan)})
    got = impute.impute(frame(spark, pdf), "spline", columns=["v"], order_by=["id"]).toPandas().sort_values("id")
    assert np.allclose(got.v, cubic)
    pdf["v"] = np.where(keep, 2 * n + 1, np.nan)
    got = impute.impute(frame(spark, pdf), "akima", columns=["v"], order_by=["id"]).toPandas().sort_values("id")
    assert np.allclose(got.v, 2 * n + 1)


def test_linear_and_limits_match_pandas_per_group(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 50)
    pdf = gapped()
    for method in ("linear", "ffill", "bfill"):
        for limit in (None, 1):
            got = impute.impute(frame(spark, pdf), method, columns=["v"], order_by=["id"], partition_by=["g"], limit=limit).toPandas().sort_values("id")
            want = pd.Series(np.nan, index=pdf.index)
            for g in (0, 1):
                s = pdf[pdf.g == g].v
                want[s.index] = (s.interpolate(limit=limit, limit_direction="both") if method == "linear" else getattr(s, method)(limit=limit))
            assert np.allclose(got.v, want, equal_nan=True), (method, limit)


# ---- outliers -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    x[:12] += 9
    pdf = pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1]})
    return pdf, spark.createDataFrame(pdf).cache()


def test_detectors_find_planted_rows(planted):
    pdf, df = planted
    runs = {"isolation": outliers.isolation_flags(df, ["a", "b"], ["id"], contamination=.02),
            "envelope": outliers.envelope_flags(df, ["a", "b"], ["id"], contamination=.02),
            "dbscan": outliers.dbscan_noise(df, ["a", "b"], eps=.4, min_samples=15)}
    for name, out in runs.items():
        got = set(out.filter("is_outlier").toPandas()["id"])
        assert len(got & set(range(12))) >= 11, name


def test_lof_matches_pairs(planted):
    pdf, df = planted
    k = 20
    p = pdf[["a", "b"]].to_numpy()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, 1)[:, :k]
    kd = np.take_along_axis(d, nn, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, nn, 1), kd[nn])
    lrd = 1 / (reach.mean(1) + 1e-10)
    want = lrd[nn].mean(1) / lrd
    got = outliers.lof_flags(df, ["a", "b"], k).toPandas().sort_values("id")
    assert np.allclose(got.score, want)


def test_rpca_matches_a_dense_solver(planted):
    pdf, df = planted
    x, lam = pdf[["a", "b"]].to_numpy(), 0.05
    s, y = np.zeros_like(x), np.zeros_like(x)
    mu = 1.25 / np.linalg.norm(x, 2)
    for _ in range(12):
        u, sig, vt = np.linalg.svd(x - s + y / mu, full_matrices=False)
        low = (u * np.maximum(sig - 1 / mu, 0)) @ vt
        r = x - low + y / mu
        s = np.sign(r) * np.maximum(np.abs(r) - lam / mu, 0)
        y = y + mu * (x - low - s)
    got = outliers.rpca_flags(df, ["a", "b"], lam=lam, max_iter=12, tol=0).toPandas().sort_values("id")
    assert np.allclose(got.score, np.abs(s).sum(1), atol=1e-6)


def test_moment_fence_beats_its_neighbours(planted):
    _, df = planted
    p = outliers.fit_moment_fence(df, "a")
    assert p["best"]["objective"] == min(r["objective"] for r in p["trace"])
    assert df.count() - outliers.flag_moment_fence(df, p).filter("is_outlier").count() == p["best"]["kept"]


def test_fluctuation_drops_the_wanted_count(planted):
    out = outliers.fluctuation_flags(planted[1], ["a", "b"], ["id"], drop=7)
    assert out.filter("is_outlier").count() == 7 and out.count() == 600


# ---- transforms -------------------------------------------------------------------------

def test_power_exponents_maximise_the_likelihood(spark):
    rng = np.random.default_rng(7)
    v = np.exp(rng.normal(size=800) * .6) * 40
    df = frame(spark, pd.DataFrame({"v": v}))
    lam = power.fit_lambdas(df, {"v": F.col("v")}, "boxcox")["v"]

    def ll(k):
        t = np.log(v) if abs(k) < 1e-12 else (v ** k - 1) / k
        return (k - 1) * np.log(v).sum() - len(v) / 2 * np.log(t.var())
    grid = np.linspace(-2, 2, 4001)
    assert abs(lam - grid[np.argmax([ll(k) for k in grid])]) < 2e-3


@pytest.mark.parametrize("rows", [40, 250_000])
def test_ema_matches_pandas(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows)
    pdf = gapped()
    got = transform.transform(frame(spark, pdf), "ema", ["v"], order_by=["id"]).toPandas().sort_values("id")
    assert np.allclose(got.v_ema, pdf.v.fillna(0).ewm(span=5, adjust=False).mean())


def test_quantile_map_is_monotone(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"v": np.r_[rng.normal(size=500), np.full(50, .3)]})
    out = normalize.scale(frame(spark, pdf), "quantile", ["v"], output="normal").toPandas()["v"]
    assert abs(out.mean()) < .2 and abs(out.std() - 1) < .3


# ---- dependence ---------------------------------------------------------------------------

def brute_dcor(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v[None])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()
    a, b = centred(x), centred(y)
    return math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean()))


@pytest.mark.parametrize("block", [70, 10 ** 6])
def test_dominance_measures_match_pairs(xy, monkeypatch, block):
    monkeypatch.setattr(dominance, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(dominance.dominance_sums, "__defaults__", (None, block))
    pdf, df = xy
    x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
    assert np.isclose(A.distance_correlation_pair(df, "x", "y"), brute_dcor(x, y))
    assert np.isclose(A.kendall_pair(df, "x", "y"), pdf.x.corr(pdf.y, method="kendall") if _has_scipy() else tau(x, y))
    r, s = pdf.x.rank(), pdf.y.rank()
    c = ((x[None] < x[:, None]) & (y[None] < y[:, None])).sum(1)
    n = len(x)
    num = (n - 2) * (n - 3) * (c * (c - 1)).sum() + ((r - 1) * (r - 2) * (s - 1) * (s - 2)).sum() - 2 * (n - 2) * ((r - 2) * (s - 2) * c).sum()
    assert np.isclose(A.hoeffding_pair(df, "x", "y"), 30 * num / (n * (n - 1) * (n - 2) * (n - 3) * (n - 4)))


def _has_scipy():
    try:
        import scipy  # noqa: F401
    except ImportError:
        return False
    return True


def tau(x, y):
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (a * b).sum() / math.sqrt((a != 0).sum() * (b != 0).sum())


def test_hoeffding_refuses_a_dominant_value(spark):
    pdf = pd.DataFrame({"x": [1.0] * 60 + list(range(40)), "y": np.arange(100.0)})
    assert A.hoeffding_pair(frame(spark, pdf), "x", "y") is None


def test_identities(xy):
    _, df = xy
    d = df.withColumns({"x2": F.col("x"), "e": F.exp("x")})
    assert np.isclose(A.kendall_pair(d, "x", "x2"), 1) and np.isclose(A.hoeffding_pair(d, "x", "z"), A.hoeffding_pair(d.withColumn("x", F.exp("x")), "x", "z"))
    assert A.chatterjee_pair(d.withColumn("z2", F.col("z") * 2), "z", "z2", "id") > .98
    m = {(r["col_a"], r["col_b"]): r["value"] for r in A.mic(d, ["x", "x2", "z"]).collect()}
    assert m[("x", "x2")] > .95 and m[("x", "z")] < .4


def test_knn_information_matches_pairs(xy):
    pdf, df = xy
    k, n = 3, len(pdf)
    x, y = pdf.y.to_numpy() / pdf.y.std(ddof=0), pdf.z.to_numpy() / pdf.z.std(ddof=0)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    eps = np.sort(d, 1)[:, k - 1]
    nx, ny = (dx < eps[:, None]).sum(1), (dy < eps[:, None]).sum(1)
    from tabulith.functions.special import digamma
    want = digamma(n) + digamma(k) - np.mean([digamma(v) for v in nx]) - np.mean([digamma(v) for v in ny])
    assert np.isclose(A.knn_information(df, [("y", "z")], k)["y", "z"], max(0, want), atol=1e-9)


def test_rbf_criterion_matches_kernels(xy):
    pdf, df = xy
    band = {"x": 1.5, "y": 1.2}
    got = A.hsic_rbf(df, ["x", "y"], ["id"], bandwidth=band).first()["value"]
    ks = []
    for c in "xy":
        v = pdf[c].to_numpy()
        k = np.exp(-((v[:, None] - v) ** 2) / (2 * band[c] ** 2))
        h = np.eye(len(v)) - 1 / len(v)
        ks.append(h @ k @ h)
    want = np.trace(ks[0] @ ks[1]) / math.sqrt(np.trace(ks[0] @ ks[0]) * np.trace(ks[1] @ ks[1]))
    assert np.isclose(got, want, atol=1e-5)


def test_latent_correlation_is_recovered(spark):
    rng = np.random.default_rng(4)
    z = rng.multivariate_normal([0, 0], [[1, .6], [.6, 1]], 4000)
    got = A.polychoric(frame(spark, pd.DataFrame(z, columns=["a", "b"]))).first()["value"]
    assert abs(got - .6) < .05


def test_structure_search_links_dependent_columns(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=1500)
    pdf = pd.DataFrame({"a": a, "b": a + rng.normal(size=1500) * .1, "c": rng.normal(size=1500)})
    got = {frozenset((r["src"], r["dst"])) for r in A.bayesian_network(frame(spark, pdf)).collect()}
    assert frozenset(("a", "b")) in got and len(got) == 1


def test_sparse_precision_drops_weak_links(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=2000)
    b = a + rng.normal(size=2000)
    pdf = pd.DataFrame({"id": range(2000), "a": a, "b": b, "c": b + rng.normal(size=2000)})
    got = {(r["col_a"], r["col_b"]): r["value"] for r in A.sparse_partial_correlation(frame(spark, pdf), ["a", "b", "c"], ["id"]).collect()}
    assert got[("a", "b")] > .3 and got[("b", "c")] > .3 and abs(got[("a", "c")]) < .12


def test_results_do_not_depend_on_partitions(spark, xy):
    pdf, _ = xy
    runs = [A.spearman(frame(spark, pdf, n), ["x", "y", "z"]).orderBy("col_a", "col_b").toPandas()["value"].to_numpy() for n in (1, 7, 64)]
    assert np.allclose(runs[0], runs[1]) and np.allclose(runs[0], runs[2])
    assert len({profile.fingerprint_text(frame(spark, pdf, n)) for n in (1, 7, 64)}) == 1


# ---- conditioning, ledger -------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["winsorize", "soft_clamp"])
def test_grid_matches_direct_evaluation(spark, kind):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=400), rng.normal(size=12) * 20]
    df = frame(spark, pd.DataFrame({"x": x}))
    bound = conditioning.Bound("x", -3.0, 3.0)
    ref = conditioning.references(df, ["x"])
    for c in conditioning.grid(df, ref, {"x": bound}, kind)[::7]:
        lo, hi = np.percentile(x, c.lo_pct), np.percentile(x, c.hi_pct)
        t = np.clip(x, lo, hi) if kind == "winsorize" else lo + (hi - lo) * (.5 + .5 * np.tanh((x - (lo + hi) / 2) / (.15 * (hi - lo))))
        iqr = max(np.subtract(*np.percentile(x, [75, 25])), .01 * np.ptp(x))
        r = [np.mean(t < -3), np.mean(t > 3), abs(np.percentile(t, 5) - np.percentile(x, 5)) / iqr, abs(np.percentile(t, 95) - np.percentile(x, 95)) / iqr]
        d = sum(w * max(0, v - tol) for w, v, tol in zip((1, 1, .5, .5), r, (.05, .05, .2, .2)))
        om = np.abs(t - x).mean() / iqr
        ok = t.min() >= -3 - 1e-9 and t.max() <= 3 + 1e-9 and np.percentile(np.abs(t - x), 90) <= 3 * iqr and om <= .18
        assert np.isclose(c.d_after, d) and np.isclose(c.omega, om) and c.feasible == ok


def test_influence_is_exact_leave_one_out(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=120), 1)
    pdf = pd.DataFrame({"id": range(120), "x": x})
    df = frame(spark, pdf)
    refs = conditioning.references(df, ["x"])
    refs["x"].q05 -= 1.0  # a shifted reference makes every part count
    b = conditioning.Bound("x", -1.0, 1.0)
    got = conditioning.influence(df, refs, {"x": b}, .01, .1).toPandas().sort_values("id")["evi_x"]
    r = refs["x"]

    def total(v):
        return (max(0, np.mean(v < -1) - .01) + max(0, np.mean(v > 1) - .01) + .5 * max(0, abs(np.percentile(v, 5) - r.q05) / r.iqr - .1)
                + .5 * max(0, abs(np.percentile(v, 95) - r.q95) / r.iqr - .1))
    assert np.allclose(got, [total(x) - total(np.delete(x, i)) for i in range(120)])


def test_winsorize_twice_is_once(xy):
    _, df = xy
    p = {"columns": {"x": [-1.0, 1.0]}}
    once = conditioning.apply(df, p)
    assert once.exceptAll(conditioning.apply(once, p)).count() == 0


def test_replay_equals_direct_and_reports_unknown_steps(xy):
    _, df = xy
    a = ledger.Asset.start(df)
    a = a.apply("normalize_scale", normalize.fit(a.df, "robust", ["x"])).apply("create_derived_column", {"name": "w", "expression": "x * y"})
    a = a.apply("remove_outliers", outliers.fit(a.df, "zscore", ["w"]))
    again = ledger.replay(df, a.ledger)
    assert profile.fingerprint_text(again) == profile.fingerprint_text(a.df)
    bad = [*a.ledger, {"operation": "no_such_step", "params": "{}"}]
    with pytest.raises(KeyError):
        ledger.replay(df, bad)
    assert ledger.replay(df, bad, on_error="skip").count() == a.df.count()


def test_bundle_round_trip(spark, xy, tmp_path):
    _, df = xy
    a = ledger.Asset.start(df).apply("manage_columns", {"columns_final": ["id", "x"], "rename_map": {"x": "xx"}})
    writers.save_bundle(a.df, a.ledger, str(tmp_path / "b"))
    back, steps = writers.load_bundle(spark, str(tmp_path / "b"))
    assert back.columns == ["id", "xx"] and [s["operation"] for s in steps] == ["load_dataset", "manage_columns"]


def test_registered_operation_is_replayable(xy):
    _, df = xy
    ledger.register_operation("double_x", lambda d, p: d.withColumn("x", F.col("x") * p["by"]))
    a = ledger.Asset.start(df).apply("double_x", {"by": 2})
    assert ledger.replay(df, a.ledger).agg(F.sum("x")).first()[0] == a.df.agg(F.sum("x")).first()[0]


# ---- sources and contracts ---------------------------------------------------------------------

def test_readers_sniff_and_tidy(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" a ;b;b;when\n1; x ;N/A;2024-01-02\n2;y;-;2024-01-03\nbad;z;q;2024-01-04\n4;w;r;2024-01-05\n5;v;s;2024-01-06\n")
    df = readers.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b", "b_1", "when"] or df.columns[0] == "a"
    assert dict(df.dtypes)["a"] == "double" and dict(df.dtypes)["when"] == "timestamp"
    assert df.filter("a is null").count() == 1
    (tmp_path / "t.json").write_text('[{"k": 1, "v": 2.5},\n {"k": 2, "v": null}]')
    assert readers.read_table(spark, str(tmp_path / "t.json")).count() == 2
    (tmp_path / "t.ndjson").write_text('{"k": 1}\n{"k": 2}\n{"k": 3}\n')
    assert readers.read_table(spark, str(tmp_path / "t.ndjson")).count() == 3
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "t.csv"), options=readers.ReadOptions(max_bytes=3))
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "t.xyz"))


def test_contract_codec_and_infinity(spark):
    c = C.Contract.from_dict({"observable": "v", "nullable": "no", "upper_bound": "5", "admissible_operations": "log, clip"})
    assert not c.nullable and c.upper_bound == 5.0 and c.admissible_operations == ("log", "clip")
    assert C.Contract.from_dict(c.to_dict()) == c
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),)], "v double")
    row = C.validate(df, [c]).first()
    assert row["status"] == "FAIL" and len(row["violations"]) == 3


# ---- learning ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def learn(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["id"] = range(500)
    pdf["y"] = 3 * pdf.a - 2 * pdf.b + rng.normal(size=500) * .3
    pdf["k"] = np.where(pdf.a + pdf.b * .5 + rng.normal(size=500) * .2 > 0, "pos", "neg")
    return pdf, spark.createDataFrame(pdf).cache()


def test_rankings_put_the_driver_first(learn):
    _, df = learn
    t = ranking.task(df.drop("k"), "y", ["id"])
    for fn in (ranking.linear, ranking.ridge, ranking.lasso, ranking.mutual_information, ranking.feature_clustering, ranking.bayesian_importance,
               lambda t: ranking.relieff(t, n_iter=150), lambda t: ranking.permutation_importance(t, 2, 5, 5), lambda t: ranking.boruta(t, 2, 5, 5),
               lambda t: ranking.shap_scores(ranking.shap(t, 5, 6, 10)), ranking.mrmr, ranking.kruskal_wallis, ranking.mann_whitney):
        top = fn(t).orderBy(F.desc("score")).first()["feature"]
        assert top in ("a", "b"), fn
    blanket = {r["feature"] for r in ranking.markov_blanket(t).filter("score = 1").collect()}
    assert {"a", "b"} <= blanket


def test_shap_is_additive(learn):
    _, df = learn
    t = ranking.task(df.select("id", "a", "b", "y").limit(40), "y", ["id"])
    phi = ranking.shap(t, 5, 5, 8).toPandas()
    model = ranking._forest(ranking._prepared(t), 5, 5, 42)
    from pyspark.ml.functions import array_to_vector
    pred = model.predict(t.rows.withColumn("features", array_to_vector(F.array(*t.xs)))).select("k0", "prediction").toPandas().set_index("k0")["prediction"]
    total = phi.groupby("k0")["phi"].sum() + phi.groupby("k0")["base"].first()
    assert np.allclose(total.loc[pred.index], pred, atol=1e-4)


@pytest.mark.parametrize("method,target,least", [("linear", "y", .95), ("ridge", "y", .95), ("lasso", "y", .95), ("bayesian_ridge", "y", .95),
                                                 ("knn", "y", .7), ("gradient_boosting", "y", .6), ("adaboost", "y", .5), ("logistic", "k", .85),
                                                 ("ridge", "k", .85), ("naive_bayes", "k", .85), ("adaboost", "k", .75), ("svm", "k", .8), ("knn", "k", .8)])
def test_models_learn(learn, method, target, least):
    _, df = learn
    kw = {"gradient_boosting": {"n_trees": 15}, "adaboost": {"n_rounds": 8}, "svm": {"n_features": 60}}.get(method, {})
    run = M.evaluate(df, list("abcd"), target, method, ["id"], **kw)
    m = run.metrics.first()
    assert m["r2" if target == "y" else "accuracy"] >= least
    run.prepared.release()


def test_model_hash_is_repeatable(learn):
    _, df = learn
    hashes = {M.evaluate(df, list("abcd"), "y", "ridge", ["id"]).fitted.state_hash for _ in range(2)}
    assert len(hashes) == 1


def test_search_keeps_the_true_features(learn):
    _, df = learn
    space = descriptors.generate(df, list("abcd"), ["sq"], ["mul"], binary_cap=4)
    for direction in ("forward", "backward"):
        fit = descriptors.search(df, "y", space, direction, ["id"], preselect_k=8, **({"max_features": 4} if direction == "forward" else {}))
        assert {"a", "b"} <= set(fit.features) and fit.cv_r2 > .95 and "scale(`a`)" in fit.equation


def test_shortcut_is_called(learn):
    _, df = learn
    d = df.withColumn("p", F.col("a") * 2)
    row = audit.shortcut(d, "y", "p", ["a"], ["a", "p"], ["id"], "linear").first()
    assert row["r2_proxy"] > .99 and row["verdict"] == "shortcut"
    assert audit.recoverability(d, "p", ["a"], ["id"]).first()["verdict"] == "proxy_recoverable"


def test_failing_variants_are_errors_unless_skipped(xy):
    _, df = xy
    cond = conditioning.condition(df, ["x"], n_variants=3)
    calls = []

    def fn(d):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("first fails")
        return d.agg(F.lit("x").alias("feature"), F.avg("x").alias("score"))
    assert stability.across_variants(cond, fn, on_error="skip").count() == 2
    calls.clear()
    with pytest.raises(ValueError):
        stability.across_variants(cond, fn)
    with pytest.raises(RuntimeError):
        stability.across_variants(cond, lambda d: (_ for _ in ()).throw(ValueError("no")), on_error="skip")


# ---- plans and streams -----------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_windows_are_partitioned(spark, xy):
    """Only per-range summaries may pass through one partition."""
    _, df = xy
    text = plan(ordering.dense_index(df, ["id"]))
    row_window = text.split("Window")[1].split("\n")[0]
    assert "__bucket" in row_window
    assert text.count("SinglePartition") <= 1


def test_filters_and_columns_reach_the_scan(spark):
    df = readers.read_table(spark, "/root/testdata/sf0.001/lineitem.parquet")
    out = normalize.scale(df.filter("l_quantity > 45"), "standard", ["l_tax"]).select("l_tax")
    text = plan(out)
    assert "GreaterThan(l_quantity,45.0)" in text and "l_extendedprice" not in text


def test_streams_take_fitted_steps_only(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{src}/supplier.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "supplier.parquet").parquet(src)
    p = normalize.fit(spark.read.parquet(f"{src}/supplier.parquet"), "minmax", ["s_acctbal"])
    q = stream.write(stream.apply_steps(s, [("normalize_scale", p)]), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).agg(F.min("s_acctbal"), F.max("s_acctbal")).first()
    assert tuple(got) == (0.0, 1.0)
    with pytest.raises(ValueError):
        stream.apply_steps(s, [("transform_columns", {"transform_type": "rank", "columns": ["s_acctbal"]})])


def test_quantile_map_is_the_same_at_every_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"v": np.concatenate([np.round(rng.normal(size=1500), 2), np.full(700, 0.5)]), "w": rng.exponential(size=2200)})
    pdf.loc[:20, "w"] = np.nan
    df = frame(spark, pdf)
    small = normalize.fit(df, "quantile", ["v", "w"], n_quantiles=301)["fitted"]
    monkeypatch.setattr(normalize, "EXACT_ROWS", 100)
    large = normalize.fit(df, "quantile", ["v", "w"], n_quantiles=301)["fitted"]
    for c in ("v", "w"):
        assert np.allclose(small[c]["knots"], large[c]["knots"], atol=1e-12), c


def test_margin_regression_is_near_its_optimum(spark):
    from tabulith.operators import models
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = x @ [2.0, -1.0, 0.0] + 0.5 + rng.standard_t(2, size=400)
    pdf = pd.DataFrame({"id": np.arange(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    p = models.prepare(frame(spark, pdf), ["a", "b", "c"], "y", ["id"])
    rows = p.train.select("label", *p.xs).toPandas()

    def cost(b, b0, eps):
        return (b ** 2).sum() / 2 + np.maximum(0, np.abs(rows["label"] - rows[p.xs].to_numpy() @ b - b0) - eps).sum()

    for eps in (0.0, 0.3):
        b, b0 = models._margin_regression(p.train, p.xs, 1.0, eps, 40)
        least = cost(b, b0, eps)
        for _ in range(300):
            assert least <= cost(b + rng.normal(scale=0.02, size=3), b0 + rng.normal(scale=0.02), eps) + 0.1
    fitted = models.linear_svc(p, max_iter=15)
    assert abs(fitted.importance[0] / fitted.importance[1] - 2) < 0.4
    assert models.kernel_svm(p, n_features=10).predict(p.test).filter("prediction is null").count() == 0


def test_too_deep_trees_are_refused(spark):
    from tabulith.operators import models
    with pytest.raises(ValueError):
        models._depth(31, 12)
