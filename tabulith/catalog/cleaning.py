"""Queries: missing values, outliers, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rows_frame

from ..operators import impute, normalize, outliers, profile, tidy
from ..operators.steps import moment_fence  # noqa: F401 - registers the steps
from ..sources.writers import split_flagged
from .base import R, query, rd, rounded, table, union_sql
from .tables import HOLES_SQL, OUTLIER_PRICE, holes, line

# ---- missing values --------------------------------------------------------
GAPPY = "CASE WHEN event_id % 10 < 3 THEN NULL ELSE value END"


def gaps(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "user_id", f"{GAPPY} AS v")


_GAPS = f"(SELECT event_id, user_id, {GAPPY} AS v FROM events)"


def _holes(spark, d):
    return holes(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "tax", "disc")


_H = f"(SELECT l_orderkey, l_linenumber, l_quantity, tax, disc FROM {HOLES_SQL})"


@query("m1_drop_rows", f"SELECT * FROM {_H} WHERE tax IS NOT NULL AND disc IS NOT NULL")
def _(spark, d):
    return impute.impute(_holes(spark, d), "drop_rows")


@query("m2_drop_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(spark, d):
    return impute.impute(_holes(spark, d), "drop_cols")


@query("m2_drop_columns_threshold", f"SELECT l_orderkey, l_linenumber, l_quantity, {R('disc')} AS disc FROM {_H}")
def _(spark, d):
    df = _holes(spark, d)
    return rounded(impute.impute(df, "drop_cols", min_non_null=int(df.count() * 0.88)), ["disc"])


def _fill_sql(stat):
    return (f"SELECT l_orderkey, l_linenumber, {R(f'coalesce(tax, (SELECT {stat.format(c='tax')} FROM {_H}))')} AS tax, "
            f"{R(f'coalesce(disc, (SELECT {stat.format(c='disc')} FROM {_H}))')} AS disc FROM {_H}")


for _name, _method, _stat in (("m3_mean", "mean", "avg({c})"), ("m4_median", "median", "quantile_cont({c}, 0.5)"),
                              ("m5_mode", "mode", None)):
    _sql = _fill_sql(_stat) if _stat else (
        "WITH t AS (SELECT tax AS v FROM {h} WHERE tax IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, tax LIMIT 1), "
        "d AS (SELECT disc AS v FROM {h} WHERE disc IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, disc LIMIT 1) "
        "SELECT l_orderkey, l_linenumber, round(coalesce(tax, t.v), 6) AS tax, round(coalesce(disc, d.v), 6) AS disc FROM {h}, t, d"
    ).format(h=_H)

    @query(_name, _sql)
    def _(spark, d, method=_method):
        out = impute.impute(_holes(spark, d), method, columns=["tax", "disc"])
        return rounded(out.select("l_orderkey", "l_linenumber", "tax", "disc"), ["tax", "disc"])


@query("m6_constant", f"SELECT l_orderkey, l_linenumber, l_quantity, coalesce(tax, -1) AS tax, coalesce(disc, -1) AS disc FROM {_H}")
def _(spark, d):
    return impute.impute(_holes(spark, d), "constant", fill_value=-1.0)


_NEIGHBOURS = f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM {_GAPS}),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos) AS pa,
 first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb,
 last_value(v IGNORE NULLS) OVER (ORDER BY pos) AS va,
 first_value(v IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM p) """


@query("m7_linear", _NEIGHBOURS + f"""SELECT event_id, {R('coalesce(v, CASE WHEN pa IS NULL THEN vb WHEN pb IS NULL THEN va ELSE va + (vb - va) * (pos - pa) / (pb - pa)::DOUBLE END)')} AS v FROM k""")
def _(spark, d):
    out = impute.impute(gaps(spark, d), "linear", columns=["v"], order_by=["event_id"])
    return out.select("event_id", rd("v").alias("v"))


@query("m7_linear_limit", _NEIGHBOURS + f"""SELECT event_id, {R('coalesce(v, CASE WHEN pos - pa <= 1 OR pb - pos <= 1 THEN CASE WHEN pa IS NULL THEN vb WHEN pb IS NULL THEN va ELSE va + (vb - va) * (pos - pa) / (pb - pa)::DOUBLE END END)')} AS v FROM k""")
def _(spark, d):
    out = impute.impute(gaps(spark, d), "linear", columns=["v"], order_by=["event_id"], limit=1)
    return out.select("event_id", rd("v").alias("v"))


for _name in ("pchip", "akima"):
    @query({"pchip": "m8_pchip", "akima": "m9_akima"}[_name])
    def _(spark, d, method=_name):
        out = impute.impute(gaps(spark, d), method, columns=["v"], order_by=["event_id"])
        return out.select("event_id", rd("v").alias("v"))


@query("m10_spline_by_user")
def _(spark, d):
    out = impute.impute(gaps(spark, d), "spline", columns=["v"], order_by=["event_id"], partition_by=["user_id"])
    return out.select("event_id", "user_id", rd("v").alias("v"))


@query("m11_ffill", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS v FROM {_GAPS}")
def _(spark, d):
    return impute.impute(gaps(spark, d), "ffill", columns=["v"], order_by=["event_id"]).select("event_id", "v")


@query("m11_ffill_limit", _NEIGHBOURS + "SELECT event_id, CASE WHEN pos - pa <= 2 THEN va END AS v FROM k")
def _(spark, d):
    return impute.impute(gaps(spark, d), "ffill", columns=["v"], order_by=["event_id"], limit=2).select("event_id", "v")


@query("m12_bfill", f"""SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {_GAPS}""")
def _(spark, d):
    out = impute.impute(gaps(spark, d), "bfill", columns=["v"], order_by=["event_id"], partition_by=["user_id"])
    return out.select("event_id", "v")


# ---- outliers --------------------------------------------------------------

def priced(spark, d):
    return line(spark, d).selectExpr("l_orderkey", "l_linenumber", "l_quantity", f"{OUTLIER_PRICE} AS price",
                                     "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax")


_P = f"(SELECT l_orderkey, l_linenumber, l_quantity, {OUTLIER_PRICE} AS price, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem)"
_COLS = ["l_quantity", "price", "tax"]
_FILLED = (f"WITH p AS (SELECT * FROM {_P}), f AS (SELECT l_orderkey, l_linenumber, l_quantity, "
           "coalesce(price, (SELECT quantile_cont(price, 0.5) FROM p)) AS price, coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM p)) AS tax FROM p)")
_KEEP = "l_orderkey, l_linenumber"


def _flags(df):
    return df.select("l_orderkey", "l_linenumber", rd("score", 5).alias("score"), "is_outlier")


_ZCOLS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _COLS)
_ZMAX = "greatest(" + ", ".join(f"abs({c} - m_{c}) / s_{c}" for c in _COLS) + ")"


@query("o01_zscore", f"{_FILLED}, s AS (SELECT {_ZCOLS} FROM f) SELECT {_KEEP}, {R(_ZMAX, 5)} AS score, {_ZMAX} > 2.6 AS is_outlier FROM f, s")
def _(spark, d):
    df = priced(spark, d)
    return _flags(outliers.flag(df, outliers.fit(df, "zscore", _COLS)))


_MED = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _COLS)
_MAD = ", ".join(f"quantile_cont(abs({c} - m_{c}), 0.5) AS a_{c}" for c in _COLS)
_MZ = "greatest(" + ", ".join(f"0.6745 * abs({c} - m_{c}) / a_{c}" for c in _COLS) + ")"


@query("o02_modified_zscore", f"{_FILLED}, m AS (SELECT {_MED} FROM f), a AS (SELECT {_MAD} FROM f, m) "
       f"SELECT {_KEEP}, {R(_MZ, 5)} AS score, {_MZ} > 19.35 AS is_outlier FROM f, m, a")
def _(spark, d):
    df = priced(spark, d)
    return _flags(outliers.flag(df, outliers.fit(df, "mzscore", _COLS)))


@query("o03_iqr", f"""WITH p AS (SELECT * FROM {_P}), b AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM p)
SELECT {_KEEP}, price FROM p, b WHERE price BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def _(spark, d):
    df = priced(spark, d)
    return outliers.remove(df, outliers.fit(df, "iqr", ["price"])).select("l_orderkey", "l_linenumber", "price")


@query("o03b_sequential_iqr", f"""WITH p AS (SELECT * FROM {_P}), b AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM p),
p2 AS (SELECT p.* FROM p, b WHERE price IS NULL OR price BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
c AS (SELECT quantile_cont(tax, 0.25) AS a, quantile_cont(tax, 0.75) AS b FROM p2)
SELECT {_KEEP} FROM p2, c WHERE tax IS NULL OR tax BETWEEN a - 0.6 * (b - a) AND b + 0.6 * (b - a)""")
def _(spark, d):
    df = priced(spark, d)
    one = outliers.fit_sequential(df, ["price"])
    kept = outliers.remove(df, one)
    return outliers.remove(kept, outliers.fit_sequential(kept, ["tax"], factor=0.6)).select("l_orderkey", "l_linenumber")


@query("o03b_sequential_zscore", f"""WITH p AS (SELECT * FROM {_P}), b AS (SELECT avg(price) AS m, stddev_samp(price) AS s FROM p),
p2 AS (SELECT p.* FROM p, b WHERE price IS NULL OR abs(price - m) <= 3 * s), c AS (SELECT avg(tax) AS m, stddev_samp(tax) AS s FROM p2)
SELECT {_KEEP} FROM p2, c WHERE tax IS NULL OR abs(tax - m) <= 3 * s""")
def _(spark, d):
    df = priced(spark, d)
    return outliers.remove(df, outliers.fit_sequential(df, ["price", "tax"], "zscore")).select("l_orderkey", "l_linenumber")


@query("o04_euclidean", f"""WITH f AS (SELECT {_KEEP}, l_discount * 20 AS a, l_tax * 30 AS b FROM lineitem), s AS (SELECT avg(a) AS ma, avg(b) AS mb FROM f)
SELECT {_KEEP}, {R('sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb))', 5)} AS score, sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb)) > 1.3 AS is_outlier FROM f, s""")
def _(spark, d):
    df = line(spark, d).selectExpr("l_orderkey", "l_linenumber", "l_discount * 20 AS a", "l_tax * 30 AS b")
    return _flags(outliers.flag(df, outliers.fit(df, "euclidean", ["a", "b"], threshold=1.3)))


@query("o05_mahalanobis", f"""{_FILLED}, s AS (SELECT avg(l_quantity) AS ma, avg(price) AS mb, var_samp(l_quantity) AS va, var_samp(price) AS vb, covar_samp(l_quantity, price) AS cv FROM f)
SELECT {_KEEP}, {R('sqrt(((l_quantity - ma) ** 2 * vb - 2 * (l_quantity - ma) * (price - mb) * cv + (price - mb) ** 2 * va) / (va * vb - cv * cv))', 5)} AS score,
 sqrt(((l_quantity - ma) ** 2 * vb - 2 * (l_quantity - ma) * (price - mb) * cv + (price - mb) ** 2 * va) / (va * vb - cv * cv)) > 5.5 AS is_outlier FROM f, s""")
def _(spark, d):
    df = priced(spark, d)
    return _flags(outliers.flag(df, outliers.fit(df, "mahalanobis", ["l_quantity", "price"])))


@query("o06_kmeans_distance")
def _(spark, d):
    return _flags(outliers.kmeans_flags(priced(spark, d), _COLS))


_DB = """SELECT c_custkey, c_acctbal / 1000 AS a, CASE WHEN c_custkey % 250 = 0 THEN 60 + c_custkey / 20.0 ELSE c_nationkey END::DOUBLE AS b FROM customer"""


@query("o07_dbscan_noise", f"""WITH f AS ({_DB}), s AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb FROM f),
z AS (SELECT c_custkey, (a - ma) / sa AS a, (b - mb) / sb AS b FROM f, s),
p AS (SELECT x.c_custkey AS i, y.c_custkey AS j FROM z x JOIN z y ON sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) <= 0.3),
core AS (SELECT i FROM p GROUP BY i HAVING count(*) >= 5)
SELECT c_custkey, c_custkey NOT IN (SELECT p.i FROM p JOIN core ON p.j = core.i) AS is_outlier FROM z""")
def _(spark, d):
    df = table(spark, d, "customer").selectExpr(
        "c_custkey", "c_acctbal / 1000 AS a",
        "CAST(CASE WHEN c_custkey % 250 = 0 THEN 60 + c_custkey / 20.0 ELSE c_nationkey END AS DOUBLE) AS b")
    return outliers.dbscan_noise(df, ["a", "b"], eps=0.3, min_samples=5).select("c_custkey", "is_outlier")


@query("o08_isolation_forest")
def _(spark, d):
    return _flags(outliers.isolation_flags(priced(spark, d), _COLS, ["l_orderkey", "l_linenumber"]))


@query("o09_elliptic_envelope")
def _(spark, d):
    return _flags(outliers.envelope_flags(priced(spark, d), _COLS, ["l_orderkey", "l_linenumber"]))


@query("o10_local_outlier_factor")
def _(spark, d):
    df = table(spark, d, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS a", "p_retailprice AS b")
    return outliers.lof_flags(df, ["a", "b"]).select("p_partkey", rd("score", 5).alias("score"), "is_outlier")


# no two distances from a part tie, so the neighbours are the same in any engine
@query("o10_local_outlier_factor_untied", f"""WITH f AS MATERIALIZED (SELECT p_partkey AS i, p_size::DOUBLE AS a, p_retailprice + p_partkey * p_partkey / 65536e0 AS b FROM part),
n AS MATERIALIZED (SELECT x.i, y.i AS j, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS d FROM f x JOIN f y ON x.i <> y.i QUALIFY row_number() OVER (PARTITION BY x.i ORDER BY d, j) <= 20),
k AS (SELECT i, max(d) AS kd FROM n GROUP BY i),
l AS (SELECT n.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON k.i = n.j GROUP BY n.i),
s AS (SELECT n.i, avg(lj.lrd) / any_value(li.lrd) AS score FROM n JOIN l lj ON lj.i = n.j JOIN l li ON li.i = n.i GROUP BY n.i)
SELECT i AS p_partkey, {R('score', 5)} AS score, score > (SELECT quantile_cont(score, 0.95) FROM s) AS is_outlier FROM s""")
def _(spark, d):
    df = table(spark, d, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS a", "p_retailprice + p_partkey * p_partkey / 65536D AS b")
    return outliers.lof_flags(df, ["a", "b"]).select("p_partkey", rd("score", 5).alias("score"), "is_outlier")


@query("o11_robust_pca")
def _(spark, d):
    return _flags(outliers.rpca_flags(priced(spark, d), _COLS, lam=0.02, max_iter=15))


@query("o12_fluctuation")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = outliers.fluctuation_flags(df, ["o_totalprice"], ["o_orderkey"])
    return out.select("o_orderkey", rd("score").alias("score"), "is_outlier")


_THETAS = (0.5, 1.0, 1.5, 3.0, 5.0)


@query("o13_objective_grid", f"""WITH p AS (SELECT price FROM {_P}), b AS (SELECT quantile_cont(price, 0.25) a, quantile_cont(price, 0.75) b, count(*) AS n FROM p),
k AS (SELECT theta, price, n FROM p, b, (VALUES {', '.join(f'({t}::DOUBLE)' for t in _THETAS)}) t(theta) WHERE price BETWEEN a - theta * (b - a) AND b + theta * (b - a)),
m AS (SELECT theta, n, avg(price) AS mu FROM k GROUP BY 1, 2), c AS (SELECT k.theta, k.n, count(*) AS kept, avg((price - mu) ** 2) AS v, avg((price - mu) ** 3) AS t, avg((price - mu) ** 4) AS f FROM k JOIN m USING (theta) GROUP BY 1, 2)
SELECT theta, kept, {R('t / v ** 1.5', 5)} AS skewness, {R('f / v ** 2 - 3', 5)} AS kurtosis,
 {R('(f / v ** 2 - 3) ** 2 + (t / v ** 1.5) ** 2 + 0.5 * (n - kept) / n', 4)} AS objective FROM c""")
def _(spark, d):
    df = priced(spark, d)
    score, _, _ = outliers.fence_score(df, "price")
    rows = [(r["theta"], r["kept"], r["skewness"], r["kurtosis"], r["objective"])
            for r in outliers.objective_grid(df, "price", score, _THETAS)]
    out = rows_frame(spark, rows, "theta double, kept bigint, skewness double, kurtosis double, objective double")
    return rounded(rounded(out, ["skewness", "kurtosis"], 5), ["objective"], 4)


@query("o13_moment_fence")
def _(spark, d):
    df = priced(spark, d)
    return _flags(outliers.flag_moment_fence(df, outliers.fit_moment_fence(df, "price")))


@query("o14_restore_keys", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 400000 OR o_orderkey % 5 = 0""")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    kept, flagged = split_flagged(df.withColumn("is_outlier", F.col("o_totalprice") > 400000))
    return tidy.restore(kept, df, flagged.filter("o_orderkey % 5 = 0"), "o_orderkey")


@query("o14_restore_nearest", """WITH f AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000)
SELECT o_orderkey, o_totalprice FROM f ORDER BY abs(o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)), o_orderkey LIMIT 10""")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    med = outliers.medians(df, ["o_totalprice"])["o_totalprice"]
    return tidy.nearest_to_median(df.filter("o_totalprice > 400000"), "o_totalprice", 10, med, "o_orderkey")


def _pop_shape(stage, col, src):
    return (f"SELECT '{stage}' AS stage, '{col}' AS \"column\", avg(z ** 3) / avg(z ** 2) ** 1.5 AS s, avg(z ** 4) / avg(z ** 2) ** 2 - 3 AS k "
            f"FROM (SELECT {col} - (SELECT avg({col}) FROM {src}) AS z FROM {src})")


@query("o15_shape_change", f"""WITH p AS (SELECT * FROM {_P}), k AS (SELECT * FROM p WHERE price < 120000), r AS ({union_sql(
    [_pop_shape(s, c, t) for s, t in (('before', 'p'), ('after', 'k')) for c in ('l_quantity', 'price')])})
SELECT stage, "column", {R('s', 5)} AS skewness, {R('k', 5)} AS kurtosis,
 CASE WHEN abs(s) < 0.5 THEN 'symmetric' WHEN s > 1 THEN 'strong right skew' WHEN s > 0 THEN 'mild right skew' WHEN s < -1 THEN 'strong left skew' ELSE 'mild left skew' END AS skew_label,
 CASE WHEN abs(k) < 0.5 THEN 'normal tails' WHEN k > 0 THEN 'heavy tails' ELSE 'light tails' END AS kurt_label FROM r""")
def _(spark, d):
    df = priced(spark, d)
    return rounded(outliers.shape_change(df, df.filter("price < 120000"), ["l_quantity", "price"]), ["skewness", "kurtosis"], 5)


@query("o16_numeric_summary", union_sql([
    f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std, "
    f"count(*) - count({c}) AS na FROM {_P}" for c in ("l_orderkey", "l_linenumber", *_COLS)]))
def _(spark, d):
    return rounded(profile.outlier_summary(priced(spark, d)), ["mean", "std"], 4)


# ---- normalisation -----------------------------------------------------------
_N = "(SELECT l_orderkey, l_linenumber, l_extendedprice AS price, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem)"


def _norm(spark, d, method, digits=6, cols=("price", "tax"), **kw):
    df = line(spark, d).selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice AS price", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax")
    return rounded(normalize.scale(df, method, list(cols), **kw), cols, digits)


def _norm_sql(expr, agg, digits=6):
    """expr/agg use {c}; aggregates come from one row ``s``."""
    cols = ", ".join(f"{R(expr.format(c=c), digits)} AS {c}" for c in ("price", "tax"))
    return f"WITH n AS (SELECT * FROM {_N}), s AS (SELECT {', '.join(agg.format(c=c) for c in ('price', 'tax'))} FROM n) SELECT l_orderkey, l_linenumber, {cols} FROM n, s"


@query("n1_minmax", _norm_sql("-1 + ({c} - a_{c}) / (b_{c} - a_{c}) * 3", "min({c}) AS a_{c}, max({c}) AS b_{c}"))
def _(spark, d):
    return _norm(spark, d, "minmax", low=-1.0, high=2.0)


@query("n2_standard", _norm_sql("({c} - m_{c}) / s_{c}", "avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"))
def _(spark, d):
    return _norm(spark, d, "standard")


@query("n2_standard_sample", _norm_sql("({c} - m_{c}) / s_{c}", "avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}"))
def _(spark, d):
    return _norm(spark, d, "standard", ddof=1)


@query("n3_robust", _norm_sql("({c} - m_{c}) / (b_{c} - a_{c})", "quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}"))
def _(spark, d):
    return _norm(spark, d, "robust")


@query("n4_log", _norm_sql("ln({c} + o_{c})", "CASE WHEN min({c}) <= 0 THEN abs(min({c})) + 1 ELSE 0 END AS o_{c}"))
def _(spark, d):
    return _norm(spark, d, "log")


@query("n4_log10", _norm_sql("log10({c} + o_{c})", "CASE WHEN min({c}) <= 0 THEN abs(min({c})) + 1 ELSE 0 END AS o_{c}"))
def _(spark, d):
    return _norm(spark, d, "log", base="10")


@query("n5_boxcox_fixed", _norm_sql("(({c} + o_{c}) ** 0.5 - 1) / 0.5", "CASE WHEN min({c}) <= 0 THEN abs(min({c})) + 1 ELSE 0 END AS o_{c}", 5))
def _(spark, d):
    return _norm(spark, d, "boxcox", 5, lam=0.5, standardize=False)


@query("n5_boxcox_mle")
def _(spark, d):
    return _norm(spark, d, "boxcox", 5)


@query("n6_yeojohnson_fixed", _norm_sql("CASE WHEN {c} >= 0 THEN (({c} + 1) ** 0.25 - 1) / 0.25 ELSE -((1 - {c}) ** 1.75 - 1) / 1.75 END", "min({c}) AS a_{c}"))
def _(spark, d):
    return _norm(spark, d, "yeojohnson", lam=0.25, standardize=False)


@query("n6_yeojohnson_mle")
def _(spark, d):
    return _norm(spark, d, "yeojohnson", 5)


@query("n7_quantile_uniform")
def _(spark, d):
    return _norm(spark, d, "quantile", 5)


@query("n7_quantile_normal")
def _(spark, d):
    return _norm(spark, d, "quantile", 5, output="normal")


@query("n8_winsor", _norm_sql("greatest(least({c}, b_{c}), a_{c}) + CASE WHEN {c} IS NULL THEN NULL ELSE 0 END", "quantile_cont({c}, 0.05) AS a_{c}, quantile_cont({c}, 0.95) AS b_{c}", 4))
def _(spark, d):
    return _norm(spark, d, "winsor", 4, q_low=5.0, q_high=95.0)


@query("n9_log1p_clip", _norm_sql("ln(1 + greatest({c}, 0)) + CASE WHEN {c} IS NULL THEN NULL ELSE 0 END", "min({c}) AS a_{c}"))
def _(spark, d):
    return _norm(spark, d, "log1p_clip")


@query("n9_sqrt_clip", _norm_sql("sqrt(greatest({c}, 0)) + CASE WHEN {c} IS NULL THEN NULL ELSE 0 END", "min({c}) AS a_{c}"))
def _(spark, d):
    return _norm(spark, d, "sqrt_clip")

