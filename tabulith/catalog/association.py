"""Queries: dependence measures."""

from __future__ import annotations

from itertools import combinations, permutations

from ..functions.columns import rows_frame
from ..functions.ordering import dense_index, with_lags
from ..operators import association as A
from .base import R, query, rd, rounded, table, union_sql
from .tables import line

# a: plain, b: plain, c: few levels with gaps, d: depends on a
_X = {"a": "l_quantity", "b": "l_extendedprice / 1000", "c": "l_discount * 100", "d": "l_quantity * l_quantity / 50 + l_tax * 100"}
_XSQL = f"(SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in _X.items())} FROM lineitem)"
_GAP = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE {} END"
_NAMES = list(_X)
_P = {"x": "p_size::DOUBLE", "y": "p_retailprice", "z": "(p_size * p_size - 20 * p_size + p_partkey % 7)::DOUBLE"}
_PSQL = f"(SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _P.items())} FROM part)"


def frame(spark, d):
    return line(spark, d).selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _X.items()])


def small(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "double(p_size) AS x", "p_retailprice AS y",
                                              "double(p_size * p_size - 20 * p_size + p_partkey % 7) AS z")


def pairs_sql(names, expr, src, digits=6):
    return union_sql([f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(expr.format(a=a, b=b), digits)} AS value FROM {src}"
                      for a, b in combinations(names, 2)])


def _out(df, digits=6):
    return df.select("col_a", "col_b", rd("value", digits).alias("value"))


@query("r01_pearson", pairs_sql(_NAMES, "corr({a}, {b})", _XSQL))
def _(spark, d):
    return _out(A.pearson(frame(spark, d), _NAMES))


@query("r01_pearson_pairwise", union_sql([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})')} AS value FROM (SELECT a, {_GAP.format('b')} AS b, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE d END AS d FROM {_XSQL})"
    for a, b in combinations("abd", 2)]))
def _(spark, d):
    df = frame(spark, d).selectExpr("a", f"{_GAP.format('b')} AS b", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE d END AS d")
    return _out(A.pearson(df))


def _ranks(names, src):
    return "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS {n}" for n in names) + f" FROM {src})"


@query("r02_spearman", pairs_sql(_NAMES, "corr({a}, {b})", _ranks(_NAMES, _XSQL)))
def _(spark, d):
    return _out(A.spearman(frame(spark, d), _NAMES))


@query("r02_spearman_pairwise", f"SELECT 'a' AS col_a, 'b' AS col_b, {R('corr(a, b)')} AS value FROM {_ranks('ab', f'(SELECT a, b FROM {_XSQL} WHERE l_orderkey % 7 <> 0)')}")
def _(spark, d):
    return _out(A.spearman(frame(spark, d).selectExpr("a", f"{_GAP.format('b')} AS b")))


def _kendall_sql(names, src):
    return union_sql([f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f"sum(sign(p.{a} - r.{a}) * sign(p.{b} - r.{b}))::DOUBLE / sqrt(sum((p.{a} <> r.{a})::INT)::DOUBLE * sum((p.{b} <> r.{b})::INT)::DOUBLE)")} AS value
 FROM {src} p, {src} r""" for a, b in combinations(names, 2)])


@query("r03_kendall", _kendall_sql("xyz", _PSQL))
def _(spark, d):
    return _out(A.kendall(small(spark, d), list("xyz")))


@query("r04_mic")
def _(spark, d):
    return _out(A.mic(frame(spark, d), _NAMES))


def codes_sql(names, src, bins, keep=""):
    """Equal-frequency codes, repeated edges dropped, right-closed."""
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    ends = ", ".join(f"quantile_cont({n}, [{probs}]) AS e_{n}, min({n}) AS mn_{n}" for n in names)
    cols = ", ".join(f"CASE WHEN {n} IS NULL THEN NULL ELSE len(list_distinct(list_filter(e_{n}, lambda edge_: edge_ > mn_{n} AND edge_ < {n}))) END AS {n}" for n in names)
    return f"(SELECT {keep + ', ' if keep else ''}{cols} FROM {src}, (SELECT {ends} FROM {src}))"


def mi_sql(a, b, src, log="ln"):
    return f"""(SELECT sum(n / t * {log}(n * t / (na * nb))) FROM (SELECT n::DOUBLE AS n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY {a}) AS na,
 sum(n) OVER (PARTITION BY {b}) AS nb FROM (SELECT {a}, {b}, count(*)::DOUBLE AS n FROM {src} GROUP BY 1, 2)))"""


@query("r04_mic_one_grid", "WITH k AS MATERIALIZED (SELECT * FROM " + codes_sql("abd", _XSQL, 2) + ") " + union_sql([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f"least(1, {mi_sql(a, b, 'k', 'log2')})")} AS value" for a, b in combinations("abd", 2)]))
def _(spark, d):
    return _out(A.mic(frame(spark, d), ["a", "b", "d"], cap=4))


def _dist_sql(a, b):
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, (WITH e AS (SELECT i.p_partkey AS i, abs(i.{a} - j.{a}) AS u, abs(i.{b} - j.{b}) AS v FROM {_PSQL} i, {_PSQL} j),
 r AS (SELECT i, avg(u) AS mu, avg(v) AS mv, sum(u * v) AS uv, sum(u * u) AS uu, sum(v * v) AS vv, count(*) AS n FROM e GROUP BY i),
 s AS (SELECT sum(uv) / sum(n) - 2 * avg(mu * mv) + avg(mu) * avg(mv) AS c, sum(uu) / sum(n) - 2 * avg(mu * mu) + avg(mu) * avg(mu) AS x,
 sum(vv) / sum(n) - 2 * avg(mv * mv) + avg(mv) * avg(mv) AS y FROM r) SELECT {R('sqrt(c / sqrt(x * y))', 5)} FROM s) AS value"""


@query("r05_distance_correlation", union_sql([_dist_sql(a, b) for a, b in combinations("xyz", 2)]))
def _(spark, d):
    return _out(A.distance_correlation(small(spark, d), list("xyz")), 5)


def _hoeff_sql(a, b):
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, (WITH r AS (SELECT p_partkey, {a}, {b}, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS r,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS s FROM {_PSQL}),
 k AS (SELECT i.p_partkey, count(*)::DOUBLE AS c FROM {_PSQL} i JOIN {_PSQL} j ON j.{a} < i.{a} AND j.{b} < i.{b} GROUP BY 1),
 t AS (SELECT count(*)::DOUBLE AS n, sum(coalesce(c, 0) * (coalesce(c, 0) - 1)) AS d1, sum((r - 1) * (r - 2) * (s - 1) * (s - 2)) AS d2, sum((r - 2) * (s - 2) * coalesce(c, 0)) AS d3 FROM r LEFT JOIN k USING (p_partkey))
 SELECT {R('greatest(-0.5, least(1, 30 * ((n - 2) * (n - 3) * d1 + d2 - 2 * (n - 2) * d3) / (n * (n - 1) * (n - 2) * (n - 3) * (n - 4))))', 5)} FROM t) AS value"""


@query("r06_hoeffding", union_sql([_hoeff_sql(a, b) for a, b in combinations("xyz", 2)]))
def _(spark, d):
    return _out(A.hoeffding(small(spark, d), list("xyz")), 5)


_O = "(SELECT o_orderkey, o_totalprice AS t, o_custkey::DOUBLE AS c, (o_custkey % 100)::DOUBLE AS m FROM orders)"


@query("r07_chatterjee", union_sql([
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {R('1 - 3 * sum(abs(s)) / (max(n) * max(n) - 1.0)')} AS value FROM (SELECT r - lag(r) OVER (ORDER BY {a}, o_orderkey) AS s, count(*) OVER () AS n
 FROM (SELECT o_orderkey, {a}, (rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0)::DOUBLE AS r FROM {_O}))""" for a, b in combinations("tcm", 2)]))
def _(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice AS t", "double(o_custkey) AS c", "double(o_custkey % 100) AS m")
    return _out(A.chatterjee(df, ["t", "c", "m"], "o_orderkey"))


@query("r08_polychoric")
def _(spark, d):
    return _out(A.polychoric(frame(spark, d), ["a", "b", "d"]), 4)


@query("r09_blomqvist", f"WITH m AS (SELECT {', '.join(f'sign({n} - (SELECT quantile_cont({n}, 0.5) FROM {_XSQL})) AS {n}' for n in _NAMES)} FROM {_XSQL}) "
       + union_sql([f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'avg({a} * {b})')} AS value FROM m WHERE {a} <> 0 AND {b} <> 0" for a, b in combinations(_NAMES, 2)]))
def _(spark, d):
    return _out(A.blomqvist(frame(spark, d), _NAMES))


@query("r10_hsic_linear", pairs_sql(_NAMES, "corr({a}, {b}) ** 2", _XSQL))
def _(spark, d):
    return _out(A.hsic_linear(frame(spark, d), _NAMES))


@query("r11_hsic_rbf")
def _(spark, d):
    return _out(A.hsic_rbf(frame(spark, d), ["a", "b", "d"], ["l_orderkey", "l_linenumber"]), 4)


@query("r11_median_distance", union_sql([
    f"SELECT '{x}' AS feature, {R('median((p.v - r.v) ** 2)', 6)} AS value FROM (SELECT {x} AS v FROM {_PSQL}) p JOIN (SELECT {x} AS v FROM {_PSQL}) r ON p.v < r.v" for x in "xyz"]))
def _(spark, d):
    got = A.median_distances(small(spark, d), list("xyz"))
    return rounded(rows_frame(spark, list(got.items()), "feature string, value double"), ["value"])


@query("r12_mutual_information", "WITH k AS MATERIALIZED (SELECT * FROM " + codes_sql(_NAMES, _XSQL, 10) + ") " + union_sql([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(mi_sql(a, b, 'k'))} AS value" for a, b in combinations(_NAMES, 2)]))
def _(spark, d):
    return _out(A.mutual_information(frame(spark, d), _NAMES))


#: digamma of whole numbers, as a table
PSI = "psi AS (SELECT i, -0.57721566490153286 + coalesce(sum(CASE WHEN i > 1 THEN 1.0::DOUBLE / (i - 1) END) OVER (ORDER BY i), 0) AS p FROM range(1, (SELECT count(*) + 2 FROM f)) t(i))"


@query("r12_mutual_information_knn", f"""WITH f AS MATERIALIZED (SELECT p_partkey AS i, y / (SELECT stddev_pop(y) FROM {_PSQL}) AS u, z / (SELECT stddev_pop(z) FROM {_PSQL}) AS v FROM {_PSQL}),
e AS (SELECT a.i, greatest(abs(a.u - b.u), abs(a.v - b.v)) AS eps FROM f a JOIN f b ON a.i <> b.i QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY eps) = 3),
c AS (SELECT a.i, sum((abs(a.u - b.u) <= eps * (1 - 1e-9))::INT) AS cu, sum((abs(a.v - b.v) <= eps * (1 - 1e-9))::INT) AS cv FROM f a JOIN e ON a.i = e.i, f b GROUP BY a.i), {PSI},
r AS (SELECT (SELECT p FROM psi WHERE i = (SELECT count(*) FROM f)) + (SELECT p FROM psi WHERE i = 3) - avg(pu.p) - avg(pv.p) AS v FROM c JOIN psi pu ON pu.i = cu JOIN psi pv ON pv.i = cv)
SELECT 'y' AS col_a, 'z' AS col_b, {R('greatest(v, 0)', 4)} AS value FROM r""")
def _(spark, d):
    return _out(A.mutual_information(small(spark, d), ["y", "z"], estimator="knn", k=3), 4)


def _partial(a, b, c):
    return f"(corr({a}, {b}) - corr({a}, {c}) * corr({b}, {c})) / sqrt((1 - corr({a}, {c}) ** 2) * (1 - corr({b}, {c}) ** 2))"


@query("r13_partial_correlation", union_sql([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(_partial(a, b, c))} AS value FROM {_XSQL}" for a, b, c in (("a", "b", "d"), ("a", "d", "b"), ("b", "d", "a"))]))
def _(spark, d):
    return _out(A.partial_correlation(frame(spark, d), ["a", "b", "d"]))


@query("r14_sparse_partial_correlation")
def _(spark, d):
    return _out(A.sparse_partial_correlation(frame(spark, d), _NAMES, ["l_orderkey", "l_linenumber"]), 4)


@query("r15_cross_set", union_sql([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'abs(corr({a}, {b}))' if (a in 'ab') != (b in 'ab') else f'corr({a}, {b})')} AS value FROM {_XSQL}"
    for a, b in combinations(_NAMES, 2)]))
def _(spark, d):
    return _out(A.cross_set_correlation(frame(spark, d), _NAMES))


_E = "(SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value AS u, value * 0.5 + coalesce(lag(value, 3) OVER (ORDER BY ts, event_id), 0) AS v FROM events)"


def series(spark, d):
    """Two event series, the second following the first by three steps."""
    ev = table(spark, d, "events").select("event_id", "ts", "value")
    idx = dense_index(ev, ["ts", "event_id"], "i")
    out = with_lags(idx, "i", {"back": ("value", 3)})
    return out.selectExpr("event_id", "i", "value AS u", "value * 0.5 + coalesce(back, 0) AS v")


@query("r16_cross_correlation", f"""WITH s AS (SELECT i, u - avg(u) OVER () AS u, v - avg(v) OVER () AS v, stddev_pop(u) OVER () * stddev_pop(v) OVER () * count(*) OVER () AS z FROM {_E})
SELECT (x.i - y.i)::INT AS lag, {R('sum(x.u * y.v) / max(x.z)')} AS value FROM s x JOIN s y ON x.i - y.i BETWEEN -40 AND 40 GROUP BY 1""")
def _(spark, d):
    return rounded(A.cross_correlation(series(spark, d), "u", "v", ["i"]), ["value"])


_LAGS = f"(SELECT i, u, v, lag(u) OVER (ORDER BY i) AS u1, lag(v) OVER (ORDER BY i) AS v1 FROM {_E})"


@query("r17_granger_lag_one", f"""WITH l AS (SELECT * FROM {_LAGS} WHERE i >= 1), r AS (SELECT 'u' AS col_a, 'v' AS col_b, corr(v, v1) AS ab, corr(v, u1) AS ac, corr(v1, u1) AS bc, var_pop(v) * count(*) AS t FROM l
UNION ALL SELECT 'v', 'u', corr(u, u1), corr(u, v1), corr(u1, v1), var_pop(u) * count(*) FROM l)
SELECT col_a, col_b, {R('t * (1 - ab * ab)', 2)} AS rss_own, {R('t * (1 - (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc))', 2)} AS rss_both FROM r""")
def _(spark, d):
    got = A.granger(series(spark, d), ["u", "v"], ["i"], 1)
    return rounded(got.select("col_a", "col_b", "rss_own", "rss_both"), ["rss_own", "rss_both"], 2)


@query("r17_granger_matrix")
def _(spark, d):
    return _out(A.granger_matrix(series(spark, d), ["u", "v"], ["i"]))


_TE = "(SELECT i, u, v FROM " + codes_sql("uv", _E, 4, "i") + ")"


@query("r18_transfer_entropy", f"WITH k AS MATERIALIZED (SELECT * FROM {_TE}), l AS (SELECT i, u, v, lag(u) OVER (ORDER BY i) AS u0, lag(v) OVER (ORDER BY i) AS v0 FROM k) " + union_sql([
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {R('sum(m / n * log2(m * my / (myx * myy)))')} AS value FROM (SELECT m, sum(m) OVER () AS n, sum(m) OVER (PARTITION BY y0, x0) AS myx, sum(m) OVER (PARTITION BY y1, y0) AS myy, sum(m) OVER (PARTITION BY y0) AS my
 FROM (SELECT {b} AS y1, {b}0 AS y0, {a}0 AS x0, count(*)::DOUBLE AS m FROM l WHERE i > 0 GROUP BY 1, 2, 3))""" for a, b in permutations("uv", 2)]))
def _(spark, d):
    return _out(A.transfer_entropy(series(spark, d), ["u", "v"], ["i"]))


@query("r19_bayesian_network")
def _(spark, d):
    return A.bayesian_network(frame(spark, d), _NAMES)


@query("r20_target_information", "WITH k AS MATERIALIZED (SELECT * FROM " + codes_sql(_NAMES, f"(SELECT x.*, l_returnflag FROM (SELECT l_returnflag, {', '.join(f'{e} AS {n}' for n, e in _X.items())} FROM lineitem) x)", 10, "l_returnflag") + ") " + union_sql([
    f"SELECT '{a}' AS feature, {R(mi_sql(a, 'l_returnflag', 'k'), 8)} AS score" for a in _NAMES]))
def _(spark, d):
    df = line(spark, d).selectExpr("l_returnflag", *[f"{e} AS {n}" for n, e in _X.items()])
    return rounded(A.target_information(df, "l_returnflag", _NAMES), ["score"], 8)


@query("r21_lasso_one_feature", f"SELECT 'a' AS feature, {R('sign(corr(a, d)) * greatest(abs(corr(a, d)) - 0.1, 0)')} AS coefficient FROM {_XSQL}")
def _(spark, d):
    return rounded(A.lasso_coefficients(frame(spark, d), "d", ["a"]).select("feature", "coefficient"), ["coefficient"])


@query("r21_lasso_cv")
def _(spark, d):
    return rounded(A.lasso_coefficients(frame(spark, d), "d", _NAMES, 0.0, ["l_orderkey", "l_linenumber"]), ["coefficient", "alpha"], 4)


_R1 = f"(SELECT * FROM ({pairs_sql(_NAMES, 'corr({a}, {b})', _XSQL)}))"


@query("r22_threshold_graph", f"SELECT CASE WHEN value > 0 THEN col_a ELSE col_b END AS src, CASE WHEN value > 0 THEN col_b ELSE col_a END AS dst, value AS weight FROM {_R1} WHERE abs(value) > 0.3")
def _(spark, d):
    return rounded(A.threshold_graph(A.pearson(frame(spark, d), _NAMES), _NAMES), ["weight"])


@query("r23_strong_pairs", f"SELECT * FROM {_R1} WHERE abs(value) > 0.5")
def _(spark, d):
    return _out(A.strong_pairs(A.pearson(frame(spark, d), _NAMES)))


@query("r24_column_map")
def _(spark, d):
    return rounded(A.column_map(A.pearson(frame(spark, d), _NAMES), _NAMES), ["pc1", "pc2"])

