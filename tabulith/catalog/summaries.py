"""Queries: joins, groups, windows, plot summaries, symbolic features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.columns import rows_frame
from ..functions.folds import mod_fold
from ..functions.ordering import dense_index, fill_edges, with_lags, with_ranks
from ..operators import association as A
from ..operators import conditioning as E
from ..operators import descriptors as D
from ..operators import relational as Rel
from ..operators import summaries as S
from ..operators import tidy
from .association import pairs_sql
from .base import R, query, rd, rounded, table, union_sql
from .tables import line

# ---- relational --------------------------------------------------------------


@query("j1_inner_join", "SELECT o_orderkey, o_custkey, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    items = line(spark, d).selectExpr("l_orderkey AS o_orderkey", "l_linenumber", "l_quantity")
    return Rel.join_tables(o, items, "o_orderkey")


@query("j2_keys_only_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(spark, d):
    return tidy.keys_only_in(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 450000").selectExpr("o_custkey AS c_custkey"), "c_custkey")


@query("j3_same_row_columns", f"SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS sq, {R('l_tax + l_discount')} AS total FROM lineitem")
def _(spark, d):
    df = line(spark, d).withColumns({"sq": F.col("l_quantity") * F.col("l_quantity"), "total": rd(F.col("l_tax") + F.col("l_discount"))})
    return df.select("l_orderkey", "l_linenumber", "sq", "total")


@query("j4_restore_membership", "SELECT p_partkey, p_size FROM part WHERE p_size <= 30 OR p_brand = 'Brand#4'")
def _(spark, d):
    p = table(spark, d, "part")
    return tidy.restore(p.filter("p_size <= 30"), p, p.filter("p_brand = 'Brand#4'"), "p_partkey").select("p_partkey", "p_size")


_G = """SELECT event_type, count(value) AS n, {est} AS estimate, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(value)) AS se FROM events GROUP BY 1"""
for _name, _sql in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)"), ("sum", "sum(value)"), ("count", "count(value)::DOUBLE")):
    @query(f"g1_grouped_{_name}", f"SELECT event_type, n, {R('estimate', 4)} AS estimate, {R('sd', 4)} AS sd, {R('se', 4)} AS se, "
           f"{R('estimate - 1.959963984540054 * se', 4)} AS low, {R('estimate + 1.959963984540054 * se', 4)} AS high FROM ({_G.format(est=_sql)})")
    def _(spark, d, name=_name):
        out = Rel.grouped(table(spark, d, "events"), "event_type", "value", name)
        return rounded(out, ["estimate", "sd", "se", "low", "high"], 4)


@query("g1_bootstrap_median", f"""WITH c AS (SELECT event_type AS g, value AS v, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT g, v, sum(c) OVER (PARTITION BY g ORDER BY v) AS upto, sum(c) OVER (PARTITION BY g) AS n FROM c),
z AS (SELECT *, (upto - n / 2) / sqrt(greatest(upto * (1 - upto / n), 1e-12)) AS z FROM r),
e AS (SELECT g, any_value(n)::BIGINT AS n, min(v) FILTER (z >= -1.959963984540054) AS low, min(v) FILTER (z >= 1.959963984540054) AS high FROM z GROUP BY g)
SELECT event_type, any_value(n) AS n, {R('quantile_cont(value, 0.5)', 4)} AS estimate, {R('any_value(low)', 4)} AS low, {R('any_value(high)', 4)} AS high
FROM events JOIN e ON g = event_type GROUP BY event_type""")
def _(spark, d):
    return rounded(Rel.bootstrap(table(spark, d, "events"), "event_type", "value", ["event_id"], "median"), ["estimate", "low", "high"], 4)


@query("g1_bootstrap_mean")
def _(spark, d):
    return rounded(Rel.bootstrap(table(spark, d, "events"), "event_type", "value", ["event_id"]), ["estimate", "low", "high"], 4)


@query("g2_value_counts", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    return Rel.value_counts(table(spark, d, "part"), "p_brand")


@query("w1_centred_mean", f"SELECT event_id, {R('avg(value) OVER (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)')} AS rolling FROM events")
def _(spark, d):
    out = Rel.rolling_mean(table(spark, d, "events").select("event_id", "value"), "value", ["event_id"], 10)
    return out.select("event_id", rd("rolling").alias("rolling"))


_MA = ", ".join(f"CASE WHEN count(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS {k - 1} PRECEDING) = {k} THEN "
                f"round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS {k - 1} PRECEDING), 6) END AS ma_{k}" for k in (5, 20, 50))


@query("w2_moving_averages", f"SELECT event_id, user_id, {_MA} FROM events")
def _(spark, d):
    out = Rel.moving_averages(table(spark, d, "events").select("event_id", "user_id", "value"), "value", ["event_id"], partition_by=["user_id"])
    return rounded(out.select("event_id", "user_id", "ma_5", "ma_20", "ma_50"), ["ma_5", "ma_20", "ma_50"])


@query("w3_percent_rank", f"SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS r FROM orders")
def _(spark, d):

    return with_ranks(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], {"o_totalprice": "r"}).select("o_orderkey", "r")


@query("w4_lags", "SELECT event_id, lag(value, 1) OVER (ORDER BY event_id) AS lag1, lag(value, 4) OVER (ORDER BY event_id) AS lag4 FROM events")
def _(spark, d):

    idx = dense_index(table(spark, d, "events").select("event_id", "value"), ["event_id"], "i")
    return with_lags(idx, "i", {"lag1": ("value", 1), "lag4": ("value", 4)}).select("event_id", "lag1", "lag4")


@query("w5_fill_propagation", """SELECT event_id, last_value(CASE WHEN event_id % 10 < 3 THEN NULL ELSE value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events""")
def _(spark, d):

    ev = table(spark, d, "events").select("event_id", "user_id", "value")
    return fill_edges(ev, ["event_id"], {"v": F.expr("CASE WHEN event_id % 10 < 3 THEN NULL ELSE value END")}, True, ["user_id"]).select("event_id", "v")


_BAL = "(SELECT c_mktsegment AS feature, avg(c_acctbal) - 4500 AS score FROM customer GROUP BY 1)"


def _balances(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("feature")).agg((F.avg("c_acctbal") - 4500).alias("score"))


@query("x_sort_by_size", f"SELECT feature, {R('score', 4)} AS score FROM {_BAL}")
def _(spark, d):
    return rounded(Rel.sort_by_score(_balances(spark, d), "score", "feature", absolute=True), ["score"], 4)


@query("x_top_n", f"SELECT feature, {R('score', 4)} AS score FROM {_BAL} ORDER BY abs(score) DESC, feature LIMIT 2")
def _(spark, d):
    return rounded(Rel.top_n(_balances(spark, d), "score", 2, "feature", absolute=True), ["score"], 4)


@query("x_union_of_sets", "SELECT DISTINCT l_returnflag AS feature FROM lineitem UNION SELECT o_orderstatus FROM orders")
def _(spark, d):
    return Rel.feature_union([line(spark, d).selectExpr("l_returnflag AS feature"), table(spark, d, "orders").selectExpr("o_orderstatus AS feature")])


@query("x_intersection_of_sets", "SELECT c_nationkey AS feature FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return Rel.feature_intersection([table(spark, d, "customer").selectExpr("c_nationkey AS feature"), table(spark, d, "supplier").selectExpr("s_nationkey AS feature")])


# ---- plot summaries -------------------------------------------------------------

def _hist(x, src, bins):
    return f"(SELECT least(floor(({x} - a) / ((b - a) / {bins})), {bins - 1})::INT AS bin, count(*) AS n FROM {src}, (SELECT min({x}) AS a, max({x}) AS b FROM {src}) GROUP BY 1)"


@query("v01_histogram", f"""SELECT g.bin::INT AS bin, {R('a + g.bin * (b - a) / 30', 4)} AS lo, {R('a + (g.bin + 1) * (b - a) / 30', 4)} AS hi, coalesce(n, 0) AS n,
 {R('coalesce(n, 0) / (t * (b - a) / 30)', 10)} AS density, (sum(coalesce(n, 0)) OVER (ORDER BY g.bin))::BIGINT AS cumulative
FROM (SELECT unnest(range(30)) AS bin) g LEFT JOIN {_hist('l_extendedprice', 'lineitem', 30)} h USING (bin), (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, count(*) AS t FROM lineitem)""")
def _(spark, d):
    return rounded(rounded(S.histogram(line(spark, d), "l_extendedprice"), ["lo", "hi"], 4), ["density"], 10)


def _box_sql(c):
    return f"""SELECT '{c}' AS "column", {R('max(q1)', 4)} AS q1, {R('max(m)', 4)} AS median, {R('max(q3)', 4)} AS q3, {R(f'min(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) THEN {c} END)', 4)} AS whisker_lo,
 {R(f'max(CASE WHEN {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END)', 4)} AS whisker_hi, count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS fliers, {R(f'avg({c})', 4)} AS mean
 FROM customer, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS q3 FROM customer)"""


@query("v02_box", union_sql([_box_sql("c_acctbal")]))
def _(spark, d):
    return rounded(S.box(table(spark, d, "customer"), ["c_acctbal"]), ["q1", "median", "q3", "whisker_lo", "whisker_hi", "mean"], 4)


def _kde_sql(x, src, n):
    return f"""(SELECT i, a + i * (b - a) / {n - 1} AS x, sum(exp(-0.5 * ((a + i * (b - a) / {n - 1} - {x}) / h) ** 2)) / max(t * h * sqrt(2 * pi())) AS density
 FROM {src}, (SELECT unnest(range({n})) AS i), (SELECT min({x}) AS a, max({x}) AS b, count({x}) AS t, stddev_samp({x}) * count({x}) ** (-0.2::DOUBLE) AS h FROM {src}) GROUP BY i, a, b)"""


@query("v03_violin", f"""SELECT k.i::INT AS i, {R('k.x', 4)} AS x, {R('k.density', 9)} AS density, b.q1, b.median, b.q3 FROM {_kde_sql('c_acctbal', 'customer', 100)} k, ({_box_sql('c_acctbal')}) b""")
def _(spark, d):
    out = S.violin(table(spark, d, "customer"), "c_acctbal").select("i", "x", "density", "q1", "median", "q3")
    return rounded(rounded(out, ["x", "q1", "median", "q3"], 4), ["density"], 9)


@query("v04_density", f"SELECT i::INT AS i, {R('x', 4)} AS x, {R('density', 6)} AS density FROM {_kde_sql('l_quantity', 'lineitem', 300)}")
def _(spark, d):
    return rounded(rounded(S.density(line(spark, d), "l_quantity"), ["x"], 4), ["density"], 6)


@query("v05_line_fit", f"SELECT 0 AS power, {R('regr_intercept(p_retailprice, p_partkey)', 4)} AS coefficient FROM part UNION ALL SELECT 1, {R('regr_slope(p_retailprice, p_partkey)', 4)} FROM part")
def _(spark, d):
    return rounded(S.polynomial_fit(table(spark, d, "part"), "p_partkey", "p_retailprice")[0], ["coefficient"], 4)


@query("v05_cubic_band")
def _(spark, d):
    return rounded(S.polynomial_fit(table(spark, d, "part"), "p_size", "p_retailprice", 3)[1], ["x", "y", "low", "high"], 4)


_B2 = """(SELECT least(floor((l_extendedprice - a) / ((b - a) / 30)), 29)::INT AS bx, least(floor((l_quantity - c) / ((e - c) / 30)), 29)::INT AS "by", count(*) AS n FROM lineitem,
 (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_quantity) AS c, max(l_quantity) AS e FROM lineitem) GROUP BY 1, 2)"""


@query("v06_joint", f"""WITH c AS (SELECT * FROM {_B2}) SELECT 'xy' AS kind, bx, "by", n FROM c UNION ALL SELECT 'x', bx, NULL, sum(n)::BIGINT FROM c GROUP BY bx UNION ALL SELECT 'y', NULL, "by", sum(n)::BIGINT FROM c GROUP BY "by" """)
def _(spark, d):
    return S.joint(line(spark, d), "l_extendedprice", "l_quantity")


_PG = ["l_quantity", "l_discount", "l_tax"]
_BIN = {c: f"least(floor(({c} - a_{c}) / ((b_{c} - a_{c}) / 20)), 19)::INT" for c in _PG}
_PGE = "(SELECT " + ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in _PG) + " FROM lineitem)"


@query("v07_pair_grid", union_sql([f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_BIN[a]} AS ba, {_BIN[b]} AS bb, count(*) AS n FROM lineitem, {_PGE} GROUP BY 3, 4"
                                   for a, b in [*((c, c) for c in _PG), *combinations(_PG, 2)]]))
def _(spark, d):
    return S.pair_grid(line(spark, d), _PG)


@query("v08_heatmap", "WITH m AS (" + pairs_sql(_PG, "corr({a}, {b})", "lineitem") + ") SELECT * FROM m UNION ALL SELECT col_b, col_a, value FROM m UNION ALL " + union_sql(
    [f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in _PG]))
def _(spark, d):
    return A.symmetric(A.pearson(line(spark, d), _PG).withColumn("value", rd("value")), _PG)


@query("v09_parallel_coordinates", union_sql([f"SELECT l_orderkey, l_linenumber, {i} AS axis, '{c}' AS \"column\", {R(f'({c} - a_{c}) / (b_{c} - a_{c} + 1e-12)')} AS value FROM lineitem, {_PGE}"
                                              for i, c in enumerate(_PG)]))
def _(spark, d):
    return rounded(S.parallel_coordinates(line(spark, d), _PG, ["l_orderkey", "l_linenumber"]), ["value"])


@query("v09_parallel_standard", union_sql([f"SELECT l_orderkey, l_linenumber, {i} AS axis, '{c}' AS \"column\", {R(f'({c} - m) / (s + 1e-12)')} AS value FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)"
                                           for i, c in enumerate(_PG)]))
def _(spark, d):
    return rounded(S.parallel_coordinates(line(spark, d), _PG, ["l_orderkey", "l_linenumber"], "standard"), ["value"])


@query("v10_smoothed_line", f"SELECT event_id, {R('avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS rolling FROM events")
def _(spark, d):
    out = Rel.rolling_mean(table(spark, d, "events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], 7)
    return out.select("event_id", rd("rolling").alias("rolling"))


@query("v11_stacked_area", f"SELECT l_orderkey, l_linenumber, {R('l_tax')} AS top_l_tax, {R('l_tax + coalesce(CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END, 0)')} AS top_disc FROM lineitem")
def _(spark, d):
    df = line(spark, d).withColumn("disc", F.expr("CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END"))
    return rounded(S.stacked_area(df, ["l_tax", "disc"], ["l_orderkey", "l_linenumber"]), ["top_l_tax", "top_disc"])


_OHLC = "SELECT event_id, value AS o, value + 1 AS h, value - 1 AS l, (event_id * 37 % 100)::DOUBLE AS c FROM events"


@query("v12_candles", f"""WITH t AS (SELECT * FROM ({_OHLC}) ORDER BY event_id DESC LIMIT 300) SELECT *, c >= o AS up, """ + ", ".join(
    f"CASE WHEN count(*) OVER (ORDER BY event_id ROWS {k - 1} PRECEDING) = {k} THEN round(avg(c) OVER (ORDER BY event_id ROWS {k - 1} PRECEDING), 6) END AS ma_{k}" for k in (5, 20, 50)) + " FROM t")
def _(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", "value AS o", "value + 1 AS h", "value - 1 AS l", "double(event_id * 37 % 100) AS c")
    return rounded(S.candles(df, ["event_id"], "o", "h", "l", "c"), ["ma_5", "ma_20", "ma_50"])


@query("v13_bars", f"SELECT l_returnflag, count(*) AS n, {R('avg(l_quantity)', 5)} AS estimate, {R('stddev_samp(l_quantity)', 5)} AS sd FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(Rel.grouped(line(spark, d), "l_returnflag", "l_quantity"), ["estimate", "sd"], 5).select("l_returnflag", "n", "estimate", "sd")


@query("v14_point_sample")
def _(spark, d):
    return S.point_sample(line(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], 0.1)


@query("v15_pca_variance", f"""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT 1 AS component, {R('(1 + abs(r)) / 2')} AS ratio FROM c UNION ALL SELECT 2, {R('(1 - abs(r)) / 2')} FROM c""")
def _(spark, d):
    return rounded(S.pca(line(spark, d), ["l_quantity", "l_extendedprice"])[1].select("component", "ratio"), ["ratio"])


@query("v15_pca_scores")
def _(spark, d):
    out = S.pca(line(spark, d), ["l_quantity", "l_extendedprice", "l_tax", "l_discount"])[0]
    return out.select("l_orderkey", "l_linenumber", rd("pc1", 4).alias("pc1"), rd("pc2", 4).alias("pc2"))


@query("v16_variant_density")
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    c = E.condition(df, ["c_acctbal"], [E.Bound("c_acctbal", -1000.0, 10000.0)])
    return rounded(S.variant_density(df, c.stacked(), "c_acctbal", c.best), ["x", "density"], 8)


# ---- symbolic features --------------------------------------------------------------
_BASE = {"a": "l_quantity / 10", "b": "l_discount * 10 - 0.3"}
_DSQL = f"(SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in _BASE.items())}, l_extendedprice / 1000 + l_quantity * l_quantity / 50 AS y FROM lineitem)"


def base(spark, d):
    return line(spark, d).selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _BASE.items()], "l_extendedprice / 1000 + l_quantity * l_quantity / 50 AS y")


_U = {"sq": "x * x", "cb": "x * x * x", "inv": "1 / (x + 1e-6)", "abs": "abs(x)", "sqrt": "sqrt(abs(x))", "cbrt": "cbrt(abs(x))", "log": "ln(abs(x) + 1e-6)", "exp": "exp(x)"}
_BI = {"add": "a + b", "sub": "a - b", "mul": "a * b", "div": "a / (b + 1e-6)", "abs_diff": "abs(a - b)", "harmonic_mean": "2 / (1 / (a + 1e-6) + 1 / (b + 1e-6))"}


def _swap(e):
    return e.replace("a", "#").replace("b", "a").replace("#", "b") if "abs" not in e else e


@query("d1_formula", f"SELECT l_orderkey, l_linenumber, {R('CASE WHEN b = 0 THEN NULL ELSE a / b END', 3)} AS f FROM (SELECT l_orderkey, l_linenumber, a, round(b + 0.3, 6) AS b FROM {_DSQL})")
def _(spark, d):
    df = base(spark, d).withColumn("b", F.round(F.col("b") + 0.3, 6))
    return D.evaluate_formula(df, "f", "try_divide(a, b)").select("l_orderkey", "l_linenumber", rd("f", 3).alias("f"))


@query("d2_unary_features", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{R(e.replace('x', n).replace('e' + n + 'p', 'exp'), 2)} AS \"{k}({n})\"" for k, e in _U.items() for n in "ab") + f" FROM {_DSQL}")
def _(spark, d):
    space = D.generate(base(spark, d), ["a", "b"], list(_U))
    out = D.evaluate(base(spark, d), space, ["l_orderkey", "l_linenumber"]).drop("a", "b")
    return rounded(out, [c for c in out.columns if "(" in c], 2)


@query("d3_binary_features", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    [f"{R(e, 3)} AS \"a {k} b\"" for k, e in _BI.items()] + [f"{R('b - a', 3)} AS \"b sub a\"", f"{R('b / (a + 1e-6)', 3)} AS \"b div a\""]) + f" FROM {_DSQL}")
def _(spark, d):
    space = D.generate(base(spark, d), ["a", "b"], binary=list(_BI))
    out = D.evaluate(base(spark, d), space, ["l_orderkey", "l_linenumber"]).drop("a", "b")
    return rounded(out, [c for c in out.columns if " " in c], 3)


@query("d4_capped_space")
def _(spark, d):
    space = D.generate(base(spark, d), ["a", "b"], list(_U), list(_BI), binary_cap=10, total_cap=300)
    return rows_frame(spark, [(n, s, space.capped) for n, s in space.short.items()], "feature string, short string, capped boolean")


def _space(df):
    return D.generate(df, ["a", "b"], ["sq", "sqrt", "exp"], ["mul", "add"], binary_cap=4)


_F = {"a": "a", "b": "b", "sq(a)": "a * a", "sq(b)": "b * b", "sqrt(a)": "sqrt(abs(a))", "sqrt(b)": "sqrt(abs(b))", "exp(a)": "exp(a)", "exp(b)": "exp(b)"}
_F4 = list(_F.items())[:4]
_F.update({f"{n} {k} {m}": f"({e}) {s} ({g})" for k, s in (("mul", "*"), ("add", "+")) for (n, e), (m, g) in combinations(_F4, 2)})


@query("d5_preselect", f"SELECT feature, {R('r2')} AS r2 FROM (" + union_sql([f"SELECT '{n}' AS feature, corr({e}, y) ** 2 AS r2 FROM {_DSQL}" for n, e in _F.items()]) + ") ORDER BY r2 DESC, feature LIMIT 8")
def _(spark, d):
    df = base(spark, d)
    return rounded(D.preselect(df, "y", _space(df), 8), ["r2"])


def _screen_sql(n, e):
    return f"""SELECT '{n}' AS feature, avg(1 - rss / tss) AS s FROM (SELECT f, sum((y - i - k * x) ** 2) AS rss, var_pop(y) * count(*) AS tss FROM
 (SELECT l_orderkey % 5 AS f, {e} AS x, y FROM {_DSQL}) t JOIN (SELECT g.f AS f, regr_slope(y, x) AS k, regr_intercept(y, x) AS i FROM (SELECT l_orderkey % 5 AS f, {e} AS x, y FROM {_DSQL}) s
 JOIN (SELECT unnest(range(5)) AS f) g ON s.f <> g.f GROUP BY g.f) USING (f) GROUP BY f)"""


@query("d6_linear_screening", f"SELECT feature, {R('s')} AS cv_r2 FROM (" + union_sql([_screen_sql(n, e) for n, e in _F.items()]) + ") WHERE s >= 0.001")
def _(spark, d):
    df = base(spark, d)
    return rounded(D.screen(df, "y", _space(df), by=mod_fold("l_orderkey", 5), threshold=0.001), ["cv_r2"])


def _grams(spark, d):
    df = base(spark, d)
    return D.fold_grams(df, "y", _space(df), by=mod_fold("l_orderkey", 5))


@query("d7_lasso_cv")
def _(spark, d):
    return rounded(D.fit_elastic(*_with_target(spark, d)).frame(spark), ["coefficient", "r2_single", "rmse_single"], 4)


def _with_target(spark, d):
    folds, names = _grams(spark, d)
    return folds, "y", names


@query("d8_ridge_cv")
def _(spark, d):
    return rounded(D.fit_ridge(*_with_target(spark, d)).frame(spark), ["coefficient", "r2_single", "rmse_single"], 4)


@query("d9_elastic_net_cv")
def _(spark, d):
    return rounded(D.fit_elastic(*_with_target(spark, d), l1_ratio=0.5).frame(spark), ["coefficient", "r2_single", "rmse_single"], 4)


@query("d10_subset_score")
def _(spark, d):
    folds, _, names = _with_target(spark, d)
    return rounded(rows_frame(spark, [(",".join(s), D.subset_score(folds, "y", s)) for s in (names[:1], names[:3], names)], "subset string, score double"), ["score"])


@query("d11_greedy_forward")
def _(spark, d):
    df = base(spark, d)
    fit = D.search(df, "y", _space(df), "forward", by=mod_fold("l_orderkey", 5), max_features=5)
    return rounded(fit.frame(spark), ["coefficient", "r2_single", "rmse_single"], 4)


@query("d12_greedy_backward")
def _(spark, d):
    df = base(spark, d)
    fit = D.search(df, "y", _space(df), "backward", by=mod_fold("l_orderkey", 5), preselect_k=8)
    return rounded(fit.frame(spark), ["coefficient", "r2_single", "rmse_single"], 4)


@query("d13_refit_scores")
def _(spark, d):
    return rounded(D.score_rows(spark, D.fit_ridge(*_with_target(spark, d))), ["value"])
