"""Queries: feature ranking and models."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from ..functions.columns import rows_frame
from ..functions.folds import mod_fold
from ..operators import models as M
from ..operators import profile as P
from ..operators import ranking as K
from ..operators import summaries as S
from .association import PSI, _kendall_sql, _ranks, codes_sql, mi_sql
from .base import R, query, rd, rounded, table, union_sql
from .tables import line

FEATURES = ["a", "b", "c", "e"]
_Y = "2 * p_size + p_retailprice * p_retailprice / 500000 - p_partkey % 17 + ((p_partkey * 37) % 11) / 3e0"
_CLS2 = "CASE WHEN p_size + (p_partkey * 37) % 11 > 30 THEN 'hi' ELSE 'lo' END"
_CLS3 = "CASE WHEN p_size + (p_partkey * 37) % 11 > 38 THEN 'hi' WHEN p_size + (p_partkey * 37) % 11 > 18 THEN 'mid' ELSE 'lo' END"
_SQL = (f"(SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice / 100 AS b, (p_partkey % 17)::DOUBLE AS c, (p_partkey % 5)::DOUBLE AS e, "
        f"({_Y})::DOUBLE AS y, {_CLS2} AS cls2, {_CLS3} AS cls3 FROM part)")


def parts(spark, d, target):
    """Part sizes and prices with a number target and two class targets."""
    t = {"y": f"double({_Y}) AS y", "cls2": f"{_CLS2} AS cls2", "cls3": f"{_CLS3} AS cls3"}[target]
    return table(spark, d, "part").selectExpr("p_partkey", "double(p_size) AS a", "p_retailprice / 100 AS b", "double(p_partkey % 17) AS c",
                                              "double(p_partkey % 5) AS e", t)


def ranked(spark, d, target="y", standardize=True):
    return K.task(parts(spark, d, target), target, ["p_partkey"], FEATURES, standardize)


def _s(df, digits=5):
    return rounded(df.select("feature", "score"), ["score"], digits)


def _determinant(m):
    """Sum over permutations, as SQL text."""
    terms = []
    for order in permutations(range(len(m))):
        swaps = sum(order[i] > order[j] for i in range(len(m)) for j in range(i + 1, len(m)))
        terms.append(("-" if swaps % 2 else "+") + " * ".join(m[i][j] for i, j in enumerate(order)))
    return "(" + " ".join(terms) + ")"


def _least_squares_sql(alpha, digits):
    """Absolute coefficients on scaled features by Cramer's rule."""
    k = range(len(FEATURES))
    sums = [f"n * corr({FEATURES[i]}, {FEATURES[j]}) AS s{i}{j}" for i in k for j in k if i < j] + [f"n * corr({f}, y) * stddev_pop(y) AS c{i}" for i, f in enumerate(FEATURES)]
    m = [["(n + {})".format(alpha) if i == j else f"s{min(i, j)}{max(i, j)}" for j in k] for i in k]
    one = [f"SELECT '{f}' AS feature, abs({_determinant([[f'c{i}' if j == at else m[i][j] for j in k] for i in k])} / {_determinant(m)}) AS s FROM g" for at, f in enumerate(FEATURES)]
    return f"WITH g AS (SELECT any_value(n) AS n, {', '.join(sums).replace('n * ', 'any_value(n) * ')} FROM {_SQL}, (SELECT count(*)::DOUBLE AS n FROM {_SQL})) SELECT feature, {R('s', digits)} AS score FROM ({union_sql(one)})"


# ---- ranking ----------------------------------------------------------------------

for _key, _fn in {
    "f01_tree": K.tree, "f02_forest": K.forest, "f03_boosting": K.boosting,
    "f04_xgboost": K.xgboost, "f08_lasso": K.lasso, "f10_elastic_net": K.elastic_net,
    "f11_sparse_pca": K.sparse_pca, "f13_boruta": K.boruta, "f20_information_bottleneck": K.information_bottleneck,
    "f21_mrmr": K.mrmr, "f22_permutation": K.permutation_importance, "f24_lime": K.lime,
    "f25_interactions": K.interactions, "f27_feature_clustering": K.feature_clustering,
    "f28_bayesian": K.bayesian_importance,
}.items():
    @query(_key)
    def _(spark, d, fn=_fn):
        return _s(fn(ranked(spark, d)), 4)

for _key, _fn, _target in (("f03_boosting_classes", K.boosting, "cls2"), ("f05_logistic", K.linear, "cls2"), ("f06_svm", K.svm, "cls3"),
                           ("f08_lasso_classes", K.lasso, "cls2"),
                           ("f28_bootstrap_classes", K.bayesian_importance, "cls2")):
    @query(_key)
    def _(spark, d, fn=_fn, target=_target):
        return _s(fn(ranked(spark, d, target)), 3)


@query("f05_simple_slope", f"SELECT 'a' AS feature, {R('abs(regr_slope(y, a)) * stddev_pop(a)', 4)} AS score FROM {_SQL}")
def _(spark, d):
    return _s(K.linear(K.task(parts(spark, d, "y").select("p_partkey", "a", "y"), "y", ["p_partkey"])), 4)


@query("f07_target_map", f"SELECT feature, {R('score')} AS score FROM (" + union_sql([f"SELECT '{f}' AS feature, abs(corr({f}, y)) AS score FROM {_SQL}" for f in FEATURES]) + ")")
def _(spark, d):
    return _s(K.target_map(parts(spark, d, "y"), "y", FEATURES), 6)


@query("f07_target_map_spearman", union_sql([f"SELECT '{f}' AS feature, {R(f'abs(corr({f}, y))')} AS score FROM {_ranks([f, 'y'], _SQL)}" for f in FEATURES]))
def _(spark, d):
    return _s(K.target_map(parts(spark, d, "y"), "y", FEATURES, "spearman"), 6)


@query("f09_ridge_one_feature", f"SELECT 'a' AS feature, {R('abs(corr(a, y) * stddev_pop(y)) * count(*) / (count(*) + 50)', 5)} AS score FROM {_SQL}")
def _(spark, d):
    return _s(K.ridge(K.task(parts(spark, d, "y").select("p_partkey", "a", "y"), "y", ["p_partkey"]), 50.0), 5)


@query("f05_linear", _least_squares_sql(0.0, 4))
def _(spark, d):
    return _s(K.linear(ranked(spark, d)), 4)


@query("f09_ridge", _least_squares_sql(1.0, 5))
def _(spark, d):
    return _s(K.ridge(ranked(spark, d)))


@query("f12_rfe")
def _(spark, d):
    return _s(K.rfe_curve(ranked(spark, d), 3, 4, 2)[0])


def _anova_sql(f):
    return f"""SELECT '{f}' AS feature, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(ss) / (max(t) - count(*))) AS s FROM
 (SELECT count(*) AS n, avg({f}) AS m, var_pop({f}) * count(*) AS ss, (SELECT avg({f}) FROM {_SQL}) AS g, (SELECT count(*) FROM {_SQL}) AS t FROM {_SQL} GROUP BY cls3)"""


@query("f14_anova_f", f"SELECT feature, {R('s', 4)} AS score FROM ({union_sql([_anova_sql(f) for f in FEATURES])})")
def _(spark, d):
    return _s(K.anova_f(ranked(spark, d, "cls3")), 4)


@query("f14_regression_f", f"SELECT feature, {R('r / (1 - r) * (n - 2)', 3)} AS score FROM ({union_sql([f'SELECT {chr(39)}{f}{chr(39)} AS feature, corr({f}, y) ** 2 AS r, count(*) AS n FROM {_SQL}' for f in FEATURES])})")
def _(spark, d):
    return _s(K.anova_f(ranked(spark, d)), 3)


def _chi_sql(f):
    return f"""SELECT '{f}' AS feature, sum((o - t * n / tn) ** 2 / (t * n / tn)) AS s FROM (SELECT o, n, sum(o) OVER () AS t, sum(n) OVER () AS tn FROM
 (SELECT cls3, sum((abs({f}) - lo) / (hi - lo)) AS o, count(*)::DOUBLE AS n FROM {_SQL}, (SELECT min(abs({f})) AS lo, max(abs({f})) AS hi FROM {_SQL}) GROUP BY 1))"""


@query("f15_chi_square", f"SELECT feature, {R('s')} AS score FROM ({union_sql([_chi_sql(f) for f in FEATURES])})")
def _(spark, d):
    return _s(K.chi_square(ranked(spark, d, "cls3", False)), 6)


@query("f16_kendall", f"SELECT col_a AS feature, value AS score FROM ({_kendall_sql(['a', 'y'], _SQL)})")
def _(spark, d):
    return _s(K.kendall(parts(spark, d, "y"), "y", ["a"]), 6)


def _mw_sql(f):
    return f"""SELECT '{f}' AS feature, abs((sum(CASE WHEN cls3 = 'hi' THEN r END) - max(n0) * (max(n0) + 1) / 2) / (max(n0) * max(n1)) - 0.5) * 2 AS s FROM
 (SELECT cls3, rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0::DOUBLE AS r, count_if(cls3 = 'hi') OVER () AS n0, count_if(cls3 = 'lo') OVER () AS n1 FROM {_SQL} WHERE cls3 IN ('hi', 'lo'))"""


@query("f17_mann_whitney", f"SELECT feature, {R('s')} AS score FROM ({union_sql([_mw_sql(f) for f in FEATURES])})")
def _(spark, d):
    return _s(K.mann_whitney(ranked(spark, d, "cls3")), 6)


def _kw_sql(f):
    return f"""SELECT '{f}' AS feature, (12.0 / (max(t) * (max(t) + 1)) * sum(sr * sr / n) - 3 * (max(t) + 1)) / (1 - sum(tie) / (max(t) ** 3 - max(t))) AS s FROM
 (SELECT cls3, sum(r) AS sr, count(*)::DOUBLE AS n, sum(k * k - 1) AS tie, max(t) AS t FROM (SELECT cls3, rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0::DOUBLE AS r,
 (count(*) OVER (PARTITION BY {f}))::DOUBLE AS k, (count(*) OVER ())::DOUBLE AS t FROM {_SQL}) GROUP BY 1)"""


@query("f18_kruskal_wallis", f"SELECT feature, {R('s', 4)} AS score FROM ({union_sql([_kw_sql(f) for f in FEATURES])})")
def _(spark, d):
    return _s(K.kruskal_wallis(ranked(spark, d, "cls3")), 4)


@query("f18_kruskal_wallis_binned")
def _(spark, d):
    return _s(K.kruskal_wallis(ranked(spark, d)), 4)


@query("f19_mutual_information", "WITH k AS MATERIALIZED (SELECT * FROM " + codes_sql(FEATURES, _SQL, 10, "cls3") + ") " + union_sql([
    f"SELECT '{f}' AS feature, {R(mi_sql(f, 'cls3', 'k'))} AS score" for f in FEATURES]))
def _(spark, d):
    return _s(K.mutual_information(ranked(spark, d, "cls3")), 6)


_UNIT = "f AS MATERIALIZED (SELECT p_partkey AS i, cls2 AS cls, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 - 1) / (count(*) OVER () - 1) AS r, " + ", ".join(
    f"({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) AS {x}" for x in FEATURES) + f" FROM {_SQL})"
_FAR = " + ".join(f"(x.{f} - y.{f}) ** 2" for f in FEATURES)
_GAPS = ", ".join(f"abs(x.{f} - y.{f}) AS {f}" for f in FEATURES)


@query("f26_relieff", f"""WITH {_UNIT},
d AS (SELECT x.i, x.cls, y.cls AS t, {_GAPS} FROM f x JOIN f y ON x.i <> y.i QUALIFY row_number() OVER (PARTITION BY x.i, y.cls ORDER BY {_FAR}, y.i) <= 10),
m AS (SELECT i, cls, t, {', '.join(f'avg({f}) AS {f}' for f in FEATURES)} FROM d GROUP BY i, cls, t),
s AS (SELECT cls, count(*)::DOUBLE / (SELECT count(*) FROM f) AS s FROM f GROUP BY cls),
w AS (SELECT m.*, CASE WHEN m.cls = m.t THEN -1 ELSE st.s / (1 - sc.s + 1e-10) END / (SELECT count(*) FROM f) AS w FROM m JOIN s st ON st.cls = m.t JOIN s sc ON sc.cls = m.cls)
""" + union_sql([f"SELECT '{f}' AS feature, {R(f'sum(w * {f})', 3)} AS score FROM w" for f in FEATURES]))
def _(spark, d):
    return _s(K.relieff(ranked(spark, d, "cls2")), 3)


@query("f26_rrelieff", f"""WITH {_UNIT},
d AS (SELECT abs(x.r - y.r) / 10 AS dc, {_GAPS.replace(' AS', ' / 10 AS')} FROM f x JOIN f y ON x.i <> y.i QUALIFY row_number() OVER (PARTITION BY x.i ORDER BY {_FAR}, y.i) <= 10),
n AS (SELECT count(*) AS n FROM f)
""" + union_sql([f"SELECT '{f}' AS feature, {R(f'sum(10 * dc * {f}) / (sum(dc) + 1e-12) - (sum({f}) - sum(10 * dc * {f})) / (any_value(n) - sum(dc) + 1e-12)', 3)} AS score FROM d, n" for f in FEATURES]))
def _(spark, d):
    return _s(K.relieff(ranked(spark, d)), 3)


def _class_information_sql(x):
    """Nearest-neighbour information between a feature and the classes, from all pairs of rows."""
    return f"""(WITH f AS MATERIALIZED (SELECT p_partkey AS i, {x} AS x, cls3 AS c, count(*) OVER (PARTITION BY cls3) AS n FROM {_SQL} QUALIFY n > 1),
e AS (SELECT a.i, least(3, a.n - 1) AS k, abs(a.x - b.x) AS eps FROM f a JOIN f b ON a.i <> b.i AND a.c = b.c QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY eps) = least(3, a.n - 1)),
m AS (SELECT a.i, any_value(a.n) AS n, any_value(k) AS k, sum((abs(a.x - b.x) <= eps * (1 - 1e-9))::INT) AS m FROM f a JOIN e ON a.i = e.i, f b GROUP BY a.i), {PSI}
SELECT '{x}' AS feature, greatest(0, (SELECT p FROM psi WHERE i = (SELECT count(*) FROM f)) + avg(pk.p) - avg(pn.p) - avg(pm.p)) AS v
FROM m JOIN psi pk ON pk.i = k JOIN psi pn ON pn.i = n JOIN psi pm ON pm.i = m)"""


@query("f19_mutual_information_knn", union_sql([f"SELECT feature, {R('v', 4)} AS score FROM {_class_information_sql(x)}" for x in FEATURES]))
def _(spark, d):
    return _s(K.mutual_information(ranked(spark, d, "cls3"), estimator="knn"), 4)


for _key, _fn in {"f20_information_bottleneck_knn": K.information_bottleneck, "f21_mrmr_knn": K.mrmr, "f27_feature_clustering_knn": K.feature_clustering}.items():
    @query(_key)
    def _(spark, d, fn=_fn):
        return _s(fn(ranked(spark, d), estimator="knn"), 4)


def _suppliers(spark, d):
    df = table(spark, d, "supplier").selectExpr("s_suppkey", "s_acctbal AS a", "double(s_nationkey) AS b", "double(s_suppkey % 7) AS c", "s_acctbal / 100 + s_nationkey * 3 AS y")
    return K.task(df, "y", ["s_suppkey"])


@query("f23_kernel_shap")
def _(spark, d):
    return _s(K.shap_scores(K.shap(_suppliers(spark, d))), 4)


@query("v17_shap_points")
def _(spark, d):
    out = S.shap_points(K.shap(_suppliers(spark, d)))
    return out.select("k0", "feature", rd("phi", 4).alias("phi"), rd("phi_scaled", 4).alias("phi_scaled"))


def _partial3(f, y, g, h):
    """Second-order partial correlation by recursion."""
    def r(a, b):
        return f"corr({a}, {b})"

    def p1(a, b, c):
        return f"(({r(a, b)} - {r(a, c)} * {r(b, c)}) / sqrt((1 - {r(a, c)} ** 2) * (1 - {r(b, c)} ** 2)))"
    return f"({p1(f, y, g)} - {p1(f, h, g)} * {p1(y, h, g)}) / sqrt((1 - {p1(f, h, g)} ** 2) * (1 - {p1(y, h, g)} ** 2))"


@query("f29_partial_tests", union_sql([f"SELECT '{f}' AS feature, {R(_partial3(f, 'y', g, h), 5)} AS r FROM {_SQL}" for f, g, h in (("a", "c", "e"), ("c", "a", "e"), ("e", "a", "c"))]))
def _(spark, d):
    t = K.task(parts(spark, d, "y").drop("b"), "y", ["p_partkey"])
    return rounded(K.partial_tests(t).select("feature", "r"), ["r"], 5)


@query("f30_markov_blanket")
def _(spark, d):
    return rounded(K.markov_blanket(ranked(spark, d)), ["r", "p"], 5)


@query("f31_bound_scores")
def _(spark, d):
    df = parts(spark, d, "y")
    return K.bind(_s(K.ridge(ranked(spark, d))), "ridge", 0, P.fingerprint_text(df))


@query("f32_grouped_importance")
def _(spark, d):
    df = parts(spark, d, "y").withColumn("grp", F.when(F.col("e") < 2, "low").otherwise("high"))
    return rounded(K.grouped_importance(df, "grp", "y", ["p_partkey"], ["a", "b", "c"], n_trees=5, max_depth=5), ["score"], 4)


_FLAG = "(SELECT l_returnflag AS feature, avg(l_discount) - 0.05 AS score FROM lineitem GROUP BY 1)"


@query("f33_presentation", f"SELECT feature, {R('abs(score) / (SELECT max(abs(score)) FROM ' + _FLAG + ')', 5)} AS relative FROM {_FLAG} ORDER BY abs(score) DESC LIMIT 2")
def _(spark, d):
    s = line(spark, d).groupBy(F.col("l_returnflag").alias("feature")).agg((F.avg("l_discount") - 0.05).alias("score"))
    return rounded(K.presentation(s, 2), ["relative"], 5)


@query("f33_presentation_errors")
def _(spark, d):
    return rounded(K.presentation(K.permutation_importance(ranked(spark, d, "cls2"))), ["relative", "error"], 4)


@query("f34_elimination_summary", f"""WITH c AS (SELECT l_linenumber AS n_features, (l_orderkey % 5)::INT AS fold, avg(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
p AS (SELECT n_features, avg(score) AS mean, stddev_pop(score) AS std FROM c GROUP BY 1) SELECT n_features, {R('mean', 5)} AS mean, {R('std', 5)} AS std, mean = (SELECT max(mean) FROM p) AS is_best FROM p""")
def _(spark, d):
    curve = line(spark, d).groupBy(F.col("l_linenumber").alias("n_features"), F.expr("int(l_orderkey % 5)").alias("fold")).agg(F.avg("l_quantity").alias("score"))
    return rounded(K.elimination_summary(curve), ["mean", "std"], 5)


# ---- models --------------------------------------------------------------------------


def _run(spark, d, method, target, **kw):
    return M.evaluate(parts(spark, d, target), FEATURES, target, method, ["p_partkey"], **kw)


for _key, _method, _target, _kw in (
        ("l08_linear", "linear", "y", {}), ("l09_logistic", "logistic", "cls2", {}), ("l10_ridge", "ridge", "y", {}),
        ("l10_ridge_classes", "ridge", "cls3", {}), ("l11_lasso", "lasso", "y", {}), ("l12_decision_tree", "decision_tree", "y", {}),
        ("l13_random_forest", "random_forest", "cls3", {}), ("l14_gradient_boosting", "gradient_boosting", "y", {}),
        ("l15_adaboost", "adaboost", "cls2", {}), ("l15_adaboost_regression", "adaboost", "y", {}),
        ("l16_svm", "svm", "cls2", {}), ("l17_knn", "knn", "cls3", {}), ("l17_knn_regression", "knn", "y", {"weights": "distance"}),
        ("l18_mlp", "mlp", "cls2", {}), ("l19_naive_bayes", "naive_bayes", "cls3", {}),
        ("l20_bayesian_ridge", "bayesian_ridge", "y", {}), ("l21_xgboost", "xgboost", "y", {}), ("l21_lightgbm", "lightgbm", "y", {})):
    @query(_key)
    def _(spark, d, method=_method, target=_target, kw=_kw):
        m = _run(spark, d, method, target, **kw).metrics
        return rounded(m, m.columns, 4)


@query("l01_prepare", f"SELECT c AS label, count(*) AS n FROM (SELECT CASE cls3 WHEN 'hi' THEN 0.0 WHEN 'lo' THEN 1.0 ELSE 2.0 END::DOUBLE AS c FROM {_SQL}) GROUP BY 1")
def _(spark, d):
    p = M.prepare(parts(spark, d, "cls3"), FEATURES, "cls3", ["p_partkey"])
    return p.train.select("label").unionByName(p.test.select("label")).groupBy("label").agg(F.count("*").alias("n"))


_PRED = "(SELECT l_quantity AS label, 25 + l_discount * 10 AS prediction FROM lineitem)"


def _pred(spark, d):
    return line(spark, d).selectExpr("l_quantity AS label", "25 + l_discount * 10 AS prediction")


@query("l02_regression_metrics", f"SELECT {R('1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*))')} AS r2, {R('sqrt(avg((label - prediction) ** 2))')} AS rmse, {R('avg(abs(label - prediction))')} AS mae FROM {_PRED}")
def _(spark, d):
    return rounded(M.regression_metrics(_pred(spark, d)), ["r2", "rmse", "mae"])


_CPRED = "(SELECT (l_linenumber % 3)::DOUBLE AS label, ((l_linenumber + (l_orderkey % 4 = 0)::INT) % 3)::DOUBLE AS prediction FROM lineitem)"


def _cpred(spark, d):
    return line(spark, d).selectExpr("double(l_linenumber % 3) AS label", "double((l_linenumber + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 3) AS prediction")


@query("l03_class_metrics", f"""WITH c AS (SELECT k, count_if(label = k AND prediction = k)::DOUBLE AS tp, count_if(label = k) AS sup, count_if(prediction = k) AS cal FROM {_CPRED}, (SELECT unnest([0.0, 1.0, 2.0]) AS k) GROUP BY 1)
SELECT {R('sum(tp) / sum(sup)')} AS accuracy, {R('avg(2 * tp / (sup + cal))')} AS f1, {R('avg(tp / cal)')} AS "precision", {R('avg(tp / sup)')} AS recall FROM c""")
def _(spark, d):
    return rounded(M.class_metrics(_cpred(spark, d), 3), ["accuracy", "f1", "precision", "recall"])


@query("l03_binary_metrics", f"""SELECT {R('avg((label = prediction)::INT)')} AS accuracy, {R('2 * tp / (sup + cal)')} AS f1, {R('tp / cal')} AS "precision", {R('tp / sup')} AS recall FROM
 (SELECT label, prediction, (count_if(label = 1 AND prediction = 1) OVER ())::DOUBLE AS tp, count_if(label = 1) OVER () AS sup, count_if(prediction = 1) OVER () AS cal FROM {_CPRED} WHERE label < 2) GROUP BY tp, sup, cal""")
def _(spark, d):
    return rounded(M.class_metrics(_cpred(spark, d).filter("label < 2"), 2), ["accuracy", "f1", "precision", "recall"])


@query("l04_confusion", f"SELECT label, prediction, count(*) AS n FROM {_CPRED} GROUP BY 1, 2")
def _(spark, d):
    return M.confusion(_cpred(spark, d))


_SC = "(SELECT (l_quantity > 25)::INT::DOUBLE AS label, round(l_discount + l_quantity / 500, 4) AS score FROM lineitem)"


def _scored(spark, d):
    return line(spark, d).selectExpr("double(int(l_quantity > 25)) AS label", "round(l_discount + l_quantity / 500, 4) AS score")


@query("l05_roc", f"""WITH s AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM {_SC} GROUP BY 1)
SELECT round(score, 4) AS threshold, {R('sum(n) OVER (ORDER BY score DESC) / sum(n) OVER ()')} AS fpr, {R('sum(p) OVER (ORDER BY score DESC) / sum(p) OVER ()')} AS tpr FROM s""")
def _(spark, d):
    return rounded(rounded(M.roc(_scored(spark, d)), ["threshold"], 4), ["fpr", "tpr"])


@query("l05_auc", f"""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM {_SC})
SELECT {R('(sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))')} AS auc FROM r""")
def _(spark, d):
    return rounded(M.auc(_scored(spark, d)), ["auc"])


@query("l06_importances")
def _(spark, d):
    return rounded(_run(spark, d, "random_forest", "y", n_trees=5, max_depth=5).fitted.importances(spark), ["score"], 4)


@query("l07_compatible")
def _(spark, d):
    return M.compatible(parts(spark, d, "cls2"), "cls2")


@query("l19_naive_bayes_rule", f"""WITH b AS (SELECT label, ln(count(*) / (SELECT count(*) FROM {_SC})::DOUBLE) AS pr, avg(score) AS m_score, var_pop(score) + 1e-9 * (SELECT var_pop(score) FROM {_SC}) AS v_score FROM {_SC} GROUP BY 1),
s AS (SELECT t.label, t.score, max(CASE WHEN b.label = 0 THEN pr - 0.5 * ln(2 * pi() * v_score) - (t.score - m_score) ** 2 / (2 * v_score) END) AS l0,
 max(CASE WHEN b.label = 1 THEN pr - 0.5 * ln(2 * pi() * v_score) - (t.score - m_score) ** 2 / (2 * v_score) END) AS l1 FROM (SELECT DISTINCT label, score FROM {_SC}) t, b GROUP BY 1, 2)
SELECT label, round(score, 4) AS score, {R('1 / (1 + exp(l0 - l1))', 5)} AS p FROM s""")
def _(spark, d):
    rows = _scored(spark, d).withColumnRenamed("score", "x0")
    fitted = M.naive_bayes(M.Prepared(rows, rows, ["score"], ["0", "1"], [], [], 0))
    return fitted.predict(rows.distinct()).select("label", F.round("x0", 4).alias("score"), rd("score", 5).alias("p"))


@query("l08_linear_one_feature", f"SELECT p_partkey, {R('regr_intercept(y, a) OVER () + a * regr_slope(y, a) OVER ()', 4)} AS prediction FROM {_SQL}")
def _(spark, d):
    rows = parts(spark, d, "y").selectExpr("p_partkey", "a AS x0", "y AS label")
    return M.linear(M.Prepared(rows, rows, ["a"], None, [], [], 0)).predict(rows).select("p_partkey", rd("prediction", 4).alias("prediction"))


def _oof_sql(folds):
    return f"""(SELECT t.p_partkey, t.y AS label, k * t.a + i AS prediction, f AS fold FROM (SELECT *, (p_partkey % {folds})::INT AS f FROM {_SQL}) t JOIN
 (SELECT g, regr_slope(y, a) AS k, regr_intercept(y, a) AS i FROM {_SQL} JOIN (SELECT unnest(range({folds})) AS g) ON p_partkey % {folds} <> g GROUP BY g) c ON t.f = c.g)"""


@query("l22_out_of_fold", f"SELECT p_partkey, {R('label', 8)} AS label, {R('prediction', 7)} AS prediction, fold FROM {_oof_sql(5)}")
def _(spark, d):
    out = M.out_of_fold(parts(spark, d, "y"), ["a"], "y", ["p_partkey"], M.linear, by=mod_fold("p_partkey", 5))
    return rounded(rounded(out, ["label"], 8), ["prediction"], 7)


@query("l22_out_of_fold_forest")
def _(spark, d):
    out = M.out_of_fold(parts(spark, d, "y"), FEATURES, "y", ["p_partkey"], M.random_forest, 3, n_trees=5, max_depth=5)
    return rounded(out, ["label", "prediction"], 4)


@query("l23_model_hash")
def _(spark, d):
    return rows_frame(spark, [(m, _run(spark, d, m, "y").fitted.state_hash) for m in ("linear", "ridge")], "method string, state_hash string")


@query("l24_residuals", f"SELECT label, {R('prediction')} AS prediction, {R('label - prediction')} AS residual FROM {_PRED}")
def _(spark, d):
    return rounded(M.residual_table(_pred(spark, d)), ["prediction", "residual"])
