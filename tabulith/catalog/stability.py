"""Queries: stability, audits and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.folds import mod_fold
from ..operators import audit as Au
from ..operators import conditioning as E
from ..operators import outliers
from ..operators import ranking as K
from ..operators import stability as St
from ..session import scratch_path
from ..streaming import apply as Stream
from .base import R, query, rd, rounded, table, union_sql
from .learning import _SQL, FEATURES, parts
from .tables import line

# scores derived from the table: variant by line number, feature by flag and status
_SC = """(SELECT l_linenumber AS variant_id, concat(l_returnflag, l_linestatus) AS feature, avg(l_discount) - 0.05 AS score FROM lineitem
 WHERE NOT (l_linenumber = 3 AND l_returnflag = 'A') GROUP BY 1, 2)"""
_AL = f"(SELECT v.variant_id, f.feature, coalesce(score, 0) AS score FROM (SELECT DISTINCT variant_id FROM {_SC}) v CROSS JOIN (SELECT DISTINCT feature FROM {_SC}) f LEFT JOIN {_SC} s USING (variant_id, feature))"


def scores(spark, d):
    return line(spark, d).filter("NOT (l_linenumber = 3 AND l_returnflag = 'A')").groupBy(
        F.col("l_linenumber").alias("variant_id"), F.concat("l_returnflag", "l_linestatus").alias("feature")).agg((F.avg("l_discount") - 0.05).alias("score"))


def family(spark, d, target="y", **kw):
    """Conditioned variants of the part table."""
    return E.condition(parts(spark, d, target), ["a", "b"], [E.Bound("a", 2.0, 49.0)], **kw)


@query("e15_across_variants")
def _(spark, d):
    got = St.across_variants(family(spark, d), lambda df: K.ridge(K.task(df, "y", ["p_partkey"], FEATURES)))
    return rounded(got, ["score"], 4)


@query("e16_align", f"SELECT variant_id, feature, {R('score')} AS score FROM {_AL}")
def _(spark, d):
    return rounded(St.align(scores(spark, d)), ["score"])


_ST = f"(SELECT feature, var_samp(score) AS variance, avg(score) AS mean, avg(abs(score)) AS mean_abs, count_if(score > 0) AS p, count_if(score < 0) AS m, count(*) AS n FROM {_AL} GROUP BY 1)"


@query("e17_feature_stability", f"SELECT feature, {R('1e6 * variance', 4)} AS variance, {R('mean', 7)} AS mean, {R('mean_abs', 7)} AS mean_abs FROM {_ST}")
def _(spark, d):
    got = St.feature_stability(scores(spark, d)).withColumn("variance", F.col("variance") * 1e6)
    return rounded(rounded(got, ["variance"], 4), ["mean", "mean_abs"], 7).select("feature", "variance", "mean", "mean_abs")


@query("e18_variant_agreement", f"""SELECT x.variant_id AS a, y.variant_id AS b, {R('sum(sign(x.score - x2.score) * sign(y.score - y2.score)) / sqrt(sum((x.score <> x2.score)::INT)::DOUBLE * sum((y.score <> y2.score)::INT))')} AS tau
FROM {_AL} x JOIN {_AL} x2 ON x.variant_id = x2.variant_id JOIN {_AL} y ON y.feature = x.feature JOIN {_AL} y2 ON y2.feature = x2.feature AND y2.variant_id = y.variant_id WHERE x.variant_id < y.variant_id GROUP BY 1, 2""")
def _(spark, d):
    return rounded(St.variant_agreement(scores(spark, d)), ["tau"])


_TOP = "(SELECT variant_id, feature FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY {o} DESC, feature) AS r FROM {src}) WHERE r <= {k})"


@query("e19_top_overlap", f"SELECT {R('count(*) / 3.0::DOUBLE')} AS overlap FROM (SELECT feature FROM {_TOP.format(o='abs(score)', src=_AL, k=3)} GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT variant_id) FROM {_AL}))")
def _(spark, d):
    return rounded(St.top_overlap(scores(spark, d), 3), ["overlap"])


@query("e20_sign_consistency", f"SELECT feature, {R('CASE WHEN p + m = 0 THEN 1 ELSE greatest(p, m) / n::DOUBLE END')} AS sign_consistency FROM {_ST}")
def _(spark, d):
    return rounded(St.feature_stability(scores(spark, d)), ["sign_consistency"]).select("feature", "sign_consistency")


@query("e21_labels", f"SELECT feature, CASE WHEN mean_abs < 1e-4 THEN 'trivially_stable' WHEN variance / mean_abs ** 2 < 0.05 THEN 'family_stable' ELSE 'contingent' END AS label FROM {_ST}")
def _(spark, d):
    return St.feature_stability(scores(spark, d)).select("feature", "label")


@query("e22_metric_stability", f"""SELECT metric, {R('avg(value)', 5)} AS mean, {R('stddev_samp(value)', 5)} AS std, {R('var_samp(value)', 5)} AS delta, CASE WHEN stddev_samp(value) < 0.02 THEN 'family_stable' ELSE 'contingent' END AS label
FROM (SELECT l_linenumber, 'discount' AS metric, avg(l_discount) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_linenumber, 'quantity', avg(l_quantity) FROM lineitem GROUP BY 1) GROUP BY 1""")
def _(spark, d):
    per = line(spark, d).groupBy(F.col("l_linenumber").alias("variant_id")).agg(F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"))
    out = St.metric_stability(per.unpivot("variant_id", ["discount", "quantity"], "metric", "value")).drop("is_primary")
    return rounded(out, ["mean", "std", "delta"], 5)


@query("e22_prediction_stability")
def _(spark, d):
    return rounded(St.prediction_stability(family(spark, d), FEATURES, "y", "ridge", ["p_partkey"], primary="r2"), ["mean", "std", "delta"], 4)


_EN = "(SELECT l_linestatus AS model, l_linenumber AS variant_id, l_returnflag AS feature, avg(l_discount) - 0.05 AS score FROM lineitem GROUP BY 1, 2, 3)"
_PHI = f"(SELECT model, variant_id, feature, abs(score) / sum(abs(score)) OVER (PARTITION BY model, variant_id) AS phi FROM {_EN})"


def ensemble(spark, d):
    return line(spark, d).groupBy(F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("variant_id"), F.col("l_returnflag").alias("feature")).agg(
        (F.avg("l_discount") - 0.05).alias("score"))


@query("e23_variance_split", f"""WITH m AS (SELECT feature, model, var_pop(phi) AS v, avg(phi) AS a FROM {_PHI} GROUP BY 1, 2), s AS (SELECT feature, avg(v) AS w, var_pop(a) AS b FROM m GROUP BY 1),
t AS (SELECT feature, var_pop(phi) AS t, avg(phi) AS p FROM {_PHI} GROUP BY 1)
SELECT feature, {R('w')} AS within, {R('b')} AS between, {R('t')} AS total, {R('p')} AS mean_phi, t < 1e-8 AS flat FROM s JOIN t USING (feature)""")
def _(spark, d):
    return rounded(St.variance_split(ensemble(spark, d)).drop("label"), ["within", "between", "total", "mean_phi"])


@query("e24_top_jaccard", f"""WITH s AS (SELECT variant_id, feature, avg(phi) AS score FROM {_PHI} GROUP BY 1, 2), t AS (SELECT * FROM {_TOP.format(o='score', src='s', k=2)}),
p AS (SELECT x.variant_id AS a, y.variant_id AS b, count(*) AS k FROM t x JOIN t y ON x.feature = y.feature AND x.variant_id < y.variant_id GROUP BY 1, 2), n AS (SELECT count(DISTINCT variant_id) AS n FROM t)
SELECT {R('(SELECT sum(k / (4.0 - k)) FROM p) / (n * (n - 1) / 2)')} AS jaccard FROM n""")
def _(spark, d):
    return rounded(St.top_jaccard(St.averaged_by_variant(ensemble(spark, d)), 2), ["jaccard"])


@query("e25_default_ensemble")
def _(spark, d):
    members = St.default_members("y", ["p_partkey"], FEATURES, n_trees=3, max_depth=4)
    return rounded(St.variance_split(St.ensemble_scores(family(spark, d, n_variants=2), members)), ["within", "between", "total", "mean_phi"])


@query("e26_substitute_proxy", f"SELECT l_orderkey, l_linenumber, {R('(l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_samp(l_tax) FROM lineitem) * (SELECT stddev_samp(l_discount) FROM lineitem) + (SELECT avg(l_discount) FROM lineitem)')} AS l_discount FROM lineitem")
def _(spark, d):
    df = line(spark, d).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rounded(St.substitute(df, "l_discount", "l_tax"), ["l_discount"])


@query("e27_proxy_stability")
def _(spark, d):
    df = parts(spark, d, "y").withColumn("a2", F.col("a") * 1.1 + F.col("e"))
    got = St.proxy_stability(df, ["a", "a2"], lambda x: K.ridge(K.task(x, "y", ["p_partkey"])))
    return rounded(got, ["variance", "mean", "mean_abs", "sign_consistency"], 4)


@query("e28_shap_stability")
def _(spark, d):
    df = table(spark, d, "supplier").selectExpr("s_suppkey", "s_acctbal / 1000 AS a", "double(s_nationkey) AS b", "s_acctbal / 100 + s_nationkey * 3 AS y")
    cond = E.condition(df, ["a"], [E.Bound("a", -0.9, 9.9)])
    return rounded(St.shap_stability(cond, "y", ["s_suppkey"], ["a", "b"]), ["variance", "mean", "mean_abs"], 4)


def _oof(features_sql, y):
    return f"""(SELECT f, {y} AS y, k * {features_sql} + i AS p FROM (SELECT *, (p_partkey % 5)::INT AS f FROM {_SQL}) t JOIN
 (SELECT g, regr_slope({y}, {features_sql}) AS k, regr_intercept({y}, {features_sql}) AS i FROM {_SQL} JOIN (SELECT unnest(range(5)) AS g) ON p_partkey % 5 <> g GROUP BY g) c ON t.f = c.g)"""


@query("e29_recoverability", f"SELECT 'y' AS target, count(*) AS n, {R('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))')} AS r2, {R('sqrt(avg((y - p) ** 2))', 5)} AS rmse, {R('avg(abs(y - p))', 5)} AS mae, "
       f"CASE WHEN 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) >= 0.8 THEN 'proxy_recoverable' ELSE 'not_recoverable' END AS verdict FROM {_oof('a', 'y')}")
def _(spark, d):
    got = Au.recoverability(parts(spark, d, "y"), "y", ["a"], ["p_partkey"], "linear", by=mod_fold("p_partkey", 5))
    return rounded(rounded(got.drop("learner", "threshold"), ["r2"]), ["rmse", "mae"], 5)


@query("e29_recoverability_ridge")
def _(spark, d):
    return rounded(Au.recoverability(parts(spark, d, "y"), "y", ["a", "c"], ["p_partkey"]), ["r2", "rmse", "mae"], 4)


def _r2(src):
    return f"(SELECT avg(r) FROM (SELECT 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r FROM {src} GROUP BY f))"


@query("e30_shortcut", f"SELECT {R(_r2(_oof('a', 'b')), 5)} AS r2_proxy, {R(_r2(_oof('a', 'y')), 5)} AS r2_full FROM (SELECT 1)")
def _(spark, d):
    got = Au.shortcut(parts(spark, d, "y"), "y", "b", ["a"], ["a"], ["p_partkey"], "linear", by=mod_fold("p_partkey", 5))
    return rounded(got.select("r2_proxy", "r2_full"), ["r2_proxy", "r2_full"], 5)


@query("e30_shortcut_forest")
def _(spark, d):
    got = Au.shortcut(parts(spark, d, "y"), "y", "a", ["c", "e"], FEATURES, ["p_partkey"], folds=2, n_trees=3, max_depth=5)
    return rounded(got, ["r2_proxy", "r2_full", "r2_residual", "r2_without_proxy", "shortcut_drop", "ablation_drop"], 4)


# ---- extension points and streams ---------------------------------------------------------

@query("u3_any_scorer", union_sql([f"SELECT 'a' AS feature, {R('avg(least(greatest(a, lo), hi))', 4)} AS score FROM {_SQL}, (SELECT quantile_cont(a, {lo}) AS lo, quantile_cont(a, {hi}) AS hi FROM {_SQL})"
                                   for lo, hi in ((0.005, 0.995), (0.1, 0.9))]))
def _(spark, d):
    df = parts(spark, d, "y")
    refs = E.references(df, ["a"])["a"]
    out = [E.apply(df, {"columns": {"a": [refs.cuts[lo], refs.cuts[hi]]}}).agg(F.lit("a").alias("feature"), rd(F.avg("a"), 4).alias("score"))
           for lo, hi in ((0.5, 99.5), (10.0, 90.0))]
    return out[0].unionByName(out[1])


def _stream(spark, d):
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)


@query("u_stream_fitted_steps", f"SELECT l_orderkey, l_linenumber, {R('l_quantity / 50 - 0.5')} AS l_quantity, abs(l_tax) AS l_tax_absolute FROM lineitem WHERE l_extendedprice <= 90000")
def _(spark, d):
    steps = [("filter_rows", {"where": "l_extendedprice <= 90000"}),
             ("normalize_scale", {"method": "standard", "columns": ["l_quantity"], "fitted": {"l_quantity": {"mean": 25.0, "sd": 50.0}}}),
             ("transform_columns", {"transform_type": "absolute", "columns": ["l_tax"], "fitted": {"l_tax": {}}})]
    path = scratch_path(spark, "stream")
    out = Stream.apply_steps(_stream(spark, d), steps).select("l_orderkey", "l_linenumber", rd("l_quantity").alias("l_quantity"), "l_tax_absolute")
    Stream.write(out, path).awaitTermination()
    return spark.read.parquet(path)


@query("u_stream_outliers", f"SELECT l_orderkey, l_linenumber, abs(l_quantity - m) / s > 1.5 AS is_outlier FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def _(spark, d):
    params = outliers.fit(line(spark, d), "zscore", ["l_quantity"], threshold=1.5)
    path = scratch_path(spark, "stream")
    Stream.write(Stream.flag_outliers(_stream(spark, d), params).select("l_orderkey", "l_linenumber", "is_outlier"), path).awaitTermination()
    return spark.read.parquet(path)

