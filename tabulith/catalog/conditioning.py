"""Queries: conditioning, ledger and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rows_frame
from ..operators import conditioning as E
from ..operators import normalize, steps  # noqa: F401 - registers the replayable steps
from ..plans import ledger as L
from .base import R, query, rd, rounded, table, union_sql
from .tables import OUTLIER_PRICE, line

_COLS = ["price", "l_quantity"]
_BOUNDS = [E.Bound("price", 1000.0, 104000.0), E.Bound("l_quantity", None, 49.0)]
_SRC = f"(SELECT l_orderkey, l_linenumber, {OUTLIER_PRICE} AS price, l_quantity FROM lineitem)"


def source(spark, d):
    return line(spark, d).selectExpr("l_orderkey", "l_linenumber", f"{OUTLIER_PRICE} AS price", "l_quantity")


@query("e01_winsorize", f"SELECT l_orderkey, l_linenumber, least(greatest(price, 2000), 90000) AS price FROM {_SRC}")
def _(spark, d):
    return source(spark, d).select("l_orderkey", "l_linenumber", E.winsorize(F.col("price"), 2000.0, 90000.0).alias("price"))


@query("e02_soft_clamp", f"SELECT l_orderkey, l_linenumber, {R('2000 + 88000 * (0.5 + 0.5 * tanh((price - 46000) / (0.15 * 88000)))', 3)} AS price FROM {_SRC}")
def _(spark, d):
    return source(spark, d).select("l_orderkey", "l_linenumber", rd(E.soft_clamp(F.col("price"), 2000.0, 90000.0), 3).alias("price"))


def _ref(col):
    return (f"(SELECT quantile_cont({col}, 0.05) AS q05, quantile_cont({col}, 0.95) AS q95, "
            f"greatest(quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25), 0.01 * (max({col}) - min({col}))) AS iqr FROM {_SRC})")


_HALF = "least(price, 80000)"
_RES = (f"SELECT avg((p < 1000)::INT) AS tail_lo, avg((p > 104000)::INT) AS tail_hi, abs(quantile_cont(p, 0.05) - max(q05)) / max(iqr) AS q05_dev, "
        f"abs(quantile_cont(p, 0.95) - max(q95)) / max(iqr) AS q95_dev FROM (SELECT {_HALF} AS p FROM {_SRC}), {_ref('price')}")


@query("e03_residuals", f"SELECT {', '.join(R(c) + ' AS ' + c for c in E.WEIGHTS)} FROM ({_RES})")
def _(spark, d):
    df = source(spark, d)
    got = E.residuals(df, {"price": F.least("price", F.lit(80000.0))}, E.references(df, ["price"]), {"price": _BOUNDS[0]})["price"]
    return rounded(rows_frame(spark, [tuple(got.values())], ", ".join(f"{k} double" for k in got)), list(got))


@query("e04_distortion", f"SELECT {R('greatest(tail_lo - 0.05, 0) + greatest(tail_hi - 0.05, 0) + 0.5 * greatest(q05_dev - 0.2, 0) + 0.5 * greatest(q95_dev - 0.2, 0)')} AS d FROM ({_RES})")
def _(spark, d):
    df = source(spark, d)
    got = E.residuals(df, {"price": F.least("price", F.lit(80000.0))}, E.references(df, ["price"]), {"price": _BOUNDS[0]})
    return rounded(rows_frame(spark, [(E.distortion(got),)], "d double"), ["d"])


@query("e05_displacement", f"SELECT {R('avg(abs(least(price, 80000) - price)) / max(iqr)')} AS omega FROM {_SRC}, {_ref('price')}")
def _(spark, d):
    df = source(spark, d)
    return rounded(E.displacement(df, "price", F.least("price", F.lit(80000.0)), E.references(df, ["price"])["price"].iqr), ["omega"])


def _cut(col, p):
    return f"quantile_cont({col}, {p / 100})"


def _grid_sql(tail):
    per = []
    for col, lo_b, hi_b in (("price", 1000.0, 104000.0), ("l_quantity", None, 49.0)):
        lo_cuts = ", ".join(f"({p}::DOUBLE, (SELECT {_cut(col, p)} FROM src))" for p in E.LOW_PCT)
        hi_cuts = ", ".join(f"({p}::DOUBLE, (SELECT {_cut(col, p)} FROM src))" for p in E.HIGH_PCT)
        feasible = " AND ".join([*([f"min(t) >= {lo_b} - 1e-9"] if lo_b is not None else []),
                                 *([f"max(t) <= {hi_b} + 1e-9"] if hi_b is not None else []),
                                 "quantile_cont(abs(t - x), 0.9) <= 3 * max(iqr)", "avg(abs(t - x)) / max(iqr) <= 0.18"])
        tl = f"avg((t < {lo_b})::INT)" if lo_b is not None else "0"
        th = f"avg((t > {hi_b})::INT)" if hi_b is not None else "0"
        per.append(f"""SELECT lo_pct, hi_pct, avg(abs(t - x)) / max(iqr) AS omega, ({feasible}) AS ok,
 greatest({tl} - 0.05, 0) + greatest({th} - 0.05, 0) + 0.5 * greatest(abs(quantile_cont(t, 0.05) - max(q05)) / max(iqr) - 0.2, 0)
 + 0.5 * greatest(abs(quantile_cont(t, 0.95) - max(q95)) / max(iqr) - 0.2, 0) AS dd
 FROM (SELECT lo_pct, hi_pct, {col} AS x, least(greatest({col}, lo), hi) AS t, q05, q95, iqr FROM src, (VALUES {lo_cuts}) l(lo_pct, lo),
 (VALUES {hi_cuts}) h(hi_pct, hi), {_ref(col)}) GROUP BY 1, 2""")
    return (f"WITH src AS (SELECT * FROM {_SRC}), g AS (SELECT lo_pct, hi_pct, avg(omega) AS omega, bool_and(ok) AS feasible, sum(dd) AS d_after "
            f"FROM ({union_sql(per)}) GROUP BY 1, 2) {tail}")


@query("e06_feasibility", _grid_sql("SELECT lo_pct, hi_pct, feasible FROM g"))
def _(spark, d):
    return _grid(spark, d).select("lo_pct", "hi_pct", "feasible")


def _grid(spark, d, kind="winsorize"):
    df = source(spark, d)
    rows = [(c.lo_pct, c.hi_pct, c.d_after, c.omega, c.feasible)
            for c in E.grid(df, E.references(df, _COLS), {b.col: b for b in _BOUNDS}, kind)]
    out = rows_frame(spark, rows, "lo_pct double, hi_pct double, d_after double, omega double, feasible boolean")
    return rounded(out, ["d_after", "omega"])


@query("e07_grid", _grid_sql(f"SELECT lo_pct, hi_pct, feasible, {R('d_after')} AS d_after, {R('omega')} AS omega FROM g"))
def _(spark, d):
    return _grid(spark, d)


@query("e07_grid_soft")
def _(spark, d):
    return _grid(spark, d, "soft_clamp")


@query("e08_diverse_variants")
def _(spark, d):
    return rounded(E.condition(source(spark, d), _COLS, _BOUNDS).variant_table(), ["lo_val", "hi_val", "distortion", "d_after"], 5)


_FIXED = [{"kind": "winsorize", "softness": 0.15, "columns": {"price": [2000.0 * (i + 1), 90000.0 - 5000 * i], "l_quantity": [2.0, 48.0 - i]}}
          for i in range(5)]


@query("e09_apply_variants", union_sql([
    f"SELECT l_orderkey, l_linenumber, {i}::INT AS variant_id, least(greatest(price, {2000.0 * (i + 1)}), {90000.0 - 5000 * i}) AS price, "
    f"least(greatest(l_quantity, 2), {48.0 - i}) AS l_quantity FROM {_SRC}" for i in range(5)]))
def _(spark, d):
    return E.stack_variants(source(spark, d), _FIXED)


_TAIL = f"(SELECT count(*) AS n, count_if(price < 1000) AS kl, count_if(price > 104000) AS kh FROM {_SRC})"


def _loo(side, cond):
    return (f"greatest({side} / n::DOUBLE - 0.0, 0) - greatest(CASE WHEN {cond} THEN ({side} - 1) / (n - 1)::DOUBLE ELSE {side} / (n - 1)::DOUBLE END - 0.0, 0)")


def _loo_q(p):
    return f"""SELECT k0, k1, s0, s1, s2, h - k0 AS f FROM (SELECT floor({p} * (count(*) - 2)) AS k0, floor({p} * (count(*) - 2)) + 1 AS k1, {p} * (count(*) - 2) AS h FROM {_SRC}),
 LATERAL (SELECT max(CASE WHEN r = k0 THEN price END) AS s0, max(CASE WHEN r = k0 + 1 THEN price END) AS s1, max(CASE WHEN r = k0 + 2 THEN price END) AS s2
 FROM (SELECT price, row_number() OVER (ORDER BY price) - 1 AS r FROM {_SRC}))"""


@query("e10_influence_tails", f"""SELECT l_orderkey, l_linenumber, {R('1e6 * (' + _loo('kl', 'price < 1000') + ' + ' + _loo('kh', 'price > 104000') + ')', 4)} AS evi FROM {_SRC}, {_TAIL}""")
def _(spark, d):
    df = source(spark, d)
    refs = E.references(df, ["price"])
    # the quantile part vanishes under a wide tolerance, leaving the tails
    out = E.influence(df, refs, {"price": _BOUNDS[0]}, tail_tol=0.0, q_tol=1e9)
    return out.select("l_orderkey", "l_linenumber", rd(F.col("evi_price") * 1e6, 4).alias("evi"))


_LOO5 = "(CASE WHEN price <= a.s0 THEN a.s1 ELSE a.s0 END * (1 - a.f) + CASE WHEN price <= a.s1 THEN a.s2 ELSE a.s1 END * a.f)"
_LOO95 = _LOO5.replace("a.", "b.")


@query("e11_influence_quantiles", f"""SELECT l_orderkey, l_linenumber, {R(f'-1e6 * 0.5 * (abs({_LOO5} - q05) / iqr + abs({_LOO95} - q95) / iqr)', 3)} AS evi
FROM {_SRC}, ({_loo_q(0.05)}) a, ({_loo_q(0.95)}) b, {_ref('price')}""")
def _(spark, d):
    df = source(spark, d)
    out = E.influence(df, E.references(df, ["price"]), {}, q_tol=0.0)
    return out.select("l_orderkey", "l_linenumber", rd(F.col("evi_price") * 1e6, 3).alias("evi"))


@query("e12_influence_total")
def _(spark, d):
    df = source(spark, d)
    out = E.influence(df, E.references(df, _COLS), {b.col: b for b in _BOUNDS}, tail_tol=0.0, q_tol=0.0)
    return out.select("l_orderkey", "l_linenumber", *[rd(F.col(c) * 1e6, 3).alias(c) for c in ("evi_price", "evi_l_quantity", "evi_total")])


def _res_sql(col, expr, lo_b, hi_b, tag):
    tl = f"avg(({expr} < {lo_b})::INT)" if lo_b is not None else "0"
    th = f"avg(({expr} > {hi_b})::INT)" if hi_b is not None else "0"
    return (f"SELECT '{col}' AS col, {tl} AS tail_lo, {th} AS tail_hi, abs(quantile_cont({expr}, 0.05) - max(q05)) / max(iqr) AS q05_dev, "
            f"abs(quantile_cont({expr}, 0.95) - max(q95)) / max(iqr) AS q95_dev FROM {_SRC}, {_ref(col)}")


@query("e13_residual_table", "WITH r AS (" + union_sql([
    _res_sql("price", "price", 1000.0, 104000.0, "b"), _res_sql("l_quantity", "l_quantity", None, 49.0, "b")]) + """), u AS (UNPIVOT (SELECT col, tail_lo::DOUBLE AS tail_lo, tail_hi::DOUBLE AS tail_hi, q05_dev, q95_dev FROM r)
 ON tail_lo, tail_hi, q05_dev, q95_dev INTO NAME "constraint" VALUE residual_before)
SELECT col, "constraint", CASE WHEN "constraint" LIKE 'tail%' THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, """ + R("residual_before") + """ AS residual_before,
 CASE WHEN "constraint" LIKE 'tail%' THEN 0.05 ELSE 0.2 END::DOUBLE AS tolerance FROM u""")
def _(spark, d):
    got = E.condition(source(spark, d), _COLS, _BOUNDS).residual_table()
    return rounded(got.select("col", "constraint", "weight", "residual_before", "tolerance"), ["residual_before"])


@query("e14_condition_best")
def _(spark, d):
    c = E.condition(source(spark, d), _COLS, _BOUNDS)
    return rounded(c.variant(c.best), _COLS, 4)


# ---- ledger and replay -------------------------------------------------------

def _history(spark, d):
    src = source(spark, d).withColumn("tax", F.expr("CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity / 100 END"))
    a = L.Asset.start(src)
    a = a.apply("handle_missing_values", {"method": "constant", "fill_value": 0.25, "columns": ["tax"]})
    a = a.apply("create_derived_column", {"name": "unit", "expression": "price / l_quantity"})
    a = a.apply("remove_outliers", {"steps": [{"column": "price", "lo": 0.0, "hi": 200000.0}]})
    a = a.apply("normalize_scale", normalize.fit(a.df, "minmax", ["l_quantity"]))
    a = a.apply("manage_columns", {"columns_final": ["l_orderkey", "l_linenumber", "l_quantity", "tax", "unit"], "rename_map": {"unit": "unit_price"}})
    return src, a


@query("e31_ledger", """SELECT * FROM (VALUES (0, 'load_dataset', 5), (1, 'handle_missing_values', 5), (2, 'create_derived_column', 6),
 (3, 'remove_outliers', 6), (4, 'normalize_scale', 6), (5, 'manage_columns', 5)) t(step, operation, cols), """
       f"""LATERAL (SELECT CASE WHEN step < 3 THEN count(*) ELSE count_if(price <= 200000) END AS "rows" FROM {_SRC})""")
def _(spark, d):
    return _history(spark, d)[1].frame().select("step", "operation", "cols", "rows")


@query("e32_replay", f"""WITH k AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN 0.25 ELSE l_quantity / 100 END AS tax, price / l_quantity AS unit_price FROM {_SRC} WHERE price <= 200000)
SELECT l_orderkey, l_linenumber, {R('(l_quantity - (SELECT min(l_quantity) FROM k)) / (SELECT max(l_quantity) - min(l_quantity) FROM k)')} AS l_quantity, {R('tax')} AS tax, {R('unit_price', 7)} AS unit_price FROM k""")
def _(spark, d):
    src, a = _history(spark, d)
    return rounded(rounded(L.replay(src, a.ledger), ["l_quantity", "tax"]), ["unit_price"], 7)


@query("e33_replay_conditioning", f"SELECT l_orderkey, l_linenumber, {R('2000 + 88000 * (0.5 + 0.5 * tanh((price - 46000) / (0.05 * 88000)))', 3)} AS price, l_quantity FROM {_SRC}")
def _(spark, d):
    src = source(spark, d)
    step = L.Asset.start(src).apply("conditioning", {"kind": "soft_clamp", "softness": 0.05, "columns": {"price": [2000.0, 90000.0]}})
    return rounded(L.replay(src, step.ledger), ["price"], 3)


@query("e34_steps_by_operation", "SELECT operation, 1::BIGINT AS n_steps FROM (VALUES ('load_dataset'), ('handle_missing_values'), ('create_derived_column'), ('remove_outliers'), ('normalize_scale'), ('manage_columns')) t(operation)")
def _(spark, d):
    return L.steps_by_operation(_history(spark, d)[1].frame())


@query("e34_rows_removed", f"""SELECT step, operation, CASE WHEN step = 3 THEN (SELECT count_if(price > 200000) FROM {_SRC}) ELSE 0 END AS removed
FROM (VALUES (1, 'handle_missing_values'), (2, 'create_derived_column'), (3, 'remove_outliers'), (4, 'normalize_scale'), (5, 'manage_columns')) t(step, operation)""")
def _(spark, d):
    return L.rows_removed(_history(spark, d)[1].frame())


@query("e34_derived_names", "SELECT 2 AS step, 'unit' AS name")
def _(spark, d):
    return L.derived_names(_history(spark, d)[1].frame())


@query("e34_last_steps", "SELECT * FROM (VALUES (5, 'manage_columns'), (4, 'normalize_scale'), (3, 'remove_outliers')) t(step, operation)")
def _(spark, d):
    return L.last_steps(_history(spark, d)[1].frame(), 3).select("step", "operation")
