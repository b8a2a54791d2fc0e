"""Queries: the column transforms, one per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transform as T
from .base import R, query, rd, table
from .tables import line

# a column running through both signs, with gaps and infinities
_IN = ("CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 501 = 1 THEN {inf} "
       "ELSE l_quantity / 10 - 2.5 + l_discount END")
_SRC = f"(SELECT l_orderkey, l_linenumber, {_IN.format(inf='NULL')} AS raw, coalesce({_IN.format(inf='NULL')}, 0) AS x FROM lineitem)"


def source(spark, d):
    return line(spark, d).selectExpr("l_orderkey", "l_linenumber", f"{_IN.format(inf='NULL')} AS x")


def _clip(lo, hi):
    return f"greatest(least(x, {hi}), {lo})"


# key -> SQL over the cleaned x (no infinities in this input)
_ROWWISE = {
    "original": "x", "absolute": "abs(x)", "negative": "-x", "square": "x * x", "cube": "x * x * x",
    "sqrt": "sqrt(greatest(x, 0))", "cbrt": "cbrt(x)", "fourth_root": "greatest(x, 0) ** 0.25",
    "reciprocal": "CASE WHEN abs(x) > 2.3e-16 THEN 1 / x ELSE 0 END",
    "inv_square": "CASE WHEN x * x > 1e-8 THEN 1 / (x * x) ELSE 0 END",
    "inv_cube": "CASE WHEN abs(x * x * x) > 1e-8 THEN 1 / (x * x * x) ELSE 0 END",
    "log1p": "ln(1 + greatest(x, -1 + 1e-9))", "expm1": "exp(x) - 1", "sign": "sign(x)::DOUBLE",
    "binarize": "CASE WHEN x > (SELECT quantile_cont(x, 0.5) FROM s) THEN 1.0 ELSE 0.0 END",
    "weibull": "exp(-(greatest(x, 0) * greatest(x, 0)))", "pow_025": "sign(x) * abs(x) ** 0.25", "pow_033": "cbrt(greatest(x, 0))",
    "pow_05": "sqrt(greatest(x, 0))", "pow_2": "x ** 2", "pow_3": "x * x * x", "pow_4": "x ** 4",
    "log_nat": "ln(greatest(x, 1e-8))", "log2": "log2(greatest(x, 1e-8))", "log10": "log10(greatest(x, 1e-8))",
    "log_exp": "ln(1 + exp(x))", "log_log": "ln(ln(greatest(x + 1.1, 1.1)))",
    "log_norm": "ln(greatest(x + 1, 1e-8)) / (SELECT ln(max(x) + 1) FROM s)",
    "inv_log": "1 / (1 + exp(-x))", "shifted_log": "ln(greatest(x + 2, 1e-8))", "exp": "exp(x)", "exp2": "2 ** x",
    "expm1_exp": "exp(x) - 1", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)",
    "arcsin": f"asin({_clip(-1, 1)})", "arccos": f"acos({_clip(-1, 1)})", "arctan": "atan(x)",
    "sinh": "(exp(x) - exp(-x)) / 2", "cosh": "(exp(x) + exp(-x)) / 2", "tanh": "tanh(x)",
    "gen_hyp": "ln((exp(x) + exp(-x)) / 2)", "arcsinh": "asinh(x)", "arccosh": "acosh(greatest(x, 1))",
    "arctanh": f"atanh({_clip('-1 + 1e-9', '1 - 1e-9')})", "sigmoid": "1 / (1 + exp(-x))",
    "logit": f"ln({_clip(1e-8, '1 - 1e-8')} / (1 - {_clip(1e-8, '1 - 1e-8')}))",
    "softmax": "1e4 * exp(x - (SELECT max(x) FROM s)) / (SELECT sum(exp(x - (SELECT max(x) FROM s))) FROM s)",
    "gaussian": "exp(-(x * x))", "zscore": "(x - (SELECT avg(x) FROM s)) / (SELECT stddev_pop(x) FROM s)",
    "rank": "rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0",
    "pct_rank": "(rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / (SELECT count(*) FROM s)",
    "minmax": "(x - (SELECT min(x) FROM s)) / (SELECT max(x) - min(x) FROM s)",
    "standard": "(x - (SELECT avg(x) FROM s)) / (SELECT stddev_pop(x) FROM s)",
    "robust": "(x - (SELECT quantile_cont(x, 0.5) FROM s)) / (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) + 1e-9 FROM s)",
}
# results far from one in size are compared with fewer decimals
_DIGITS = {"inv_cube": 0, "inv_square": 2, "pow_4": 5, "reciprocal": 4, "arctanh": 4, "logit": 4, "tan": 3}


def _register(i: int, key: str, expr: str):
    digits = _DIGITS.get(key, 6)

    @query(f"t{i:02d}_{key}", f"WITH s AS (SELECT * FROM {_SRC}) SELECT l_orderkey, l_linenumber, "
           f"{R(expr, digits)} AS y FROM s")
    def _(spark, d):
        out = T.transform(source(spark, d), key, ["x"])
        y = F.col(f"x_{key}") * (1e4 if key == "softmax" else 1.0)
        return out.select("l_orderkey", "l_linenumber", rd(y, digits).alias("y"))


for _i, (_key, _expr) in enumerate(_ROWWISE.items(), 1):
    _register(_i, _key, _expr)


@query("t01_infinity_and_nan", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 0.0 WHEN l_orderkey % 5 = 0 THEN 1e10
 WHEN l_orderkey % 3 = 0 THEN -1e10 ELSE l_tax END AS y FROM lineitem""")
def _(spark, d):
    df = line(spark, d).selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN double('NaN') WHEN l_orderkey % 5 = 0 THEN double('Infinity') "
        "WHEN l_orderkey % 3 = 0 THEN double('-Infinity') ELSE l_tax END AS x")
    return T.transform(df, "original", ["x"]).select("l_orderkey", "l_linenumber", F.col("x_original").alias("y"))


_EMA_IN = "CASE WHEN event_id % 10 < 3 THEN NULL ELSE value END"


@query("t57_ema", f"""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, coalesce({_EMA_IN}, 0) AS x FROM events)
SELECT a.event_id, {R('sum(b.x * (2.0::DOUBLE / 3) ** (a.pos - b.pos) * CASE WHEN b.pos = 0 THEN 1.0 ELSE 1.0::DOUBLE / 3 END)')} AS y
FROM e a JOIN e b ON b.pos BETWEEN a.pos - 100 AND a.pos GROUP BY 1""")
def _(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", f"{_EMA_IN} AS x")
    return T.transform(df, "ema", ["x"], order_by=["event_id"]).select("event_id", rd("x_ema").alias("y"))


@query("t58_boxcox_fixed", f"""WITH s AS (SELECT * FROM {_SRC}) SELECT l_orderkey, l_linenumber,
 {R('((x - (SELECT min(x) FROM s) + 1) ** 0.4 - 1) / 0.4')} AS y FROM s""")
def _(spark, d):
    return T.transform(source(spark, d), "boxcox", ["x"], lam=0.4).select("l_orderkey", "l_linenumber", rd("x_boxcox").alias("y"))


@query("t58_boxcox_mle")
def _(spark, d):
    return T.transform(source(spark, d), "boxcox", ["x"]).select("l_orderkey", "l_linenumber", rd("x_boxcox", 4).alias("y"))


@query("t59_yeojohnson_fixed", f"""WITH s AS (SELECT * FROM {_SRC}) SELECT l_orderkey, l_linenumber,
 {R('CASE WHEN x >= 0 THEN ((x + 1) ** 0.7 - 1) / 0.7 ELSE -((1 - x) ** 1.3 - 1) / 1.3 END')} AS y FROM s""")
def _(spark, d):
    return T.transform(source(spark, d), "yeojohnson", ["x"], lam=0.7).select("l_orderkey", "l_linenumber", rd("x_yeojohnson").alias("y"))


@query("t59_yeojohnson_mle")
def _(spark, d):
    return T.transform(source(spark, d), "yeojohnson", ["x"]).select("l_orderkey", "l_linenumber", rd("x_yeojohnson", 4).alias("y"))


@query("t60_quantile")
def _(spark, d):
    return T.transform(source(spark, d), "quantile", ["x"]).select("l_orderkey", "l_linenumber", rd("x_quantile").alias("y"))


_PLACE = {
    "log": "CASE WHEN raw > 0 THEN ln(raw) END", "log1p": "CASE WHEN raw > -1 THEN ln(1 + raw) END",
    "sqrt": "CASE WHEN raw >= 0 THEN sqrt(raw) END", "square": "raw * raw", "reciprocal": "CASE WHEN raw <> 0 THEN 1 / raw END",
    "standardize": "(raw - (SELECT avg(raw) FROM s)) / (SELECT stddev_samp(raw) FROM s)",
    "minmax": "(raw - (SELECT min(raw) FROM s)) / (SELECT max(raw) - min(raw) FROM s)",
}
for _key, _expr in _PLACE.items():
    @query(f"t61_in_place_{_key}", f"WITH s AS (SELECT * FROM {_SRC}) SELECT l_orderkey, l_linenumber, {R(_expr, 4)} AS x FROM s")
    def _(spark, d, key=_key):
        out = T.transform(source(spark, d), key, ["x"], in_place=True)
        return out.select("l_orderkey", "l_linenumber", F.when(~F.isnan("x"), rd("x", 4)).alias("x"))
