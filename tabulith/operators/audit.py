"""Audits: is a target recoverable from proxies, or learned through a shortcut?"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import drop_missing, fin, q, rows_frame, value
from . import models as M

# fixed values: thresholds and least row counts
RECOVER_R2, MIN_RECOVER_ROWS = 0.80, 20
PROXY_R2, MIN_DROP, MIN_SHORTCUT_ROWS, FOLDS = 0.75, 0.25, 30, 5

#: The five audit learners.
LEARNERS: dict[str, Callable[..., M.Fitted]] = {
    "linear": M.linear,
    "ridge": lambda p, **kw: M.ridge(p, alpha=1.0),
    "lasso": lambda p, **kw: M.lasso(p, alpha=1.0),
    "random_forest": M.random_forest,
    "gradient_boosting": M.gradient_boosting,
}


def recoverability(df: DataFrame, target: str, proxies: Sequence[str], key: Sequence[str], learner: str = "ridge",
                   threshold: float = RECOVER_R2, folds: int = FOLDS, by: Column | None = None, standardize: bool = True, **kw) -> DataFrame:
    """Out-of-fold R2, RMSE and MAE of the target from proxies alone, with a verdict."""
    if not proxies:
        raise ValueError("no proxy features")
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner: {learner}")
    pred = M.out_of_fold(df, proxies, target, key, LEARNERS[learner], folds, by, standardize=standardize, **kw).persist()
    n = pred.count()
    if n < MIN_RECOVER_ROWS:
        raise ValueError(f"only {n} complete rows")
    m = M.regression_metrics(pred).first()
    pred.unpersist()
    verdict = "proxy_recoverable" if m["r2"] >= threshold else "not_recoverable"
    return rows_frame(df.sparkSession, [(target, learner, n, fin(m["r2"]), fin(m["rmse"]), fin(m["mae"]), threshold, verdict)],
                      "target string, learner string, n bigint, r2 double, rmse double, mae double, threshold double, verdict string")


def _cv_r2(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], learner, folds: int, by: Column | None, **kw) -> float:
    """Mean R2 over the folds."""
    got = M.fold_metrics(M.out_of_fold(df, features, target, key, learner, folds, by, **kw)).agg(F.avg("r2")).first()[0]
    return math.nan if got is None else got


def shortcut(df: DataFrame, target: str, proxy: str, audit: Sequence[str], full: Sequence[str], key: Sequence[str],
             learner: str | Callable[..., M.Fitted] = "random_forest", folds: int = FOLDS, by: Column | None = None,
             proxy_r2: float = PROXY_R2, min_drop: float = MIN_DROP, **kw) -> DataFrame:
    """Three questions: do audit features encode the proxy, does the full model
    work, and does it still work once the proxy's linear part is removed?"""
    fn = LEARNERS[learner] if isinstance(learner, str) else learner
    needed = list(dict.fromkeys([target, proxy, *audit, *full]))
    rows = drop_missing(df.select(*[q(k) for k in key], *[q(c) for c in needed if c not in key]), needed)
    line = rows.agg(F.count("*").alias("n"), F.regr_slope(value(rows, target), value(rows, proxy)).alias("k"),
                    F.regr_intercept(value(rows, target), value(rows, proxy)).alias("i")).first()
    if line["n"] < MIN_SHORTCUT_ROWS:
        raise ValueError(f"only {line['n']} complete rows")
    rows = rows.withColumn("__res", q(target) - (F.lit(line["i"] or 0.0) + F.lit(line["k"] or 0.0) * q(proxy)))
    r_proxy = _cv_r2(rows, audit, proxy, key, fn, folds, by, **kw)
    r_full = _cv_r2(rows, full, target, key, fn, folds, by, **kw)
    r_res = _cv_r2(rows, audit, "__res", key, fn, folds, by, **kw)
    rest = [c for c in full if c != proxy]
    r_rest = _cv_r2(rows, rest, target, key, fn, folds, by, **kw) if proxy in full and rest else math.nan
    drop = r_full - r_res
    if any(math.isnan(v) for v in (r_proxy, r_full, r_res)):
        verdict = "inconclusive"
    elif r_proxy >= proxy_r2:
        verdict = "shortcut" if drop >= min_drop else "partial_shortcut"
    else:
        verdict = "no_shortcut"
    return rows_frame(df.sparkSession, [(target, proxy, line["n"], fin(r_proxy), fin(r_full), fin(r_res), fin(r_rest), fin(drop), fin(r_full - r_rest), verdict)],
                      "target string, proxy string, n bigint, r2_proxy double, r2_full double, r2_residual double, r2_without_proxy double, "
                      "shortcut_drop double, ablation_drop double, verdict string")
