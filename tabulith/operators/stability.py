"""Stability of scores and metrics across conditioned variants.

Score tables are small: one row per variant (and model) and feature."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import agg_dict, fin, rows_frame, value
from ..sources.writers import append_record
from . import models as M
from . import ranking as K
from .conditioning import Conditioned
from .contracts import Contract, unit_conflict

log = logging.getLogger(__name__)

# fixed values: thresholds and labels
VARIANCE_LIMIT, EFFECT_FLOOR, METRIC_STD_LIMIT, TOP_K, FLAT_VARIANCE = 0.05, 1e-4, 0.02, 10, 1e-8
STABLE, CONTINGENT, TRIVIAL = "family_stable", "contingent", "trivially_stable"
SCORES = "variant_id int, feature string, score double"


def across_variants(cond: Conditioned, fn: Callable[[DataFrame], DataFrame], on_error: str = "raise") -> DataFrame:
    """Run ``fn`` on every lazy variant and stack its rows with ``variant_id``.

    A failing variant is an error; with ``on_error="skip"`` it is passed over, unless all fail."""
    parts, errors = [], []
    for i in range(len(cond.variants)):
        try:
            parts.append(fn(cond.variant(i)).withColumn("variant_id", F.lit(i)))
        except Exception as err:
            if on_error != "skip":
                raise
            log.warning("variant %s failed: %s", i, err)
            errors.append(err)
    if not parts:
        raise RuntimeError(f"all {len(errors)} variants failed: {errors[:1]}")
    return reduce(DataFrame.unionByName, parts)


def align(scores: DataFrame) -> DataFrame:
    """Every feature in every variant, absent scores as zero."""
    ids = [r["variant_id"] for r in scores.select("variant_id").distinct().collect()]
    every = scores.select("feature").distinct().select("feature", F.explode(F.array(*[F.lit(i) for i in sorted(ids)])).alias("variant_id"))
    return every.join(scores, ["variant_id", "feature"], "left").select("variant_id", "feature", F.coalesce("score", F.lit(0.0)).alias("score"))


def labels(variance, mean_abs, limit: float = VARIANCE_LIMIT, floor: float = EFFECT_FLOOR):
    cv2 = variance / F.pow(mean_abs + 2.220446049250313e-16, F.lit(2.0))
    return F.when(mean_abs < floor, TRIVIAL).when(cv2 < limit, STABLE).otherwise(CONTINGENT)


def feature_stability(scores: DataFrame, limit: float = VARIANCE_LIMIT) -> DataFrame:
    """Per feature: variance, mean, mean size, sign agreement and label."""
    s, n = F.col("score"), F.count("*")
    pos, neg = F.count_if(s > 0), F.count_if(s < 0)
    agree = F.when((n <= 1) | ((pos == 0) & (neg == 0)), 1.0).otherwise(F.greatest(pos, neg) / n)
    got = align(scores).groupBy("feature").agg(F.coalesce(F.var_samp("score"), F.lit(0.0)).alias("variance"), F.avg("score").alias("mean"),
                                               F.avg(F.abs("score")).alias("mean_abs"), agree.alias("sign_consistency"))
    return got.withColumn("label", labels(F.col("variance"), F.col("mean_abs"), limit))


def _matrix(scores: DataFrame) -> dict[int, list[float]]:
    """Aligned scores by variant, features in name order (K x F numbers)."""
    out: dict[int, list[float]] = {}
    for r in align(scores).orderBy("variant_id", "feature").collect():
        out.setdefault(r["variant_id"], []).append(r["score"])
    return out


def tau_b(a: Sequence[float], b: Sequence[float]) -> float:
    """Rank agreement of two short vectors; 0 when undefined."""
    num = na = nb = 0
    for i, j in combinations(range(len(a)), 2):
        x, y = (a[i] > a[j]) - (a[i] < a[j]), (b[i] > b[j]) - (b[i] < b[j])
        num, na, nb = num + x * y, na + (x != 0), nb + (y != 0)
    return num / math.sqrt(na * nb) if na and nb else 0.0


def variant_agreement(scores: DataFrame) -> DataFrame:
    """``a, b, tau`` for each pair of variants."""
    m = _matrix(scores)
    return rows_frame(scores.sparkSession, [(a, b, tau_b(m[a], m[b])) for a, b in combinations(sorted(m), 2)], "a int, b int, tau double")


def mean_agreement(scores: DataFrame) -> float:
    r = variant_agreement(scores).agg(F.avg("tau")).first()[0]
    return 1.0 if r is None else r


def _top(scores: DataFrame, k: int, absolute: bool = True) -> DataFrame:
    size = F.abs("score") if absolute else F.col("score")
    w = Window.partitionBy("variant_id").orderBy(F.desc(size), "feature")
    return align(scores).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("variant_id", "feature")


def top_overlap(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """Share of the k leading features common to all variants."""
    full = align(scores)
    n = full.agg(F.count_distinct("feature").alias("f"), F.count_distinct("variant_id").alias("v")).first()
    k = min(k, n["f"])
    common = _top(scores, k).groupBy("feature").agg(F.count("*").alias("c")).filter(F.col("c") == n["v"])
    return common.agg((F.count("*") / max(k, 1)).alias("overlap"))


def top_jaccard(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """Mean pairwise overlap of the variants' leading sets."""
    sets: dict[int, set] = {}
    for r in _top(scores, k, absolute=False).collect():  # k rows per variant
        sets.setdefault(r["variant_id"], set()).add(r["feature"])
    pairs = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)]
    return rows_frame(scores.sparkSession, [(sum(pairs) / len(pairs) if pairs else 1.0,)], "jaccard double")


def metric_stability(metrics: DataFrame, limit: float = METRIC_STD_LIMIT, primary: str | None = None) -> DataFrame:
    """Mean and deviation of each metric over variants, ``delta`` its variance."""
    got = metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
                                        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("delta"))
    return got.withColumns({"label": F.when(F.col("std") < limit, STABLE).otherwise(CONTINGENT),
                            "is_primary": F.lit(False) if primary is None else F.col("metric") == primary})


def prediction_stability(cond: Conditioned, features: Sequence[str], target: str, method: str, key: Sequence[str],
                         limit: float = METRIC_STD_LIMIT, primary: str | None = None, **kw) -> DataFrame:
    """Held-out metrics of a model refitted on each variant."""
    def run(df):
        r = M.evaluate(df, features, target, method, key, **kw)
        row = r.metrics.first().asDict()
        r.prepared.release()
        return rows_frame(df.sparkSession, [(k, fin(v)) for k, v in row.items()], "metric string, value double")
    return metric_stability(across_variants(cond, run), limit, primary)


# ---- ensembles ---------------------------------------------------------------------

@dataclass(frozen=True)
class Member:
    """One scorer of an ensemble: a callable from a variant to feature scores."""
    key: str
    title: str
    fn: Callable[[DataFrame], DataFrame]
    options: Mapping = field(default_factory=dict)


def default_members(target: str, key: Sequence[str], features: Sequence[str], n_trees: int = 100, max_depth: int = 8) -> tuple[Member, ...]:
    def scorer(fn, **kw):
        return lambda df: fn(K.task(df, target, key, features), **kw)
    return (Member("lasso", "Lasso", scorer(K.lasso)), Member("rf", "Random forest", scorer(K.forest, n_trees=n_trees, max_depth=max_depth)),
            Member("xgb", "Boosted trees", scorer(K.xgboost, n_trees=n_trees, max_depth=min(6, max_depth))))


def ensemble_scores(cond: Conditioned, members: Sequence[Member]) -> DataFrame:
    """``model, variant_id, feature, score``: one scoring per member and variant."""
    if not members:
        raise ValueError("no members")
    parts = [across_variants(cond, m.fn).select(F.lit(m.key).alias("model"), "variant_id", "feature", "score") for m in members]
    return reduce(DataFrame.unionByName, parts)


def normalised(scores: DataFrame) -> DataFrame:
    """Sizes summing to one inside each (variant, model), over the union of features."""
    grid = scores.select("model", "variant_id").distinct().join(
        scores.select("feature").distinct().agg(F.collect_set("feature").alias("fs")), F.lit(True)).select("model", "variant_id", F.explode("fs").alias("feature"))
    full = grid.join(scores, ["model", "variant_id", "feature"], "left")
    size = F.abs(F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("model", "variant_id")
    return full.select("model", "variant_id", "feature", F.coalesce(F.try_divide(size, F.sum(size).over(w)), F.lit(0.0)).alias("phi"))


def variance_split(scores: DataFrame, limit: float = VARIANCE_LIMIT) -> DataFrame:
    """Within-model, between-model and total variance of the normalised scores."""
    phi = normalised(scores)
    per = phi.groupBy("feature", "model").agg(F.var_pop("phi").alias("v"), F.avg("phi").alias("m"))
    split = per.groupBy("feature").agg(F.avg("v").alias("within"), F.var_pop("m").alias("between"))
    tot = phi.groupBy("feature").agg(F.var_pop("phi").alias("total"), F.avg("phi").alias("mean_phi"))
    return split.join(tot, "feature").withColumns({
        "flat": F.col("total") < FLAT_VARIANCE, "label": labels(F.col("total"), F.abs("mean_phi"), limit)})


def averaged_by_variant(scores: DataFrame) -> DataFrame:
    return normalised(scores).groupBy("variant_id", "feature").agg(F.avg("phi").alias("score"))


# ---- proxies -----------------------------------------------------------------------------

def substitute(df: DataFrame, col_out: str, col_in: str, contracts: Sequence[Contract] = ()) -> DataFrame:
    """Put one proxy in place of another, moved to its mean and deviation."""
    warn = unit_conflict(col_out, col_in, contracts)
    if warn:
        log.warning("proxy substitution: %s", warn)
    a, b = value(df, col_out).cast("double"), value(df, col_in).cast("double")
    s = agg_dict(df, {"ma": F.avg(a), "sa": F.stddev_samp(a), "mb": F.avg(b), "sb": F.stddev_samp(b)})
    z = (b - s["mb"]) / s["sb"] if s["sb"] else b - s["mb"]
    return df.withColumn(col_out, (z * s["sa"] if s["sa"] else z) + s["ma"]).drop(col_in)


def proxy_stability(df: DataFrame, group: Sequence[str], fn: Callable[[DataFrame], DataFrame], contracts: Sequence[Contract] = (),
                    limit: float = VARIANCE_LIMIT) -> DataFrame:
    """Score stability when each other member of a group stands in for the first."""
    first, *rest = group
    parts = [fn(df.drop(*rest)).withColumn("variant_id", F.lit(0))]
    for i, alt in enumerate(rest, 1):
        others = [c for c in rest if c != alt]
        parts.append(fn(substitute(df.drop(*others), first, alt, contracts)).withColumn("variant_id", F.lit(i)))
    return feature_stability(reduce(DataFrame.unionByName, [p.select("variant_id", "feature", "score") for p in parts]), limit)


def shap_stability(cond: Conditioned, target: str, key: Sequence[str], features: Sequence[str], limit: float = VARIANCE_LIMIT, **kw) -> DataFrame:
    """Stability of mean attribution sizes."""
    return feature_stability(across_variants(cond, lambda df: K.shap_scores(K.shap(K.task(df, target, key, features), **kw))), limit)


def cite(scores: DataFrame, path: str, **kw) -> DataFrame:
    return append_record(scores, path, **kw)


