"""Feature ranking.  Every method returns ``feature, score`` rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import classification as mc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import contingency as ct
from ..functions import solvers, special
from ..functions.columns import agg_dict, drop_missing, fin, numeric_columns, q, rows_frame
from ..functions.folds import unit_hash
from ..functions.gram import gram
from ..functions.neighbors import distinct_points, knn, nearest, point_id
from ..functions.ordering import BLOCK, dense_index, halo, home_rows, with_ranks
from ..functions.quantiles import quantiles
from ..functions.trees import Forest
from ..functions.trees import forest as arrays
from ..session import cut_lineage, spread
from . import association as A
from . import models as M

SCORE = "feature string, score double"
# fixed values: class limits, bins and floors
CLASS_LEVELS, MAX_CLASSES, MIN_GROUP, TARGET_BINS, ENTROPY_FLOOR = 20, 50, 2, 5, 1e-3


@dataclass
class Task:
    """Complete rows with features ``x0..`` and ``label``; classes when few levels."""
    rows: DataFrame
    features: list[str]
    classes: list | None
    n: int
    key: list[str]

    @property
    def xs(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.features))]

    def out(self, spark_rows) -> DataFrame:
        rows = sorted(((f, fin(s)) for f, s in spark_rows), key=lambda t: (-(t[1] if t[1] is not None else -math.inf), t[0]))
        return rows_frame(self.rows.sparkSession, rows, SCORE)


def task(df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None, standardize: bool = True) -> Task:
    """Drop incomplete rows, encode a class target in sorted order, scale features."""
    feats = [c for c in (features or numeric_columns(df)) if c != target and c not in key]
    rows = drop_missing(df.select(*[q(k).alias(f"k{i}") for i, k in enumerate(key)],
                                  *[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(feats)], q(target).alias("y")))
    text = not isinstance(rows.schema["y"].dataType, T.NumericType)
    # a cheap sketch first: listing the values of a continuous target would shuffle all of them
    many = agg_dict(rows, {"u": F.approx_count_distinct("y")})["u"] > 2 * MAX_CLASSES
    few = [] if many else rows.select("y").distinct().collect()
    if not many and len(few) < 2:
        raise ValueError("the target has fewer than two values")
    if text and (many or len(few) > MAX_CLASSES):
        raise ValueError("the target has too many classes")
    classes = sorted(r["y"] for r in few) if text or 0 < len(few) <= CLASS_LEVELS else None
    if classes:
        label = F.lit(None)
        for i, c in enumerate(classes):
            label = F.when(F.col("y") == c, float(i)).otherwise(label)
        rows = rows.withColumn("label", label.cast("double"))
    else:
        rows = rows.withColumn("label", F.col("y").cast("double"))
    got = agg_dict(rows, {"n": F.count("*"), **{(i, s): f(f"x{i}") for i in range(len(feats)) for s, f in (("m", F.avg), ("s", F.stddev_pop))}})
    if standardize:
        rows = rows.withColumns({f"x{i}": (F.col(f"x{i}") - got[(i, "m")]) / (got[(i, "s")] or 1.0) for i in range(len(feats))})
    keys = [f"k{i}" for i in range(len(key))]
    return Task(rows.select(*keys, "label", *[f"x{i}" for i in range(len(feats))]), feats, classes, got["n"], keys)


def _dealt(t: Task) -> Task:
    """The task with its rows stored for many tasks, for what reads them again and again."""
    rows = spread(t.rows, t.n)
    return t if rows is t.rows else replace(t, rows=cut_lineage(rows))


def _prepared(t: Task, rows: DataFrame | None = None, xs: Sequence[str] | None = None) -> M.Prepared:
    """A whole-table training set for the model learners."""
    xs = list(xs or t.xs)
    rows = (rows if rows is not None else t.rows)
    rows = rows.withColumn("features", array_to_vector(F.array(*xs)))
    feats = [t.features[int(x[1:])] if x in t.xs else x for x in xs]
    return M.Prepared(rows, rows, feats, [str(c) for c in t.classes] if t.classes else None, [], [], t.n)


def _forest(p: M.Prepared, n_trees: int, max_depth: int, seed: int) -> M.Fitted:
    return M.random_forest(p, n_trees=n_trees, max_depth=max_depth, seed=seed)


# ---- model importances -------------------------------------------------------------

def tree(t: Task, max_depth: int = 30, seed: int = 42) -> DataFrame:
    return t.out(zip(t.features, M.decision_tree(_prepared(_dealt(t)), max_depth, seed=seed).importance))


def forest(t: Task, n_trees: int = 100, max_depth: int = 12, seed: int = 42) -> DataFrame:
    return t.out(zip(t.features, _forest(_prepared(_dealt(t)), n_trees, max_depth, seed).importance))


def boosting(t: Task, n_trees: int = 100, learning_rate: float = 0.1, max_depth: int = 3, seed: int = 42) -> DataFrame:
    return t.out(zip(t.features, M.gradient_boosting(_prepared(_dealt(t)), n_trees, learning_rate, max_depth, seed=seed).importance))


def xgboost(t: Task, n_trees: int = 100, learning_rate: float = 0.05, max_depth: int = 6, seed: int = 42) -> DataFrame:
    return boosting(t, n_trees, learning_rate, max_depth, seed)


def linear(t: Task) -> DataFrame:
    """Absolute coefficients: least squares, or logistic for classes."""
    p = _prepared(_dealt(t) if t.classes else t)
    return t.out(zip(t.features, (M.logistic(p) if t.classes else M.linear(p)).importance))


def svm(t: Task, C: float = 1.0, max_iter: int = 200) -> DataFrame:  # noqa: N803
    return t.out(zip(t.features, M.linear_svc(_prepared(_dealt(t)), C, max_iter).importance))


def lasso(t: Task, alpha: float = 0.01) -> DataFrame:
    p = _prepared(_dealt(t) if t.classes else t)
    return t.out(zip(t.features, (M.logistic(p, l1_ratio=1.0) if t.classes else M.lasso(p, alpha)).importance))


def ridge(t: Task, alpha: float = 1.0) -> DataFrame:
    return t.out(zip(t.features, M.ridge(_prepared(t), alpha).importance))


def elastic_net(t: Task, alpha: float = 0.01, l1_ratio: float = 0.5) -> DataFrame:
    p = _prepared(_dealt(t) if t.classes else t)
    return t.out(zip(t.features, (M.logistic(p, l1_ratio=l1_ratio) if t.classes else M.lasso(p, alpha, l1_ratio)).importance))


# ---- association with the target -----------------------------------------------------

def target_map(df: DataFrame, target: str, features: Sequence[str], method: str = "pearson") -> DataFrame:
    """Absolute correlation of each feature with a numeric target."""
    rows = drop_missing(df.select(q(target).cast("double").alias(target), *[q(f).cast("double").alias(f) for f in features]))
    fn = {"pearson": A.pearson, "spearman": A.spearman}.get(method)
    if fn:
        got = fn(rows, [target, *features]).filter(F.col("col_a") == target)
        return got.select(F.col("col_b").alias("feature"), F.abs("value").alias("score")).orderBy(F.desc("score"), "feature")
    return rows_frame(df.sparkSession, [(f, abs(A.kendall_pair(rows, f, target) or 0.0)) for f in features], SCORE)


def kendall(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    rows = drop_missing(df.select(q(target).cast("double").alias(target), *[q(f).cast("double").alias(f) for f in features]))
    return rows_frame(df.sparkSession, [(f, A.kendall_pair(rows, f, target) or 0.0) for f in features], SCORE)


def anova_f(t: Task) -> DataFrame:
    """F and p: between-class variance for classes, from r for a number target."""
    spark = t.rows.sparkSession
    if t.classes is None:
        g = gram(t.rows, {x: F.col(x) for x in t.xs} | {"label": F.col("label")})[None].corr()
        out = []
        for i, f in enumerate(t.features):
            r2, dof = g[i, -1] ** 2, t.n - 2
            stat = r2 / (1 - r2) * dof if r2 < 1 else float("inf")
            out.append((f, fin(stat), special.f_tail(stat, 1, dof)))
    else:
        grams = gram(t.rows, {x: F.col(x) for x in t.xs}, F.col("label"))
        whole = sum((g.s for g in grams.values()), np.zeros(len(t.xs)))
        n, k = sum(g.n for g in grams.values()), len(grams)
        between = sum((g.s ** 2 / g.n for g in grams.values()), np.zeros(len(t.xs))) - whole ** 2 / n
        within = sum((np.diag(g.centred()) for g in grams.values()), np.zeros(len(t.xs)))
        out = []
        for f, b, w in zip(t.features, between, within):
            stat = (b / (k - 1)) / (w / (n - k)) if w > 0 else float("nan")
            out.append((f, fin(stat), special.f_tail(stat, k - 1, n - k) if w > 0 else None))
    return rows_frame(spark, out, SCORE + ", p double")


def class_codes(t: Task, bins: int = TARGET_BINS) -> Column:
    """Class number, or equal-frequency bin of a number target."""
    return F.col("label").cast("int") if t.classes else ct.quantile_codes(t.rows, {"label": F.col("label")}, bins)["label"]


def chi_square(t: Task) -> DataFrame:
    """Observed against expected sums of min-max scaled sizes per class (unscaled task)."""
    size = {x: F.abs(F.col(x)) for x in t.xs}
    ends = agg_dict(t.rows, {(x, s): f(e) for x, e in size.items() for s, f in (("a", F.min), ("b", F.max))})
    unit = {x: (e - ends[(x, "a")]) / ((ends[(x, "b")] - ends[(x, "a")]) or 1.0) for x, e in size.items()}
    rows = t.rows.groupBy(class_codes(t).alias("c")).agg(F.count("*").alias("n"), *[F.sum(e).alias(x) for x, e in unit.items()]).collect()
    n, out = sum(r["n"] for r in rows), []
    for f, x in zip(t.features, t.xs):
        total = sum(r[x] for r in rows)
        stat = sum((r[x] - total * r["n"] / n) ** 2 / (total * r["n"] / n) for r in rows) if total > 0 else 0.0
        out.append((f, stat, special.chi2_tail(stat, len(rows) - 1)))
    return rows_frame(t.rows.sparkSession, out, SCORE + ", p double")


def _group_ranks(t: Task, code: Column, keep: Sequence[int] | None = None) -> tuple[dict, dict, dict]:
    """(group sizes, rank sums, tie sums) per feature from value counts."""
    rows = t.rows.withColumn("__c", code).filter("__c is not null")
    if keep is not None:
        rows = rows.filter(F.col("__c").isin(list(keep)))
    ranked = with_ranks(rows.select("__c", *t.xs), t.xs, extra=["cnt"])
    got = ranked.groupBy("__c").agg(F.count("*").alias("n"), *[F.sum(f"{x}_rank").alias(x) for x in t.xs],
                                    *[F.sum(F.col(f"{x}_rank_cnt").cast("double") * F.col(f"{x}_rank_cnt") - 1).alias(f"t_{x}") for x in t.xs]).collect()
    sizes = {r["__c"]: r["n"] for r in got}
    return sizes, {x: {r["__c"]: r[x] for r in got} for x in t.xs}, {x: sum(r[f"t_{x}"] for r in got) for x in t.xs}


def mann_whitney(t: Task) -> DataFrame:
    """Rank-biserial size between the first two classes, or a median split."""
    if t.classes:
        code, pair = F.col("label").cast("int"), [0, 1]
    else:
        med = quantiles(t.rows, ["label"], [0.5])["label"][0]
        code, pair = (F.col("label") > med).cast("int"), [0, 1]
    sizes, ranks, _ = _group_ranks(t, code, pair)
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if min(n0, n1) < MIN_GROUP:
        raise ValueError("a group has fewer than two rows")
    return t.out((f, abs((ranks[x][0] - n0 * (n0 + 1) / 2) / (n0 * n1) - 0.5) * 2) for f, x in zip(t.features, t.xs))


def kruskal_wallis(t: Task) -> DataFrame:
    """H with tie correction over classes or five equal-frequency bins."""
    code = class_codes(t)
    sizes = {r["c"]: r["count"] for r in t.rows.groupBy(code.alias("c")).count().collect()}
    valid = [c for c, n in sizes.items() if c is not None and n >= MIN_GROUP]
    if len(valid) < 2:
        raise ValueError("fewer than two usable groups")
    sizes, ranks, ties = _group_ranks(t, code, valid)
    n, out = sum(sizes.values()), []
    for f, x in zip(t.features, t.xs):
        h = 12 / (n * (n + 1)) * sum(r * r / sizes[c] for c, r in ranks[x].items()) - 3 * (n + 1)
        fix = 1 - ties[x] / (float(n) ** 3 - n)
        out.append((f, h / fix if fix > 0 else 0.0))
    return t.out(out)


# ---- information -------------------------------------------------------------------------

def _codes(t: Task, bins: int) -> dict[str, Column]:
    codes = ct.quantile_codes(t.rows, {x: F.col(x) for x in t.xs}, bins)
    codes["label"] = class_codes(t, bins)
    return codes


def _target_mi(t: Task, bins: int, estimator: str = "binned", k: int = 3) -> dict[str, float]:
    if estimator == "knn":
        if t.classes is not None:
            return A.knn_class_information(t.rows, t.xs, "label", k)
        return {a: v for (a, _), v in A.knn_information(t.rows, [(x, "label") for x in t.xs], k).items()}
    counts = ct.pair_counts(t.rows, _codes(t, bins), [(x, "label") for x in t.xs])
    return {r["col_a"]: r["mi"] for r in ct.mutual_information(counts).collect()}


def mutual_information(t: Task, bins: int = 10, estimator: str = "binned", k: int = 3) -> DataFrame:
    """Information about the target: of equal-frequency bins, or (``knn``) by distances to the k-th nearest neighbour."""
    mi = _target_mi(t, bins, estimator, k)
    return t.out((f, mi.get(x, 0.0)) for f, x in zip(t.features, t.xs))


def spacing_entropy(t: Task) -> dict[str, float]:
    """Differential entropy from m-spacings of the sorted column, m = sqrt(n)."""
    n = t.n
    m = max(1, int(math.sqrt(n) + 0.5))
    out = {}
    for x in t.xs:
        idx = dense_index(t.rows.select(x, *t.key), [x, *t.key], "i").select("i", x)
        ends = agg_dict(t.rows, {"a": F.min(x), "b": F.max(x)})
        blocks, w = halo(idx, "i", m, m)
        gap = F.coalesce(F.lead(x, m).over(w), F.lit(ends["b"])) - F.coalesce(F.lag(x, m).over(w), F.lit(ends["a"]))
        got = home_rows(blocks.withColumn("g", gap)).agg(F.count_if(F.col("g") <= 0).alias("z"), F.avg(F.ln(F.col("g") * n / (2.0 * m))).alias("h")).first()
        out[x] = -math.inf if got["z"] else got["h"]
    return out


def information_bottleneck(t: Task, bins: int = 10, estimator: str = "binned", k: int = 3) -> DataFrame:
    """Information about the target per unit of the feature's own entropy."""
    mi, h = _target_mi(t, bins, estimator, k), spacing_entropy(t)
    return t.out((f, mi.get(x, 0.0) / max(h[x], ENTROPY_FLOOR)) for f, x in zip(t.features, t.xs))


def mrmr(t: Task, n_features: int = 10, bins: int = 10, estimator: str = "binned", neighbors: int = 3) -> DataFrame:
    """Greedy relevance minus mean redundancy; all pair tables come from one scan (``knn``: from one search)."""
    pairs = [(a, b) for i, a in enumerate(t.xs) for b in t.xs[i + 1:]] + [(x, "label") for x in t.xs]
    if estimator == "knn":
        mi = A.knn_information(t.rows, pairs[:-len(t.xs)], neighbors) | {(x, "label"): v for x, v in _target_mi(t, bins, "knn", neighbors).items()}
    else:
        mi = {(r["col_a"], r["col_b"]): r["mi"] for r in ct.mutual_information(ct.pair_counts(t.rows, _codes(t, bins), pairs)).collect()}

    def info(a, b):
        return mi.get((a, b), mi.get((b, a), 0.0))

    k, chosen, score = min(n_features, len(t.xs)), [], {x: 0.0 for x in t.xs}
    for step in range(k):
        rest = [x for x in t.xs if x not in chosen]
        best = max(rest, key=lambda x: info(x, "label") - (np.mean([info(x, s) for s in chosen]) if chosen else 0.0))
        chosen.append(best)
        score[best] = float(k - step)
    return t.out(zip(t.features, score.values()))


def feature_clustering(t: Task, n_clusters: int | None = None, bins: int = 10, estimator: str = "binned", k: int = 3) -> DataFrame:
    """Average linkage on 1-|r| over the p x p matrix; information divided by rank inside a cluster."""
    corr = gram(t.rows, {x: F.col(x) for x in t.xs})[None].corr()
    dist, mi = 1 - np.abs(np.clip(corr, -1, 1)), _target_mi(t, bins, estimator, k)
    groups = [[i] for i in range(len(t.xs))]
    while len(groups) > (n_clusters or max(1, len(t.xs) // 3)):
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))),
                   key=lambda ij: dist[np.ix_(groups[ij[0]], groups[ij[1]])].mean())
        groups[a] += groups.pop(b)
    out = []
    for g in groups:
        for rank, i in enumerate(sorted(g, key=lambda i: -mi.get(t.xs[i], 0.0))):
            out.append((t.features[i], mi.get(t.xs[i], 0.0) / (rank + 1)))
    return t.out(out)


# ---- covariance algebra -------------------------------------------------------------------

def sparse_pca(t: Task, n_components: int = 5, alpha: float = 1.0, rounds: int = 100) -> DataFrame:
    """Mean absolute sparse loading from the correlation matrix alone."""
    g = gram(t.rows, {x: F.col(x) for x in t.xs})[None]
    work, loads = g.cov(0), []
    for _ in range(min(n_components, len(t.xs))):
        vals, vecs = np.linalg.eigh(work)
        v = vecs[:, -1]
        for _ in range(rounds):
            z = work @ v
            cut = alpha / len(t.xs) * np.abs(z).max() * 0.5
            new = np.sign(z) * np.maximum(np.abs(z) - cut, 0)
            norm = np.linalg.norm(new)
            if norm == 0:
                break
            new /= norm
            if np.abs(new - v).max() < 1e-10:
                break
            v = new
        loads.append(np.abs(v))
        work = work - (v @ work @ v) * np.outer(v, v)
    return t.out(zip(t.features, np.mean(loads, axis=0)))


def _ci(cov: np.ndarray, n: float, f: int, y: int, cond: Sequence[int]) -> tuple[float, float]:
    """(partial correlation, Fisher-z p) from a covariance matrix."""
    idx = [f, y, *cond]
    c = cov[np.ix_(idx, idx)]
    if cond:
        s = c[:2, :2] - c[:2, 2:] @ np.linalg.pinv(c[2:, 2:]) @ c[2:, :2]
    else:
        s = c
    d = math.sqrt(max(s[0, 0], 0) * max(s[1, 1], 0))
    r = max(-1 + 1e-7, min(1 - 1e-7, s[0, 1] / d if d > 0 else 0.0))
    dof = n - len(cond) - 3
    if dof <= 0:
        return r, 1.0
    return r, 2 * (1 - special.phi_cdf(abs(math.atanh(r)) * math.sqrt(dof)))


def _cov(t: Task) -> tuple[np.ndarray, float]:
    g = gram(t.rows, {x: F.col(x) for x in t.xs} | {"label": F.col("label")})[None]
    return g.cov(0), g.n


def partial_tests(t: Task) -> DataFrame:
    """Partial correlation of each feature with the target given all others."""
    cov, n = _cov(t)
    p = len(t.xs)
    out = [(f, *_ci(cov, n, i, p, [j for j in range(p) if j != i])) for i, f in enumerate(t.features)]
    return rows_frame(t.rows.sparkSession, out, "feature string, r double, p double")


def markov_blanket(t: Task, alpha: float = 0.05, max_features: int | None = None) -> DataFrame:
    """Grow by largest partial correlation, then shrink; 0/1 membership with p."""
    cov, n = _cov(t)
    p = len(t.xs)
    blanket: list[int] = []
    pv, rv = [1.0] * p, [0.0] * p
    for _ in range(max_features or p):
        best = None
        for i in (j for j in range(p) if j not in blanket):
            r, pr = _ci(cov, n, i, p, blanket)
            if best is None or abs(r) > abs(best[1]):
                best = (i, r, pr)
                rv[i], pv[i] = r, pr
        if best is None or best[2] >= alpha:
            break
        blanket.append(best[0])
    drop = []
    for m in blanket:
        rv[m], pv[m] = _ci(cov, n, m, p, [x for x in blanket if x != m])
        if pv[m] >= alpha:
            drop.append(m)
    inside = set(blanket) - set(drop)
    return rows_frame(t.rows.sparkSession, [(f, float(i in inside), rv[i], pv[i]) for i, f in enumerate(t.features)],
                      SCORE + ", r double, p double")


def bayesian_importance(t: Task, n_boot: int = 50, seed: int = 42) -> DataFrame:
    """Coefficient over its posterior (or Poisson bootstrap) deviation."""
    if t.classes is None:
        g = gram(t.rows, {x: F.col(x) for x in t.xs} | {"label": F.col("label")})[None]
        xtx, xty, yty, n, _, _ = solvers.xy(g, "label", t.xs)
        b, cov, _, _ = solvers.bayesian_ridge(xtx, xty, yty, n)
        return t.out(zip(t.features, np.abs(b) / (np.sqrt(np.diag(cov)) + 1e-12)))
    t = _dealt(t)
    p, coefs = _prepared(t), []
    train = p.train.persist()
    for s in range(n_boot):
        u = unit_hash(t.key, seed + s)
        edges, acc, term = [], 0.0, math.exp(-1)
        for k in range(8):
            acc += term
            edges.append((k, acc))
            term /= k + 1
        w = F.lit(8.0)
        for k, e in reversed(edges):
            w = F.when(u < e, float(k)).otherwise(w)
        est = mc.LogisticRegression(regParam=1 / t.n, maxIter=100, standardization=False, weightCol="w")
        coefs.append(np.abs(est.fit(train.withColumn("w", w).filter("w > 0")).coefficientMatrix.toArray()).mean(0))
    train.unpersist()
    return t.out(zip(t.features, np.mean(coefs, axis=0) / (np.std(coefs, axis=0) + 1e-12)))


# ---- permutation methods --------------------------------------------------------------------

def _laid_out(t: Task, seed: int) -> DataFrame:
    """Rows in the order of a key hash, which is a random order, with their place ``__i``; stored once.

    The value a fixed distance back in that order is a draw from a random other row. Different features and copies use
    different distances, so their shuffles are independent, and only block edges are copied between tasks."""
    return cut_lineage(dense_index(t.rows.withColumn("__h", unit_hash(t.key, seed)), ["__h", *t.key], "__i").drop("__h"))


def _step(t: Task, copy: int, i: int) -> int:
    return copy * len(t.xs) + i + 1


def with_shuffled(t: Task, laid: DataFrame, copy: int) -> DataFrame:
    """Rows with ``s0..``: each feature taken from another row, other rows for each copy."""
    steps = [_step(t, copy, i) for i in range(len(t.xs))]
    blocks, w = halo(laid, "__i", steps[-1], steps[-1])
    cols = {f"s{i}": F.coalesce(F.lag(f"x{i}", k).over(w), F.lead(f"x{i}", k).over(w), F.col(f"x{i}")) for i, k in enumerate(steps)}
    return home_rows(blocks.withColumns(cols)).drop("__i")


def boruta(t: Task, n_trials: int = 20, n_trees: int = 50, max_depth: int = 8, seed: int = 42) -> DataFrame:
    """Share of trials in which a feature beats the best shuffled copy; a trial holds one copy of each feature."""
    laid, wins = _laid_out(t, seed), np.zeros(len(t.xs))
    names = [*t.xs, *[f"s{i}" for i in range(len(t.xs))]]
    for c in range(n_trials):
        rows = spread(with_shuffled(t, laid, c), t.n).persist()
        p = _prepared(replace(t, features=[*t.features, *names[len(t.xs):]]), rows, names)
        imp = np.array(_forest(p, n_trees, max_depth, seed + c).importance)
        wins += imp[:len(t.xs)] > imp[len(t.xs):].max()
        rows.unpersist()
    return t.out(zip(t.features, wins / n_trials))


def _trees(t: Task, n_trees: int, max_depth: int, seed: int) -> Forest:
    model = _forest(_prepared(_dealt(t)), n_trees, max_depth, seed).model
    return arrays(t.rows.sparkSession, model, len(t.classes) if t.classes else 0)


def permutation_importance(t: Task, n_repeats: int = 10, n_trees: int = 50, max_depth: int = 8, seed: int = 42) -> DataFrame:
    """``feature, score, std``: mean and deviation over the repeats of the loss of accuracy (or R2) when one feature is shuffled.

    One job: a task shuffles one column of its block at a time, predicts with the trees as arrays, and returns sums."""
    trees, xs, by_class = _trees(t, n_trees, max_depth, seed), t.xs, t.classes is not None
    steps = [(c, i, _step(t, c, i)) for c in range(n_repeats) for i in range(len(xs))]
    reach = steps[-1][2]
    blocks, _ = halo(_laid_out(t, seed), "__i", reach, reach)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        home = np.flatnonzero(pdf["__home"].to_numpy())
        x, y = pdf[xs].to_numpy(float), pdf["label"].to_numpy(float)[home]

        def fit(rows):
            got = trees.predict(rows)
            return float((got.argmax(1) == y).sum()) if by_class else float(((got[:, 0] - y) ** 2).sum())

        out = [(-1, -1, fit(x[home]))]
        for c, i, k in steps:
            back, on = home - k, home + k
            rows = x[home].copy()
            rows[:, i] = x[np.where(back >= 0, back, np.where(on < len(x), on, home)), i]
            out.append((c, i, fit(rows)))
        return pd.DataFrame(out, columns=["c", "i", "s"])

    got = blocks.groupBy(BLOCK).applyInPandas(sums, "c int, i int, s double").groupBy("c", "i").agg(F.sum("s").alias("s")).collect()
    spread = 1.0 if by_class else (agg_dict(t.rows, {"v": F.var_pop("label")})["v"] or 0.0)
    score = {(r["c"], r["i"]): r["s"] / t.n if by_class else 1 - (r["s"] / t.n / spread if spread else 0.0) for r in got}
    loss = np.array([[score[-1, -1] - score[c, i] for c in range(n_repeats)] for i in range(len(xs))])
    rows = sorted(zip(t.features, loss.mean(1), loss.std(1)), key=lambda r: (-r[1], r[0]))
    return rows_frame(t.rows.sparkSession, [(f, fin(m), fin(s)) for f, m, s in rows], SCORE + ", std double")


def rfe_curve(t: Task, n_trees: int = 50, max_depth: int = 8, folds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(``feature, score`` with 1/rank, ``n_features, fold, score``) of recursive elimination."""
    rows = spread(t.rows, t.n).withColumn("fold", F.pmod(F.xxhash64(*t.key, F.lit(seed)), F.lit(folds)).cast("int")).persist()
    curve: dict[tuple, float] = {}
    for f in range(folds):
        left = list(t.xs)
        while left:
            p = _prepared(t, rows.filter(F.col("fold") != f), left)
            m = _forest(p, n_trees, max_depth, seed)
            test = m.predict(rows.filter(F.col("fold") == f).withColumn("features", array_to_vector(F.array(*left))))
            curve[(len(left), f)] = (test.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] if t.classes
                                     else M.regression_metrics(test).first()["r2"])
            left.pop(int(np.argmin(m.importance)))
    best = max(range(1, len(t.xs) + 1), key=lambda k: (np.mean([curve[(k, f)] for f in range(folds)]), -k))
    left, rank = list(t.xs), {}
    while len(left) > best:
        p = _prepared(t, rows, left)
        worst = left[int(np.argmin(_forest(p, n_trees, max_depth, seed).importance))]
        rank[worst] = len(left) - best + 1
        left.remove(worst)
    rows.unpersist()
    scores = t.out((f, 1.0 / rank.get(x, 1)) for f, x in zip(t.features, t.xs))
    return scores, rows_frame(t.rows.sparkSession, [(k, f, fin(v)) for (k, f), v in curve.items()], "n_features int, fold int, score double")


def elimination_summary(curve: DataFrame) -> DataFrame:
    """Mean and deviation per size; the best size marked (fewest on ties)."""
    per = curve.groupBy("n_features").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    top = per.agg(F.max_by("n_features", F.struct("mean", -F.col("n_features"))).alias("best"))
    return per.crossJoin(F.broadcast(top)).withColumn("is_best", F.col("n_features") == F.col("best")).drop("best")  # one row


# ---- local explanations ------------------------------------------------------------------------

def _background(t: Task, n: int, seed: int) -> list[list[float]]:
    """A bounded hash sample of feature rows."""
    share = min(1.0, 3 * n / max(t.n, 1))
    got = t.rows.filter(unit_hash(t.key, seed) < share).orderBy(unit_hash(t.key, seed)).select(*t.xs).limit(n).collect()
    return [[float(v) for v in r] for r in got]


def coalitions(p: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and kernel weights: all of them when few, else distinct random ones."""
    if 2 ** p <= n:
        z = np.array([[(k >> i) & 1 for i in range(p)] for k in range(2 ** p)])
    else:
        rng = np.random.default_rng(seed)
        z = np.unique(np.vstack([np.zeros(p, int), np.ones(p, int), rng.integers(0, 2, (n, p))]), axis=0)
    s = z.sum(1)
    w = np.array([1e6 if k in (0, p) else (p - 1) / (math.comb(p, int(k)) * k * (p - k)) for k in s])
    return z, w


#: masked rows that a task holds at a time
MASKED_ROWS = 200_000
#: rows that a task explains: each costs thousands of predictions
EXPLAINED_ROWS = 1_000


def shap(t: Task, n_trees: int = 50, max_depth: int = 8, n_bg: int = 50, n_coal: int = 150, seed: int = 42) -> DataFrame:
    """``key.., feature, phi, base`` for every row by kernel regression.

    All rows share the coalitions, so the weighted regression is one fixed linear map from the means over the background to
    the attributions. A task masks its rows and predicts in memory; nothing is shuffled."""
    trees, bg, p = _trees(t, n_trees, max_depth, seed), np.array(_background(t, n_bg, seed)), len(t.xs)
    z, w = coalitions(p, n_coal, seed)
    design = np.column_stack([np.ones(len(z)), z])
    solve = np.linalg.pinv(design * np.sqrt(w)[:, None]) * np.sqrt(w)[None, :]
    on, step, keys, xs, features = z.astype(bool), max(1, MASKED_ROWS // (len(z) * len(bg))), t.key, t.xs, t.features

    def explain(batches):
        for pdf in batches:
            x = pdf[xs].to_numpy(float)
            phi = np.empty((len(x), p + 1))
            for at in range(0, len(x), step):
                part = x[at:at + step]
                masked = np.where(on[None, :, None, :], part[:, None, None, :], bg[None, None, :, :])
                f = trees.score(masked.reshape(-1, p)).reshape(len(part), len(z), len(bg)).mean(axis=2)
                phi[at:at + step] = f @ solve.T
            out = pdf[keys].loc[pdf.index.repeat(p)].reset_index(drop=True)
            yield out.assign(base=np.repeat(phi[:, 0], p), feature=features * len(x), phi=phi[:, 1:].ravel())

    kinds = ", ".join(f"{k} {t.rows.schema[k].dataType.simpleString()}" for k in keys)
    return spread(t.rows.select(*keys, *xs), t.n, EXPLAINED_ROWS).mapInPandas(explain, f"{kinds}, base double, feature string, phi double")


def shap_scores(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("score")).orderBy(F.desc("score"), "feature")


def lime(t: Task, n_trees: int = 50, max_depth: int = 8, n_samples: int = 500, sigma: float = 1.0, n_queries: int = 20,
         seed: int = 42) -> DataFrame:
    """Mean absolute coefficient of weighted local lines around a few rows; each is disturbed and fitted where it lies."""
    trees, p = _trees(t, n_trees, max_depth, seed), len(t.xs)
    asked = [(i, x) for i, x in enumerate(_background(t, n_queries, seed))]

    def fit(batches):
        for pdf in batches:
            for i, centre in zip(pdf["i"], pdf["x"]):
                x = np.asarray(centre)[None, :] + np.random.default_rng([seed, int(i)]).normal(0, sigma, (n_samples, p))
                w = np.exp(-((x - centre) ** 2).sum(axis=1) / (2 * sigma ** 2))
                c = np.linalg.lstsq((x * w[:, None]).T @ x, (x * w[:, None]).T @ trees.score(x), rcond=None)[0]
                yield pd.DataFrame({"j": np.arange(p), "c": np.abs(c)})

    rows = rows_frame(t.rows.sparkSession, asked, "i int, x array<double>").repartition(8, "i")
    got = rows.mapInPandas(fit, "j int, c double").groupBy("j").agg(F.avg("c").alias("c")).collect()
    return t.out((t.features[r["j"]], r["c"]) for r in got)


def interactions(t: Task, n_trees: int = 50, max_depth: int = 8, seed: int = 42) -> DataFrame:
    """Summed pair interaction: variance not explained by replacing each feature alone by its mean.

    One scan: a task predicts all replacements of its rows and returns their sums and products."""
    trees, xs, p = _trees(t, n_trees, max_depth, seed), t.xs, len(t.xs)
    got = agg_dict(t.rows, {x: F.avg(x) for x in xs})
    mean = np.array([got[x] for x in xs])
    swaps = [()] + [(i,) for i in range(p)] + [(i, j) for i in range(p) for j in range(i + 1, p)]
    m = len(swaps)

    def sums(batches):
        total = np.zeros((m + 1, m + 1))
        for pdf in batches:
            x = pdf[xs].to_numpy(float)
            f = np.ones((len(x), m + 1))
            for k, s in enumerate(swaps):
                swapped = x.copy()
                swapped[:, list(s)] = mean[list(s)]
                f[:, k] = trees.score(swapped)
            total += f.T @ f
        yield pd.DataFrame({"k": np.arange(total.size), "s": total.ravel()})

    cells = spread(t.rows.select(*xs), t.n).mapInPandas(sums, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()  # one row for two replacements
    total = np.zeros((m + 1) ** 2)
    total[[r["k"] for r in cells]] = [r["s"] for r in cells]
    total = total.reshape(m + 1, m + 1) / t.n
    cov = total[:m, :m] - np.outer(total[:m, m], total[m, :m])
    at, score = {s: k for k, s in enumerate(swaps)}, [0.0] * p
    for i in range(p):
        for j in range(i + 1, p):
            v = np.zeros(m)
            v[at[()]], v[at[(i, j)]] = 1, -1
            den = float(v @ cov @ v)
            v[at[(i,)]], v[at[(j,)]] = -1, -1
            h = float(v @ cov @ v) / (den + 1e-12)
            score[i] += h
            score[j] += h
    return t.out(zip(t.features, score))


def _unit(t: Task) -> DataFrame:
    """Rows with every feature from 0 to 1 and a number of their own, ``row``."""
    ends = agg_dict(t.rows, {(x, s): f(x) for x in t.xs for s, f in (("a", F.min), ("b", F.max))})
    unit = [((F.col(x) - ends[(x, "a")]) / ((ends[(x, "b")] - ends[(x, "a")]) or 1.0)).alias(x) for x in t.xs]
    return t.rows.select(*t.key, "label", *unit)


def _asking(rows: DataFrame, key: Sequence[str], n: int, n_iter: int | None, seed: int) -> DataFrame:
    """All rows, or the first ``n_iter`` in the order of a key hash."""
    if n_iter is None or n_iter >= n:
        return rows
    return rows.filter(unit_hash(key, seed) < min(1.0, 2 * n_iter / n)).orderBy(unit_hash(key, seed), *key).limit(n_iter)


def relieff(t: Task, k: int = 10, n_iter: int | None = None, seed: int = 42) -> DataFrame:
    """Distances to the nearest hits and misses of every row (or of ``n_iter`` rows that a hash of the key chooses).

    Copies of a point are neighbours of each other. For classes each row looks for its k nearest rows in every class: the
    class is a coordinate that keeps classes farther apart than any two rows of one. For numbers each row has k neighbours;
    of copies of one point the first by key come first, and differences of the target are those of its ranks."""
    rows, n = _unit(t), t.n
    if t.classes is not None:
        return t.out(zip(t.features, _class_relief(t, rows, _asking(rows, t.key, n, n_iter, seed), k)))
    rows = with_ranks(rows, ["label"]).withColumn("label", (F.col("label_rank") - 1) / max(1, n - 1)).drop("label_rank")
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("pid", point_id(t.xs)))
    asking = _asking(rows, t.key, n, n_iter, seed)
    near = knn(distinct_points(rows, t.xs), len(t.xs), k).select("pid", F.inline("nn").alias("d", "to", "m")).drop("d")
    # the first k + 1 copies of each point, in two steps, so that no task gets all copies of a hot point
    first = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
    for part in (["pid", "salt"], ["pid"]):
        first = first.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(*t.key, "row"))).where(F.col("place") <= k + 1)
    first = cut_lineage(first.select(F.col("pid").alias("to"), "place", F.col("row").alias("other"), F.col("label").alias("y"), *[F.col(x).alias(f"o{i}") for i, x in enumerate(t.xs)]))
    own = first.select(F.col("other").alias("row"), F.col("place").alias("own"))
    pairs = asking.join(own, "row", "left").join(near, "pid").join(first, "to")
    # a row is not its own neighbour: where it is among the first copies, one more of them comes in
    among = F.coalesce((F.col("to") == F.col("pid")) & (F.col("own") <= F.col("m")), F.lit(False))
    pairs = pairs.where((F.col("place") <= F.col("m") + among.cast("int")) & (F.col("other") != F.col("row")))
    dc = F.abs(F.col("label") - F.col("y"))
    da = [F.abs(F.col(x) - F.col(f"o{i}")) for i, x in enumerate(t.xs)]
    got = agg_dict(pairs, {"c": F.sum(dc), **{("a", i): F.sum(d) for i, d in enumerate(da)}, **{("b", i): F.sum(d * dc) for i, d in enumerate(da)}})
    m, c = min(n, n_iter or n), (got["c"] or 0.0) / k
    w = [(got[("b", i)] or 0.0) / k / (c + 1e-12) - ((got[("a", i)] or 0.0) - (got[("b", i)] or 0.0)) / k / (m - c + 1e-12) for i in range(len(t.xs))]
    return t.out(zip(t.features, w))


def _class_relief(t: Task, rows: DataFrame, asking: DataFrame, k: int) -> list[float]:
    p = len(t.xs)
    far = 4.0 * (p + 1)  # no two points of the unit cube are so far apart
    xs, where = [*t.xs, "w"], (F.col("label") * far).alias("w")
    points = cut_lineage(distinct_points(rows.select(*t.xs, where), xs))
    names = [f"x{i}" for i in range(p + 1)]
    sizes = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    n, m = sum(sizes.values()), asking.count()
    # rows that are alone in their class have no hit and are passed over
    alone = [c * far for c, size in sizes.items() if size < 2]
    asked = distinct_points(asking.select(*t.xs, where), xs).where(~F.col(f"x{p}").isin(alone)) if alone else distinct_points(asking.select(*t.xs, where), xs)
    asked = asked.withColumnsRenamed({"pid": "own", f"x{p}": "home", "m": "weight"})
    asked = asked.withColumn(f"x{p}", F.explode(F.array(*[F.lit(c * far) for c in sorted(sizes)])))
    asked = cut_lineage(asked.withColumn("pid", point_id([*names, "home"])))

    def gaps(a, _pid, px, ids, _dist, mult):
        """Sums of the mean differences of each query, by its class and that of its neighbours."""
        of = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        at, m = np.array([j for i in ids for j in i], np.int64), np.array([j for i in mult for j in i], float)
        x, total = a[names].to_numpy(float), np.bincount(of, weights=m, minlength=len(a))
        far_by = {f"d{i}": np.bincount(of, weights=m * np.abs(x[of, i] - px[at, i]), minlength=len(a)) / np.maximum(total, 1) * a["weight"].to_numpy(float) for i in range(p)}
        return pd.DataFrame({"home": a["home"], "c": x[:, p], **far_by}).groupby(["home", "c"], as_index=False).sum()

    # answers stay where they are found: only sums leave a cell
    found = nearest(points, p + 1, k, gaps, "home double, c double, " + ", ".join(f"d{i} double" for i in range(p)),
                    asked.withColumn("own", F.when(F.col("home") == F.col(f"x{p}"), F.col("own"))), ("home", "weight"), within=far / 2)
    sums = found.groupBy("home", "c").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(p)]).collect()  # one row for two classes
    w = np.zeros(p)
    for r in sums:
        mine, other = round(r["home"] / far), round(r["c"] / far)
        share = -1.0 if mine == other else sizes[other] / n / (1 - sizes[mine] / n + 1e-10)
        w += share * np.array([r[f"d{i}"] for i in range(p)]) / m
    return w.tolist()


# ---- presentation ---------------------------------------------------------------------------------

def bind(scores: DataFrame, method: str, variant_id: int, fingerprint: str, contracts: str = "") -> DataFrame:
    """Scores with the variant, table hash and contract they belong to."""
    return scores.select(F.lit(method).alias("method"), "feature", "score", F.lit(variant_id).alias("variant_id"),
                         F.lit(fingerprint).alias("fingerprint"), F.lit(contracts).alias("contracts"))


def presentation(scores: DataFrame, top: int = 20) -> DataFrame:
    """Sizes relative to the largest, best first; scores with a ``std`` keep it on the same scale, as ``error``."""
    peak = scores.agg(F.max(F.abs("score")).alias("peak"))
    error = [F.coalesce(F.try_divide("std", "peak"), F.lit(0.0)).alias("error")] if "std" in scores.columns else []
    return (scores.crossJoin(F.broadcast(peak))  # one row
            .select("feature", F.coalesce(F.try_divide(F.abs("score"), F.col("peak")), F.lit(0.0)).alias("relative"), *error)
            .orderBy(F.desc("relative"), "feature").limit(top))


def grouped_importance(df: DataFrame, group: str, target: str, key: Sequence[str], features: Sequence[str], min_rows: int = 20,
                       top: int = 8, n_trees: int = 50, max_depth: int = 8, seed: int = 42) -> DataFrame:
    """Forest importances per group over features that vary in every group, L1-normalised."""
    stats = df.groupBy(q(group).alias("g")).agg(F.count("*").alias("n"), *[F.min(q(f)).alias(f"a{i}") for i, f in enumerate(features)],
                                                *[F.max(q(f)).alias(f"b{i}") for i, f in enumerate(features)]).filter(F.col("n") >= min_rows).collect()
    vary = [f for i, f in enumerate(features) if all(r[f"a{i}"] is not None and r[f"a{i}"] < r[f"b{i}"] for r in stats)]
    out = []
    for r in stats:
        t = task(df.filter(q(group) == r["g"]), target, key, vary)
        imp = np.array(_forest(_prepared(t), n_trees, max_depth, seed).importance)
        imp = imp / (imp.sum() or 1.0)
        out += [(str(r["g"]), f, float(v)) for f, v in zip(vary, imp)]
    pooled: dict[str, float] = {}
    for _, f, v in out:
        pooled[f] = pooled.get(f, 0.0) + v
    lead = set(sorted(pooled, key=lambda f: (-pooled[f], f))[:top])
    return rows_frame(df.sparkSession, [r for r in out if r[1] in lead], "grp string, feature string, score double")


METHODS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "decision_tree": ("Tree importance", tree), "random_forest": ("Forest importance", forest),
    "gradient_boosting": ("Boosting importance", boosting), "xgboost": ("Boosting importance (xgboost settings)", xgboost),
    "linear": ("Coefficients", linear), "svm": ("Margin coefficients", svm), "lasso": ("Lasso", lasso), "ridge": ("Ridge", ridge),
    "elastic_net": ("Elastic net", elastic_net), "sparse_pca": ("Sparse loadings", sparse_pca), "boruta": ("Shuffled shadows", boruta),
    "anova_f": ("Variance ratio", anova_f), "chi_square": ("Chi-square", chi_square), "mann_whitney": ("Rank-biserial", mann_whitney),
    "kruskal_wallis": ("Kruskal-Wallis", kruskal_wallis), "mutual_information": ("Mutual information", mutual_information),
    "information_bottleneck": ("Information per entropy", information_bottleneck), "mrmr": ("Relevance minus redundancy", mrmr),
    "permutation": ("Permutation loss", permutation_importance), "lime": ("Local lines", lime), "interactions": ("Interactions", interactions),
    "relieff": ("Nearest hits and misses", relieff), "feature_clustering": ("Clustered information", feature_clustering),
    "bayesian": ("Coefficient over deviation", bayesian_importance), "markov_blanket": ("Markov blanket", markov_blanket),
}
