"""Model fitting and scoring on Spark ML and on Gram sums.

Every learner gives a ``Fitted`` with ``predict(df)`` adding ``prediction`` (and
``score``, the chance of the second class, when binary).  Linear learners are
solved from one Gram job and predict by expression; trees, networks and margin
learners are Spark ML estimators."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import solvers
from ..functions.columns import agg_dict, drop_missing, fin, q, rows_frame, value
from ..functions.folds import fold, unit_hash
from ..functions.gram import gram
from ..functions.neighbors import distinct_points, knn, point_id
from ..functions.ordering import running
from ..session import cut_lineage, spread

MIN_ROWS, CLASS_LEVELS, MAX_DEPTH, MAX_CLASSES = 10, 20, 30, 1000


@dataclass
class Prepared:
    """Scaled numeric columns ``x0..``, ``label`` and a split, cached."""
    train: DataFrame
    test: DataFrame
    features: list[str]
    classes: list[str] | None
    mean: list[float]
    scale: list[float]
    rows: int

    @property
    def xs(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.features))]

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def detect_task(df: DataFrame, target: str) -> str:
    """Text, or whole numbers with at most 20 levels, is a class target."""
    if not isinstance(df.schema[target].dataType, T.NumericType):
        return "classification"
    v = value(df, target).cast("double")
    got = agg_dict(df, {"frac": F.count_if(v != F.floor(v)), "u": F.approx_count_distinct(v)})
    return "classification" if not got["frac"] and got["u"] <= CLASS_LEVELS else "regression"


def prepare(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], *, task: str = "auto",
            standardize: bool = True, test_share: float = 0.2, seed: int = 42) -> Prepared:
    """Complete rows, encoded target, hash split per class, scaling fitted on train."""
    task = detect_task(df, target) if task == "auto" else task
    feats = list(features)
    rows = df.select(*[q(k).alias(f"k{i}") for i, k in enumerate(key)],
                     *[value(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(feats)], value(df, target).alias("y")).na.drop()
    keys = [f"k{i}" for i in range(len(key))]
    classes = None
    if task == "classification":
        # whole numbers print without a decimal part
        y = F.col("y").cast("string") if not isinstance(rows.schema["y"].dataType, (T.DoubleType, T.FloatType)) else \
            F.when(F.col("y") == F.floor("y"), F.col("y").cast("bigint").cast("string")).otherwise(F.col("y").cast("string"))
        if agg_dict(rows, {"u": F.approx_count_distinct(y)})["u"] > MAX_CLASSES:
            raise ValueError("the target has too many classes")
        indexer = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(rows.withColumn("y", y))
        classes = list(indexer.labels)
        rows = indexer.transform(rows.withColumn("y", y))
    else:
        rows = rows.withColumn("label", F.col("y").cast("double"))
    rows = rows.select(*keys, "label", *[f"x{i}" for i in range(len(feats))])
    u = unit_hash([*keys, "label"] if classes else keys, seed)
    train = rows.filter(u >= test_share)
    got = agg_dict(train, {"n": F.count("*"), **{(i, s): f(f"x{i}") for i in range(len(feats)) for s, f in (("m", F.avg), ("s", F.stddev_pop))}})
    if got["n"] < MIN_ROWS * (1 - test_share):
        raise ValueError(f"only {got['n']} complete training rows")
    mean = [got[(i, "m")] if standardize else 0.0 for i in range(len(feats))]
    scale = [(got[(i, "s")] or 1.0) if standardize else 1.0 for i in range(len(feats))]
    rows = rows.withColumns({f"x{i}": (F.col(f"x{i}") - mean[i]) / scale[i] for i in range(len(feats))})
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(len(feats))], outputCol="features").transform(spread(rows, got["n"]))
    return Prepared(rows.filter(u >= test_share).persist(), rows.filter(u < test_share).persist(), feats, classes, mean, scale, got["n"])


@dataclass
class Fitted:
    method: str
    features: list[str]
    classes: list[str] | None
    predict: Callable[[DataFrame], DataFrame]
    importance: list[float] | None
    state: str
    model: object = None  # the Spark ML model behind it, if there is one

    @property
    def state_hash(self) -> str:
        return hashlib.sha256(self.state.encode()).hexdigest()

    def importances(self, spark) -> DataFrame:
        imp = self.importance or [None] * len(self.features)
        return rows_frame(spark, [(f, fin(v)) for f, v in zip(self.features, imp)], "feature string, score double")


def _spark_fitted(method: str, p: Prepared, model) -> Fitted:
    """Wrap a Spark ML model."""
    binary = p.classes is not None and len(p.classes) == 2

    def predict(df):
        out = model.transform(df)
        if binary and "probability" in out.columns:
            out = out.withColumn("score", vector_to_array("probability")[1])
        elif binary and "rawPrediction" in out.columns:
            out = out.withColumn("score", vector_to_array("rawPrediction")[1])
        return out
    return Fitted(method, p.features, p.classes, predict, _importance(model), _state(model), model)


def _importance(model) -> list[float] | None:
    if hasattr(model, "models"):  # one against the rest
        parts = [_importance(m) for m in model.models]
        return np.mean(parts, axis=0).tolist() if all(x is not None for x in parts) else None
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray().tolist()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(0).tolist()
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray()).tolist()
    return None


def _state(model) -> str:
    if hasattr(model, "models"):
        return "|".join(_state(m) for m in model.models)
    if hasattr(model, "toDebugString"):
        return re.sub(r"uid=\S+", "", model.toDebugString)
    if hasattr(model, "coefficientMatrix"):
        return repr(model.coefficientMatrix.toArray().tolist())
    if hasattr(model, "weights"):
        return repr(model.weights.toArray().tolist())
    if hasattr(model, "coefficients"):
        return repr(model.coefficients.toArray().tolist())
    return type(model).__name__


# ---- linear learners from Gram sums --------------------------------------------

def _linear_fitted(method: str, p: Prepared, b: np.ndarray, b0: float) -> Fitted:
    y = F.lit(float(b0))
    for x, c in zip(p.xs, b):
        y = y + float(c) * F.col(x)
    return Fitted(method, p.features, p.classes, lambda df: df.withColumn("prediction", y), np.abs(b).tolist(),
                  repr([b0, *b.tolist()]))


def _label_gram(p: Prepared, weight: Column | None = None):
    return gram(p.train, {x: F.col(x) for x in p.xs} | {"label": F.col("label")}, weight=weight)[None]


def linear(p: Prepared, **_) -> Fitted:
    b, b0 = solvers.fit(_label_gram(p), "label", p.xs, lambda a, c, n: solvers.ols(a, c))
    return _linear_fitted("linear", p, b, b0)


def ridge(p: Prepared, alpha: float = 1.0, **_) -> Fitted:
    """Closed form; class targets become +-1 scores, largest wins."""
    if p.classes is None:
        b, b0 = solvers.fit(_label_gram(p), "label", p.xs, lambda a, c, n: solvers.ridge(a, c, alpha))
        return _linear_fitted("ridge", p, b, b0)
    sides = {f"t{k}": F.when(F.col("label") == k, 1.0).otherwise(-1.0) for k in range(len(p.classes))}
    g = gram(p.train, {x: F.col(x) for x in p.xs} | sides)[None]
    rules = [solvers.fit(g.pick([*p.xs, t]), t, p.xs, lambda a, c, n: solvers.ridge(a, c, alpha)) for t in sides]
    scores = [sum((float(w) * F.col(x) for w, x in zip(b, p.xs)), F.lit(float(b0))) for b, b0 in rules]

    def predict(df):
        best, pick = scores[0], F.lit(0.0)
        for k, s in enumerate(scores[1:], 1):
            pick, best = F.when(s > best, float(k)).otherwise(pick), F.greatest(s, best)
        out = df.withColumn("prediction", pick)
        return out.withColumn("score", scores[1]) if len(scores) == 2 else out
    imp = np.mean([np.abs(b) for b, _ in rules], axis=0).tolist()
    return Fitted("ridge", p.features, p.classes, predict, imp, repr([(b0, b.tolist()) for b, b0 in rules]))


def lasso(p: Prepared, alpha: float = 0.01, l1_ratio: float = 1.0, **_) -> Fitted:
    b, b0 = solvers.fit(_label_gram(p), "label", p.xs, lambda a, c, n: solvers.elastic_net(a, c, n, alpha, l1_ratio))
    return _linear_fitted("lasso" if l1_ratio == 1 else "elastic_net", p, b, b0)


def bayesian_ridge(p: Prepared, max_iter: int = 300, tol: float = 1e-3, **_) -> Fitted:
    xtx, xty, yty, n, mx, my = solvers.xy(_label_gram(p), "label", p.xs)
    b, _, _, _ = solvers.bayesian_ridge(xtx, xty, yty, n, max_iter, tol)
    return _linear_fitted("bayesian_ridge", p, b, my - float(b @ mx))


def naive_bayes(p: Prepared, var_smoothing: float = 1e-9, **_) -> Fitted:
    """Class means and variances from one aggregate; log likelihood as an expression."""
    top = max(agg_dict(p.train, {x: F.var_pop(x) for x in p.xs}).values())
    rows = {r["label"]: r for r in p.train.groupBy("label").agg(
        F.count("*").alias("n"), *[f(x).alias(f"{s}_{x}") for x in p.xs for s, f in (("m", F.avg), ("v", F.var_pop))]).collect()}
    total = sum(r["n"] for r in rows.values())
    like = {}
    for k, r in sorted(rows.items()):
        e = F.lit(math.log(r["n"] / total))
        for x in p.xs:
            v = r[f"v_{x}"] + var_smoothing * top
            e = e - 0.5 * math.log(2 * math.pi * v) - (F.col(x) - r[f"m_{x}"]) * (F.col(x) - r[f"m_{x}"]) / (2 * v)
        like[k] = e

    def predict(df):
        keys = list(like)
        best, pick = like[keys[0]], F.lit(float(keys[0]))
        for k in keys[1:]:
            pick, best = F.when(like[k] > best, float(k)).otherwise(pick), F.greatest(like[k], best)
        out = df.withColumn("prediction", pick)
        if len(keys) == 2:
            out = out.withColumn("score", 1 / (1 + F.exp(like[keys[0]] - like[keys[1]])))
        return out
    return Fitted("naive_bayes", p.features, p.classes, predict, None, repr({k: r.asDict() for k, r in rows.items()}))


# ---- Spark ML learners ------------------------------------------------------------

def _depth(d: int | None, default: int) -> int:
    if d and d > MAX_DEPTH:
        raise ValueError(f"trees can be at most {MAX_DEPTH} deep")
    return d or default


def logistic(p: Prepared, C: float = 1.0, max_iter: int = 1000, l1_ratio: float = 0.0, **_) -> Fitted:  # noqa: N803
    est = mc.LogisticRegression(regParam=1 / (C * p.rows), elasticNetParam=l1_ratio, maxIter=max_iter, standardization=False)
    return _spark_fitted("logistic", p, est.fit(p.train))


def decision_tree(p: Prepared, max_depth: int | None = 0, min_leaf: int = 1, seed: int = 42, **_) -> Fitted:
    kw = dict(maxDepth=_depth(max_depth, MAX_DEPTH), minInstancesPerNode=min_leaf, seed=seed)
    est = mc.DecisionTreeClassifier(**kw) if p.classes else mr.DecisionTreeRegressor(**kw)
    return _spark_fitted("decision_tree", p, est.fit(p.train))


def random_forest(p: Prepared, n_trees: int = 100, max_depth: int | None = 0, seed: int = 42, **_) -> Fitted:
    kw = dict(numTrees=n_trees, maxDepth=_depth(max_depth, 12), seed=seed)
    est = mc.RandomForestClassifier(**kw) if p.classes else mr.RandomForestRegressor(featureSubsetStrategy="all", **kw)
    return _spark_fitted("random_forest", p, est.fit(p.train))


def gradient_boosting(p: Prepared, n_trees: int = 100, learning_rate: float = 0.1, max_depth: int = 3,
                      subsample: float = 1.0, seed: int = 42, name: str = "gradient_boosting", **_) -> Fitted:
    kw = dict(maxIter=n_trees, stepSize=learning_rate, maxDepth=_depth(max_depth, 6), subsamplingRate=subsample, seed=seed)
    if p.classes is None:
        est = mr.GBTRegressor(**kw)
    else:
        est = mc.GBTClassifier(**kw)
        if len(p.classes) > 2:
            est = mc.OneVsRest(classifier=est)
    return _spark_fitted(name, p, est.fit(p.train))


def xgboost(p: Prepared, n_trees: int = 100, learning_rate: float = 0.1, max_depth: int = 3, **kw) -> Fitted:
    """Histogram boosting with the usual settings, on Spark's boosted trees."""
    return gradient_boosting(p, n_trees, learning_rate, max_depth, name="xgboost", **kw)


def lightgbm(p: Prepared, n_trees: int = 100, learning_rate: float = 0.1, max_depth: int = 5, **kw) -> Fitted:
    """31 leaves correspond to depth 5."""
    return gradient_boosting(p, n_trees, learning_rate, max_depth or 5, name="lightgbm", **kw)


def _margin_regression(rows: DataFrame, xs: Sequence[str], C: float, epsilon: float, max_iter: int, floor: float = 1e-5):  # noqa: N803
    """Least |w|^2 / 2 + C sum max(0, |y - f| - epsilon), by reweighted least squares.

    Each step bounds both halves of the loss by parabolas that touch at the last residuals, which is a
    ridge on weighted Gram sums: one scan a step, and the driver holds p x p numbers."""
    b, b0 = solvers.fit(gram(rows, {x: F.col(x) for x in xs} | {"label": F.col("label")})[None], "label", xs, lambda a, c, n: solvers.ridge(a, c, 1 / C))
    for _ in range(max_iter):
        f = F.lit(float(b0))
        for x, c in zip(xs, b):
            f = f + float(c) * F.col(x)
        r = F.col("label") - f
        up, down = 1 / F.greatest(F.abs(r - epsilon), F.lit(floor)), 1 / F.greatest(F.abs(r + epsilon), F.lit(floor))
        target = F.col("label") - epsilon * (up - down) / (up + down)
        g = gram(rows, {x: F.col(x) for x in xs} | {"label": target}, weight=(up + down) / 2)[None]
        new, new0 = solvers.fit(g, "label", xs, lambda a, c, n: solvers.ridge(a, c, 1 / C))
        moved = max(float(np.abs(new - b).max(initial=0.0)), abs(new0 - b0))
        b, b0 = new, new0
        if moved < 5e-4 * (1 + float(np.abs(b).max(initial=0.0))):
            break
    return b, b0


def linear_svc(p: Prepared, C: float = 1.0, max_iter: int = 200, epsilon: float = 0.0, **_) -> Fitted:  # noqa: N803
    """Linear margin learner; a number target takes the epsilon-insensitive loss."""
    if p.classes is None:
        return _linear_fitted("linear_svr", p, *_margin_regression(p.train, p.xs, C, epsilon, max_iter))
    est = mc.LinearSVC(regParam=1 / (C * p.rows), maxIter=max_iter, standardization=False)
    est = est if len(p.classes) == 2 else mc.OneVsRest(classifier=est)
    return _spark_fitted("linear_svc", p, est.fit(p.train))


def kernel_svm(p: Prepared, C: float = 1.0, gamma: float | None = None, n_features: int = 100, seed: int = 42, epsilon: float = 0.1, **_) -> Fitted:  # noqa: N803
    """RBF margin learner on random cosine features; a number target takes the epsilon-insensitive loss."""
    k = len(p.xs)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, math.sqrt(2 * (gamma or 1.0 / k)), (k, n_features))
    off = rng.uniform(0, 2 * math.pi, n_features)

    @F.pandas_udf("array<double>")
    def lift(*cols: pd.Series) -> pd.Series:
        z = np.sqrt(2 / n_features) * np.cos(np.column_stack([c.to_numpy(float) for c in cols]) @ w + off)
        return pd.Series(list(z))

    def lifted(df):
        return df.withColumn("features", array_to_vector(lift(*p.xs)))

    train = lifted(p.train)
    if p.classes is None:
        zs = [f"z{i}" for i in range(n_features)]

        def spread(df):
            return df.withColumn("__z", lift(*p.xs)).withColumns({z: F.col("__z")[i] for i, z in enumerate(zs)}).drop("__z")

        rows = spread(p.train).select("label", *zs).persist()
        b, b0 = _margin_regression(rows, zs, C, epsilon, 40)
        rows.unpersist()

        def predict(df):
            out = df.withColumn("__z", lift(*p.xs))
            y = F.aggregate(F.zip_with("__z", F.array(*[F.lit(float(v)) for v in b]), lambda x, w: x * w), F.lit(float(b0)), lambda a, v: a + v)
            return out.withColumn("prediction", y).drop("__z")
        return Fitted("kernel_svm", p.features, None, predict, None, repr([float(b0), *map(float, b)]))
    est = mc.LinearSVC(regParam=1 / (C * p.rows), maxIter=100, standardization=False)
    model = (est if len(p.classes) == 2 else mc.OneVsRest(classifier=est)).fit(train)
    inner = _spark_fitted("kernel_svm", p, model)
    return Fitted("kernel_svm", p.features, p.classes, lambda df: inner.predict(lifted(df)), None, inner.state)


def mlp(p: Prepared, hidden: Sequence[int] = (100, 50), max_iter: int = 200, seed: int = 42, **_) -> Fitted:
    layers = [len(p.xs), *hidden, len(p.classes)]
    return _spark_fitted("mlp", p, mc.MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed).fit(p.train))


def _stump(model) -> Callable[[], Column]:
    """A depth-one tree as an expression, read from its printed rule."""
    text = model.toDebugString
    leaves = [float(v) for v in re.findall(r"Predict: (-?[\d.E+-]+)", text)]
    rule = re.search(r"If \(feature (\d+) <= (-?[\d.E+-]+)\)", text)
    if not rule or len(leaves) < 2:
        return lambda: F.lit(leaves[0])
    return lambda: F.when(F.col(f"x{rule.group(1)}") <= float(rule.group(2)), leaves[0]).otherwise(leaves[1])


def adaboost(p: Prepared, n_rounds: int = 50, learning_rate: float = 1.0, seed: int = 42, **_) -> Fitted:
    """Boosted stumps; weights are an expression over past stumps, so no state grows."""
    if p.classes is None:
        return _adaboost_regression(p, n_rounds, learning_rate, seed)
    k = len(p.classes)
    rules: list[tuple[float, Callable[[], Column]]] = []
    power = F.lit(0.0)
    for r in range(n_rounds):
        data = p.train.withColumn("w", F.exp(power))
        scale = data.agg(F.avg("w")).first()[0]
        data = data.withColumn("w", F.col("w") / scale)
        rule = _stump(mc.DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=seed + r).fit(data))
        miss = (rule() != F.col("label")).cast("double")
        got = agg_dict(data, {"e": F.sum(F.col("w") * miss), "t": F.sum("w")})
        err = got["e"] / got["t"]
        if err >= 1 - 1 / k:
            break
        alpha = learning_rate * (math.log((1 - err) / max(err, 1e-10)) + math.log(k - 1)) if k > 1 else 1.0
        rules.append((alpha, rule))
        if err <= 1e-10:
            break
        power = power + alpha * miss
    votes = [sum((F.when(rule() == c, a).otherwise(0.0) for a, rule in rules), F.lit(0.0)) for c in range(k)]

    def predict(df):
        best, pick = votes[0], F.lit(0.0)
        for c, v in enumerate(votes[1:], 1):
            pick, best = F.when(v > best, float(c)).otherwise(pick), F.greatest(v, best)
        out = df.withColumn("prediction", pick)
        return out.withColumn("score", votes[1] / sum(votes, F.lit(0.0))) if k == 2 else out
    return Fitted("adaboost", p.features, p.classes, predict, None, repr([a for a, _ in rules]))


def _adaboost_regression(p: Prepared, n_rounds: int, learning_rate: float, seed: int) -> Fitted:
    """Linear-loss boosting of depth-3 trees; prediction is the weighted median."""
    models, betas = [], []

    def errors(df):
        for i, m in enumerate(models):
            df = m.setPredictionCol(f"p{i}").transform(df)
        return df

    # the weight is a stored column, so a round reads one table and applies one tree
    data = cut_lineage(p.train.withColumn("w", F.lit(1.0)))
    for r in range(n_rounds):
        model = mr.DecisionTreeRegressor(maxDepth=3, weightCol="w", seed=seed + r).fit(data)
        scored = model.setPredictionCol("__p").transform(data).withColumn("__e", F.abs(F.col("__p") - F.col("label")))
        got = agg_dict(scored, {"peak": F.max("__e"), "l": F.sum(F.col("w") * F.col("__e")), "t": F.sum("w")})
        peak = got["peak"] or 1.0
        avg = got["l"] / peak / got["t"]
        if avg >= 0.5 and models:
            break
        models.append(model)
        beta = max(avg / (1 - avg), 1e-10) if avg < 0.5 else 0.999
        betas.append((beta, peak))
        if avg <= 0 or r == n_rounds - 1:
            break
        data = cut_lineage(scored.withColumn("w", F.col("w") * F.pow(F.lit(beta), (1 - F.col("__e") / peak) * learning_rate)).drop("__p", "__e"))
    alphas = [learning_rate * math.log(1 / b) for b, _ in betas]

    def predict(df):
        out = errors(df)
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"p{i}").alias("v"), F.lit(a).alias("a")) for i, a in enumerate(alphas)]))
        half = sum(alphas) / 2
        med = F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v")),
                          lambda acc, t: F.struct((acc["s"] + t["a"]).alias("s"),
                                                  F.when(acc["v"].isNull() & (acc["s"] + t["a"] >= half), t["v"]).otherwise(acc["v"]).alias("v")))
        return out.withColumn("prediction", med["v"]).drop(*[f"p{i}" for i in range(len(models))])
    imp = np.average([m.featureImportances.toArray() for m in models], axis=0, weights=alphas or None).tolist()
    return Fitted("adaboost", p.features, None, predict, imp, "|".join(_state(m) for m in models))


def nearest(p: Prepared, k: int = 5, weights: str = "uniform", **_) -> Fitted:
    """k nearest training points by the cell search; copies of a point share its labels' mix."""
    n = len(p.xs)

    def predict(df):
        pts = distinct_points(p.train, p.xs)
        labels = p.train.groupBy(point_id(p.xs).alias("to"), "label").agg(F.count("*").cast("double").alias("c"))
        share = labels.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("to")))
        asked = distinct_points(df, p.xs).drop("m")
        nn = knn(pts, n, k, asked).select("pid", F.inline("nn").alias("d", "to", "m"))
        w = F.col("m") * F.col("share")
        if weights == "distance":
            w = w / F.greatest("d", F.lit(1e-12))
        votes = nn.join(share, "to").groupBy("pid", "label").agg(F.sum(w).alias("w"))
        if p.classes is not None:
            got = votes.groupBy("pid").agg(F.max_by("label", F.struct(F.col("w"), -F.col("label"))).alias("prediction"),
                                           (F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("score"))
        else:
            got = votes.groupBy("pid").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))
        return df.withColumn("pid", point_id(p.xs)).join(got, "pid", "left").drop("pid")
    return Fitted("knn", p.features, p.classes, predict, None, f"knn:{k}:{weights}")


# key -> (title, tasks, learner)
METHODS: dict[str, tuple[str, tuple[str, ...], Callable[..., Fitted]]] = {
    "linear": ("Linear regression", ("regression",), linear),
    "logistic": ("Logistic regression", ("classification",), logistic),
    "ridge": ("Ridge", ("regression", "classification"), ridge),
    "lasso": ("Lasso", ("regression",), lasso),
    "decision_tree": ("Decision tree", ("regression", "classification"), decision_tree),
    "random_forest": ("Random forest", ("regression", "classification"), random_forest),
    "gradient_boosting": ("Gradient boosting", ("regression", "classification"), gradient_boosting),
    "adaboost": ("AdaBoost", ("regression", "classification"), adaboost),
    "svm": ("Kernel margin learner", ("regression", "classification"), kernel_svm),
    "knn": ("Nearest neighbours", ("regression", "classification"), nearest),
    "mlp": ("Neural network", ("classification",), mlp),
    "naive_bayes": ("Gaussian naive Bayes", ("classification",), naive_bayes),
    "bayesian_ridge": ("Bayesian ridge", ("regression",), bayesian_ridge),
    "xgboost": ("Boosted trees (xgboost settings)", ("regression", "classification"), xgboost),
    "lightgbm": ("Boosted trees (lightgbm settings)", ("regression", "classification"), lightgbm),
}


def compatible(df: DataFrame, target: str) -> DataFrame:
    """Which methods suit the target: ``method, task, suitable``."""
    task = detect_task(df, target)
    return rows_frame(df.sparkSession, [(k, task, task in tasks) for k, (_, tasks, _) in METHODS.items()],
                      "method string, task string, suitable boolean")


# ---- scoring -------------------------------------------------------------------------

def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, e = q(label), q(label) - q(prediction)
    got = pred.agg(F.sum(e * e).alias("rss"), (F.var_pop(y) * F.count(y)).alias("tss"), F.avg(F.abs(e)).alias("mae"), F.count(y).alias("n"))
    return got.select((1 - F.try_divide("rss", "tss")).alias("r2"), F.sqrt(F.col("rss") / F.col("n")).alias("rmse"), "mae")


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(q(label).alias("label"), q(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(pred: DataFrame, n_classes: int, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, and F1, precision and recall: of class 1 when binary, else averaged."""
    cells = confusion(pred, label, prediction)
    hit = F.col("label") == F.col("prediction")
    by_true = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("called"))
    per = by_true.join(by_pred, "label", "full").fillna(0, ["support", "tp", "called"])
    prec = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0))
    rec = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    per = per.select("label", "support", "tp", prec.alias("p"), rec.alias("r")) \
        .withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    acc = (F.sum("tp") / F.sum("support")).alias("accuracy")
    if n_classes <= 2:
        one = F.col("label") == 1
        return per.agg(acc, *[F.coalesce(F.max(F.when(one, F.col(c))), F.lit(0.0)).alias(n) for c, n in (("f", "f1"), ("p", "precision"), ("r", "recall"))])
    return per.agg(acc, F.avg("f").alias("f1"), F.avg("p").alias("precision"), F.avg("r").alias("recall"))


def roc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``threshold, fpr, tpr`` at each distinct score, from ordered running counts."""
    counts = pred.groupBy((-q(score)).alias("s")).agg(F.sum(q(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    run = running(counts, ["s"], {"tp": F.col("pos"), "all": F.col("n")}, inclusive=True)
    tot = counts.agg(F.sum("pos").alias("t_pos"), (F.sum("n") - F.sum("pos")).alias("t_neg"))
    return run.crossJoin(F.broadcast(tot)).select(  # one row
        (-F.col("s")).alias("threshold"), F.try_divide(F.col("all") - F.col("tp"), F.col("t_neg")).alias("fpr"), F.try_divide("tp", "t_pos").alias("tpr"))


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area from rank sums: the chance that a positive outscores a negative."""
    counts = pred.groupBy(q(score).alias("s")).agg(F.sum(q(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    run = running(counts, ["s"], {"neg_below": F.col("n") - F.col("pos")})
    neg = F.col("n") - F.col("pos")
    got = run.agg(F.sum(F.col("pos") * (F.col("neg_below") + neg / 2.0)).alias("w"), F.sum("pos").alias("t_pos"), F.sum(neg).alias("t_neg"))
    return got.select(F.try_divide("w", F.col("t_pos").cast("double") * F.col("t_neg")).alias("auc"))


def residual_table(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.withColumn("residual", q(label) - q(prediction))


@dataclass
class Run:
    """One fitted and scored model."""
    fitted: Fitted
    prepared: Prepared
    predictions: DataFrame
    metrics: DataFrame
    extra: dict = field(default_factory=dict)


def evaluate(df: DataFrame, features: Sequence[str], target: str, method: str, key: Sequence[str], *, task: str = "auto",
             standardize: bool = True, test_share: float = 0.2, seed: int = 42, **kw) -> Run:
    """Prepare, fit and score a method on the held-out split."""
    p = prepare(df, features, target, key, task=task, standardize=standardize, test_share=test_share, seed=seed)
    _, tasks, learner = METHODS[method]
    kind = "classification" if p.classes else "regression"
    if kind not in tasks:
        raise ValueError(f"{method} does not fit a {kind} target")
    fitted = learner(p, seed=seed, **kw)
    pred = fitted.predict(p.test)
    metrics = class_metrics(pred, len(p.classes)) if p.classes else regression_metrics(pred)
    return Run(fitted, p, pred, metrics)


# ---- out-of-fold -------------------------------------------------------------------------

def out_of_fold(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], learner: Callable[..., Fitted] = random_forest,
                folds: int = 5, by: Column | None = None, seed: int = 42, standardize: bool = True, **kw) -> DataFrame:
    """Every row predicted by a model that did not see it: ``key.., label, prediction, fold``."""
    feats = list(features)
    rows = df.select(*[q(k) for k in key], *[value(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(feats)],
                     value(df, target).cast("double").alias("label"), (by if by is not None else fold(list(key), folds, seed)).alias("fold"))
    rows = drop_missing(rows)
    if standardize:
        got = agg_dict(rows, {(i, s): f(f"x{i}") for i in range(len(feats)) for s, f in (("m", F.avg), ("s", F.stddev_pop))})
        rows = rows.withColumns({f"x{i}": (F.col(f"x{i}") - got[(i, "m")]) / (got[(i, "s")] or 1.0) for i in range(len(feats))})
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(len(feats))], outputCol="features").transform(rows).persist()
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    parts = []
    for f in sorted(sizes):
        train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        p = Prepared(train, test, feats, None, [], [], sum(sizes.values()) - sizes[f])
        parts.append(learner(p, seed=seed, **kw).predict(test).select(*[q(k) for k in key], "label", "prediction", "fold"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_metrics(pred: DataFrame) -> DataFrame:
    """R2, RMSE and MAE per fold."""
    e = F.col("label") - F.col("prediction")
    got = pred.groupBy("fold").agg(F.sum(e * e).alias("rss"), (F.var_pop("label") * F.count("*")).alias("tss"),
                                   F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))
    return got.select("fold", (1 - F.try_divide("rss", "tss")).alias("r2"), F.sqrt(F.col("rss") / F.col("n")).alias("rmse"), "mae")


def method_table() -> Mapping[str, str]:
    return {k: t for k, (t, _, _) in METHODS.items()}
