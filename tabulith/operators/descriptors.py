"""Symbolic features and linear searches over them.

Features are generated Columns.  One pass sums what screening needs for every
feature; one Gram per fold serves every penalised fit and subset score, so the
searches run over small matrices and never touch the rows again."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solvers
from ..functions.columns import drop_missing, fin, q, rows_frame, value
from ..functions.folds import fold
from ..functions.gram import Gram, gram, total
from ..functions.solvers import rescale

# fixed values: offsets of the guarded operations, caps and grids
EPS, BINARY_CAP, TOTAL_CAP, NAME_CAP, FOLDS = 1e-6, 30, 5000, 60, 5
RIDGE_GRID = np.logspace(-6, 6, 20)

UNARY = {
    "sq": lambda x: x * x,
    "cb": lambda x: x * x * x,
    "inv": lambda x: F.try_divide(F.lit(1.0), x + EPS),
    "abs": F.abs,
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "cbrt": lambda x: F.cbrt(F.abs(x)),
    "log": lambda x: F.ln(F.abs(x) + EPS),
    "exp": F.exp,
}
BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b + EPS),
    "abs_diff": lambda a, b: F.abs(a - b),
    "harmonic_mean": lambda a, b: F.try_divide(F.lit(2.0), F.try_divide(F.lit(1.0), a + EPS) + F.try_divide(F.lit(1.0), b + EPS)),
}
SYMMETRIC = {"add", "mul", "abs_diff", "harmonic_mean"}


def finite(c: Column) -> Column:
    """Infinite and NaN results become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


@dataclass
class Space:
    """Generated features by full name; short names are only a display map."""
    features: dict[str, Column]
    capped: bool = False
    short: dict[str, str] = field(default_factory=dict)
    #: operation and operands, by name, of the features that are made from others
    made: dict[str, tuple] = field(default_factory=dict)
    #: the columns that every chain of operations begins with
    sources: dict[str, Column] = field(default_factory=dict)

    def pick(self, names) -> Space:
        """Some of the features; ``made`` keeps what they are made from."""
        return Space({n: self.features[n] for n in names}, made=self.made, sources=self.sources)


def generate(df: DataFrame, base: Sequence[str], unary: Sequence[str] = (), binary: Sequence[str] = (),
             binary_cap: int = BINARY_CAP, total_cap: int = TOTAL_CAP) -> Space:
    """Base columns, then unary results, then binary ones over the first columns."""
    cols = {c: value(df, c).cast("double") for c in base}
    sources, made = dict(cols), {}
    for op in unary:
        cols.update({f"{op}({c})": finite(UNARY[op](value(df, c).cast("double"))) for c in base})
        made.update({f"{op}({c})": (UNARY[op], c) for c in base})
    seeds = list(cols.items())
    capped = len(seeds) > binary_cap and bool(binary)
    seeds = seeds[:binary_cap]
    for op in binary:
        pairs = list(combinations(seeds, 2) if op in SYMMETRIC else permutations(seeds, 2))
        cols.update({f"{a} {op} {b}": finite(BINARY[op](x, y)) for (a, x), (b, y) in pairs})
        made.update({f"{a} {op} {b}": (BINARY[op], a, b) for (a, _), (b, _) in pairs})
    if len(cols) > total_cap:
        cols, capped = dict(list(cols.items())[:total_cap]), True
    return Space(cols, capped, {n: n[:NAME_CAP] for n in cols}, made, sources)


def placed(df: DataFrame, space: Space, names: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with every result that the named features need as a column, and the features over those columns.

    Written out, a product of two guarded squares repeats its operands dozens of times. Here an operation reads its
    operands from columns of an earlier projection, so each is computed once a row."""
    level: dict[str, int] = {}

    def visit(n):
        if n not in level:
            operands = space.made.get(n, (None,))[1:]
            for o in operands:
                visit(o)
            level[n] = 1 + max(level[o] for o in operands) if operands else 0
    for n in names:
        visit(n)
    at = {n: f"__p{i}" for i, n in enumerate(level)}
    df = df.withColumns({at[n]: space.sources.get(n, space.features.get(n)) for n in level if level[n] == 0})
    for k in range(1, 1 + max(level.values(), default=0)):
        now = [n for n in level if level[n] == k]
        df = df.withColumns({at[n]: space.made[n][0](*[F.col(at[o]) for o in space.made[n][1:]]) for n in now})
        df = df.withColumns({at[n]: finite(F.col(at[n])) for n in now})
    return df, {n: F.col(at[n]) for n in names}


def evaluate(df: DataFrame, space: Space, keep: Sequence[str] = (), drop_useless: bool = True, chunk: int = 200) -> DataFrame:
    """The feature table; all-null and all-zero features are dropped.

    Very wide spaces are built in several projections of bounded width."""
    names = list(space.features)
    if drop_useless:
        bad = useless(df, space)
        names = [n for n in names if n not in bad]
    out, made = placed(df, space, names)
    for at in range(0, len(names), chunk):
        out = out.withColumns({f"__g{i}": made[n] for i, n in enumerate(names[at:at + chunk], at)})
    return out.select(*[q(k) for k in keep], *[F.col(f"__g{i}").alias(n) for i, n in enumerate(names)])


def evaluate_formula(df: DataFrame, name: str, expression: str) -> DataFrame:
    """One SQL formula with infinities as NULL; refuses an uninformative result."""
    c = finite(F.expr(expression).cast("double"))
    n = df.agg(F.count_if(c != 0).alias("n")).first()["n"]
    return df.withColumn(name, c if n else F.lit(None).cast("double"))


_SUMS = ("n", "nz", "sx", "sy", "sxy", "sxx", "syy")


def pair_sums(df: DataFrame, target: Column, features: Mapping[str, Column], by: Column | None = None) -> pd.DataFrame:
    """Complete-pair sums of every feature with the target per fold, in one scan.

    Sums are taken about means of a few rows, so large offsets do not cancel."""
    names = list(features)
    block = df.select((by if by is not None else F.lit(0)).cast("int").alias("g"), target.cast("double").alias("y"),
                      F.array(*[c.cast("double") for c in features.values()]).alias("x"))
    p = len(names)
    head = block.limit(1000).toPandas()
    hx = np.array(head["x"].tolist(), float) if len(head) else np.zeros((1, len(names)))
    with np.errstate(all="ignore"):
        cx = np.nan_to_num(np.nanmedian(hx, axis=0)) if len(hx) else np.zeros(len(names))
        cy = float(np.nan_to_num(np.nanmedian(head["y"].to_numpy(float)))) if len(head) else 0.0

    def part(batches):
        acc: dict = {}
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch["y"]))
            if not batch.num_rows:
                continue
            codes = batch["g"].to_numpy(zero_copy_only=False)
            raw, ys = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, p), batch["y"].to_numpy() - cy
            for g in np.unique(codes):
                m = codes == g
                r, y = raw[m], ys[m, None]
                ok = ~np.isnan(r)
                x, y = np.where(ok, r - cx, 0.0), np.where(ok, y, 0.0)
                s = np.stack([ok.sum(0), (ok & (np.nan_to_num(r) != 0)).sum(0), x.sum(0), y.sum(0), (x * y).sum(0),
                              (x * x).sum(0), (y * y).sum(0)])
                acc[g] = acc.get(g, 0) + s
        for g, s in acc.items():
            yield pa.RecordBatch.from_pydict({"g": np.full(p, g, np.int32), "j": np.arange(p, dtype=np.int32), **{k: s[i].astype(float) for i, k in enumerate(_SUMS)}})

    schema = "g int, j int, " + ", ".join(f"{k} double" for k in _SUMS)
    out = block.mapInArrow(part, schema).groupBy("g", "j").agg(*[F.sum(k).alias(k) for k in _SUMS]).toPandas()
    out["feature"] = [names[j] for j in out["j"]]
    return out.sort_values(["j", "g"])


def useless(df: DataFrame, space: Space) -> set[str]:
    df, made = placed(df, space, list(space.features))
    s = pair_sums(df, F.lit(0.0), made)
    seen = s.groupby("feature")["nz"].sum()
    return {n for n in space.features if seen.get(n, 0) == 0}


def _r2(t: pd.DataFrame) -> pd.Series:
    dx, dy = t["n"] * t["sxx"] - t["sx"] ** 2, t["n"] * t["syy"] - t["sy"] ** 2
    with np.errstate(all="ignore"):
        r = (t["n"] * t["sxy"] - t["sx"] * t["sy"]) ** 2 / (dx * dy)
    return r.where((dx > 0) & (dy > 0), 0.0)


def preselect(df: DataFrame, target: str, space: Space, k: int = 100) -> DataFrame:
    """The k features with the largest squared correlation to the target."""
    rows, made = placed(df, space, list(space.features))
    s = pair_sums(rows, value(df, target), made)
    s["r2"] = _r2(s)
    top = s.sort_values(["r2", "feature"], ascending=[False, True]).head(k)
    return rows_frame(df.sparkSession, list(zip(top["feature"], top["r2"])), "feature string, r2 double")


def screen(df: DataFrame, target: str, space: Space, key: Sequence[str] | None = None, by: Column | None = None,
           folds: int = FOLDS, threshold: float = 0.0) -> DataFrame:
    """Mean held-out R2 of a one-feature line for every feature, from fold sums."""
    by = by if by is not None else fold(list(key), folds)
    wide, made = placed(df, space, [n for n in space.features if n != target])
    s = pair_sums(wide, value(df, target), made, by)
    rows = []
    for name, t in s.groupby("feature"):
        whole, scores = t[list(_SUMS)].sum(), []
        if whole["n"] < 5 or whole["nz"] == 0:
            continue
        for _, r in t.iterrows():
            m = whole - r[list(_SUMS)]
            d = m["n"] * m["sxx"] - m["sx"] ** 2
            slope = (m["n"] * m["sxy"] - m["sx"] * m["sy"]) / d if d > 0 else 0.0
            icpt = (m["sy"] - slope * m["sx"]) / m["n"] if m["n"] else 0.0
            rss = (r["syy"] - 2 * icpt * r["sy"] - 2 * slope * r["sxy"] + 2 * icpt * slope * r["sx"] + r["n"] * icpt ** 2 + slope ** 2 * r["sxx"])
            tss = r["syy"] - r["sy"] ** 2 / r["n"]
            scores.append(1 - rss / tss if tss > 0 else 0.0)
        if np.mean(scores) >= threshold:
            rows.append((name, float(np.mean(scores))))
    rows.sort(key=lambda t: (-t[1], t[0]))
    return rows_frame(df.sparkSession, rows, "feature string, cv_r2 double")


# ---- penalised fits and searches ---------------------------------------------

def fold_grams(df: DataFrame, target: str, space: Space, key: Sequence[str] | None = None, by: Column | None = None,
               folds: int = FOLDS) -> tuple[dict, list[str]]:
    """Standardised-feature Grams per fold over complete rows, constant features left out."""
    names = [n for n in space.features if n != target]
    rows, made = placed(df, space, names)
    raw = gram(rows, made | {target: value(df, target).cast("double")}, by if by is not None else fold(list(key), folds), costly=True)
    whole = total(raw)
    sd = whole.sd(0)
    names = [n for n, s in zip(names, sd) if s > 1e-12]
    mean, scale = whole.pick([*names, target]).mean, whole.pick([*names, target]).sd(0)
    mean[-1], scale[-1] = 0.0, 1.0
    return {k: rescale(g.pick([*names, target]), mean, scale) for k, g in raw.items()}, names


@dataclass
class Fit:
    """A linear result: per-feature rows and overall scores."""
    target: str
    features: list[str]
    coef: np.ndarray
    intercept: float
    alpha: float
    cv_r2: float
    cv_rmse: float
    train_r2: float
    rows: list[tuple]
    n: float
    history: list[float] = field(default_factory=list)

    @property
    def overfit(self) -> bool:
        return len(self.features) >= self.n

    @property
    def equation(self) -> str:
        terms = [f"{'+' if c >= 0 else '-'} {abs(c):.5f} * scale(`{f}`)" for f, c, *_ in self.rows]
        return f"{self.target} = {self.intercept:.5f} " + " ".join(terms)

    def frame(self, spark) -> DataFrame:
        return rows_frame(spark, self.rows, "feature string, coefficient double, r2_single double, rmse_single double")


def _finish(folds: Mapping, target: str, names: list[str], coef: np.ndarray, b0: float, alpha: float, solve, history=()) -> Fit:
    whole: Gram = total(folds)
    chosen = [n for n, c in zip(names, coef) if c != 0]
    c = whole.pick([*names, target]).centred()
    tss, rows = c[-1, -1], []
    for i, n in enumerate(names):
        if coef[i] != 0:
            r2 = c[i, -1] ** 2 / (c[i, i] * tss) if c[i, i] > 0 and tss > 0 else 0.0
            rows.append((n, float(coef[i]), float(r2), math.sqrt(max((1 - r2) * tss / whole.n, 0.0))))
    rows.sort(key=lambda t: (-abs(t[1]), t[0]))
    rss, _, n = solvers.sse(whole, target, names, coef, b0)
    out_rss = 0.0
    for g in folds.values():
        b, i0 = solvers.fit(whole - g, target, names, solve)
        out_rss += solvers.sse(g, target, names, b, i0)[0]
    return Fit(target, chosen, coef, b0, alpha, 1 - out_rss / tss if tss > 0 else 0.0, math.sqrt(out_rss / n),
               1 - rss / tss if tss > 0 else 0.0, rows, n, list(history))


def fit_elastic(folds: Mapping, target: str, names: list[str], l1_ratio: float = 1.0, max_iter: int = 5000) -> Fit:
    """Cross-validated lasso (``l1_ratio`` 1) or elastic net from fold Grams."""
    alpha = solvers.cv_alpha(folds, target, names, l1_ratio, max_iter=max_iter)

    def solve(a, b, n):
        return solvers.elastic_net(a, b, n, alpha, l1_ratio, max_iter, 1e-8)
    b, b0 = solvers.fit(total(folds), target, names, solve)
    return _finish(folds, target, names, b, b0, alpha, solve)


def fit_ridge(folds: Mapping, target: str, names: list[str], history=()) -> Fit:
    """Ridge with the penalty of least generalised leave-one-out error."""
    xtx, xty, yty, n, _, _ = solvers.xy(total(folds), target, names)
    alpha = solvers.ridge_gcv(xtx, xty, yty, n, RIDGE_GRID)

    def solve(a, b, _n):
        return solvers.ridge(a, b, alpha)
    b, b0 = solvers.fit(total(folds), target, names, solve)
    return _finish(folds, target, names, b, b0, alpha, solve, history)


def subset_score(folds: Mapping, target: str, names: Sequence[str]) -> float:
    """Mean held-out R2 of Ridge(1) on a subset, kept inside [0, 1]."""
    if not names:
        return 0.0
    got = solvers.fold_scores(folds, target, list(names), lambda a, b, n: solvers.ridge(a, b, 1.0))
    s = float(np.mean([r for r, _ in got]))
    return max(0.0, min(1.0, s)) if math.isfinite(s) else 0.0


def greedy_forward(folds: Mapping, target: str, names: Sequence[str], max_features: int = 20) -> tuple[list[str], list[float]]:
    """Add the best feature while the score rises."""
    chosen, best, history = [], 0.0, []
    while len(chosen) < max_features:
        cand = [(subset_score(folds, target, [*chosen, n]), n) for n in names if n not in chosen]
        if not cand:
            break
        s, n = max(cand, key=lambda t: t[0])
        if s <= best:
            break
        chosen.append(n)
        best = s
        history.append(s)
    return chosen, history


def greedy_backward(folds: Mapping, target: str, names: Sequence[str], min_features: int = 1) -> tuple[list[str], list[float]]:
    """Drop the feature whose loss costs least while the score does not fall."""
    chosen = list(names)
    best = subset_score(folds, target, chosen)
    history = [best]
    while len(chosen) > min_features:
        s, n = max(((subset_score(folds, target, [c for c in chosen if c != n]), n) for n in chosen), key=lambda t: t[0])
        if s < best:
            break
        chosen.remove(n)
        best = s
        history.append(s)
    return chosen, history


def search(df: DataFrame, target: str, space: Space, direction: str = "forward", key: Sequence[str] | None = None,
           by: Column | None = None, preselect_k: int | None = None, **kw) -> Fit:
    """Preselect, search on fold Grams, refit by ridge."""
    k = preselect_k or (100 if direction == "forward" else 30)
    df = drop_missing(df, [target])
    top = [r["feature"] for r in preselect(df, target, space, k).collect()]
    small = space.pick([n for n in space.features if n in set(top)])
    folds, names = fold_grams(df, target, small, key, by)
    run = greedy_forward if direction == "forward" else greedy_backward
    chosen, history = run(folds, target, names, **kw)
    return fit_ridge({g: f.pick([*chosen, target]) for g, f in folds.items()}, target, chosen, history)


def predictions(df: DataFrame, space: Space, fit: Fit, folds: Mapping, names: list[str]) -> DataFrame:
    """Row predictions of a fitted rule as one expression."""
    whole = gram(*placed(df, space, names), costly=True)[None]
    y = F.lit(fit.intercept)
    for n, c, m, s in zip(names, fit.coef, whole.mean, whole.sd(0)):
        y = y + float(c) * (space.features[n] - float(m)) / float(s or 1.0)
    return df.withColumn("prediction", y)


def score_rows(spark, fit: Fit) -> DataFrame:
    got = [("alpha", fit.alpha), ("cv_r2", fit.cv_r2), ("cv_rmse", fit.cv_rmse), ("train_r2", fit.train_r2),
           ("n_features", float(len(fit.features))), ("overfit", float(fit.overfit)), ("valid", float(fit.cv_r2 >= -1))]
    return rows_frame(spark, [(k, fin(v)) for k, v in got], "metric string, value double")
