"""Outlier detectors.  Each ``fit_*`` returns parameters; ``flag`` adds ``score``
and ``is_outlier`` lazily, and removal is a filter (see sources.writers)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rows_frame, agg_dict, fin, numeric_columns, q, value
from ..functions.folds import hashed, unit_hash
from ..functions.gram import gram
from ..functions.neighbors import distinct_points, knn, nearest, point_id
from ..functions.ordering import dense_index
from ..functions.quantiles import moments, quantiles
from ..functions.special import chi2_tail
from ..plans.ledger import operation
from ..session import cut_lineage, dealt_keys

# fixed values: default thresholds
Z_LIMIT, MZ_LIMIT, IQR_K, EUCLID_LIMIT, MAHAL_LIMIT = 2.60, 19.35, 1.5, 3.0, 5.5


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    return {c: v[0] for c, v in quantiles(df, cols, [0.5]).items()}


def filled(df: DataFrame, med: dict[str, float]) -> dict[str, Column]:
    """Columns with missing read as the fitted median."""
    return {c: F.coalesce(value(df, c).cast("double"), F.lit(m)) for c, m in med.items() if m is not None}


def _flagged(df: DataFrame, score: Column, limit: float) -> DataFrame:
    s = F.coalesce(score, F.lit(0.0))
    return df.withColumns({"score": s, "is_outlier": s > limit})


# ---- column rules ---------------------------------------------------------

def fit(df: DataFrame, method: str, columns: Sequence[str] | None = None, **kw) -> dict:
    """Parameters for zscore, mzscore, iqr, euclidean or mahalanobis."""
    cols = list(columns or numeric_columns(df))
    if method == "iqr":
        lo, hi = kw.get("q1", 0.25), kw.get("q3", 0.75)
        k = kw.get("multiplier", IQR_K)
        qs = quantiles(df, cols, [lo, hi])
        return {"method": method, "fences": {c: [a - k * (b - a), b + k * (b - a)] for c, (a, b) in qs.items()},
                "null_policy": kw.get("null_policy", "drop")}
    med = medians(df, cols)
    e = filled(df, med)
    p: dict = {"method": method, "median": med}
    if method == "zscore":
        got = agg_dict(df, {(c, s): f(x) for c, x in e.items() for s, f in (("m", F.avg), ("s", F.stddev_pop))})
        p.update(mean={c: got[(c, "m")] for c in e}, sd={c: got[(c, "s")] for c in e}, limit=kw.get("threshold", Z_LIMIT))
    elif method == "mzscore":
        mads = quantiles(df, {c: F.abs(x - med[c]) for c, x in e.items()}, [0.5])
        p.update(mad={c: v[0] for c, v in mads.items()}, limit=kw.get("threshold", MZ_LIMIT))
    elif method == "euclidean":
        p.update(mean=agg_dict(df, {c: F.avg(x) for c, x in e.items()}), limit=kw.get("threshold", EUCLID_LIMIT))
    elif method == "mahalanobis":
        g = gram(df, e)[None]
        cov = g.cov(1)
        if np.linalg.matrix_rank(cov) < len(cov):
            raise ValueError("singular covariance")
        p.update(mean=dict(zip(e, g.mean.tolist())), inv=np.linalg.inv(cov).tolist(),
                 limit=kw.get("threshold", MAHAL_LIMIT))
    else:
        raise ValueError(f"unknown method: {method}")
    return p


def quadratic_form(dev: list[Column], inv) -> Column:
    """Squared distance as one expression."""
    total = F.lit(0.0)
    for i, a in enumerate(dev):
        for j in range(i, len(dev)):
            w = float(inv[i][j]) * (1.0 if i == j else 2.0)
            if w:
                total = total + F.lit(w) * a * dev[j]
    return total


def flag(df: DataFrame, p: dict) -> DataFrame:
    """Add ``score`` and ``is_outlier`` from fitted parameters (streams too)."""
    m = p["method"]
    if m == "iqr":
        out = F.lit(False)
        for c, (lo, hi) in p["fences"].items():
            v = value(df, c)
            out = out | F.coalesce((v < lo) | (v > hi), F.lit(p.get("null_policy", "drop") == "drop"))
        return df.withColumns({"score": out.cast("double"), "is_outlier": out})
    e = filled(df, p["median"])
    if m == "zscore":
        zs = [F.abs(x - p["mean"][c]) / p["sd"][c] for c, x in e.items() if p["sd"][c]]
        return _flagged(df, F.greatest(*zs, F.lit(0.0), F.lit(0.0)), p["limit"])
    if m == "mzscore":
        zs = [0.6745 * F.abs(x - p["median"][c]) / p["mad"][c] for c, x in e.items() if p["mad"][c]]
        return _flagged(df, F.greatest(*zs, F.lit(0.0), F.lit(0.0)), p["limit"])
    dev = [x - p["mean"][c] for c, x in e.items()]
    if m == "euclidean":
        return _flagged(df, F.sqrt(sum((d * d for d in dev), F.lit(0.0))), p["limit"])
    return _flagged(df, F.sqrt(F.greatest(quadratic_form(dev, p["inv"]), F.lit(0.0))), p["limit"])


@operation("remove_outliers")
def remove(df: DataFrame, params: dict) -> DataFrame:
    """Drop flagged rows; ``steps`` holds fences fitted one column after another."""
    if "steps" in params:
        for s in params["steps"]:
            v = value(df, s["column"])
            df = df.filter(v.isNull() | v.between(s["lo"], s["hi"]))
        return df
    return flag(df, params).filter(~F.col("is_outlier")).drop("score", "is_outlier")


def fit_sequential(df: DataFrame, columns: Sequence[str], method: str = "iqr", factor: float = IQR_K,
                   threshold: float = 3.0) -> dict:
    """Fences column after column on the shrinking table; missing rows stay."""
    steps = []
    for c in columns:
        if method == "iqr":
            a, b = quantiles(df, [c], [0.25, 0.75])[c]
            lo, hi = a - factor * (b - a), b + factor * (b - a)
        else:
            got = agg_dict(df, {"m": F.avg(value(df, c)), "s": F.stddev_samp(value(df, c))})
            lo, hi = got["m"] - threshold * got["s"], got["m"] + threshold * got["s"]
        steps.append({"column": c, "lo": lo, "hi": hi})
        df = remove(df, {"steps": steps[-1:]})
    return {"method": method, "steps": steps}


# ---- model rules ----------------------------------------------------------

def kmeans_flags(df: DataFrame, columns: Sequence[str], k: int = 3, percentile: float = 95.0, seed: int = 42) -> DataFrame:
    """Distance to the own cluster centre above a percentile of all distances."""
    cols = list(columns)
    e = filled(df, medians(df, cols))
    data = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(cols))], outputCol="__vec").transform(
        df.withColumns({f"__x{i}": x for i, x in enumerate(e.values())}))
    model = KMeans(k=k, seed=seed, featuresCol="__vec", predictionCol="__k").fit(data)
    out = model.transform(data)
    centre = F.lit(None)
    for i, c in enumerate(model.clusterCenters()):
        d = sum(((F.col(f"__x{j}") - float(v)) ** 2 for j, v in enumerate(c)), F.lit(0.0))
        centre = F.when(F.col("__k") == i, F.sqrt(d)).otherwise(centre)
    out = out.withColumn("score", centre.cast("double"))
    cut = quantiles(out, ["score"], [percentile / 100])["score"][0]
    return out.withColumn("is_outlier", F.col("score") > cut).drop("__vec", "__k", *[f"__x{i}" for i in range(len(cols))])


def _standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with ``x0..`` standardised after median filling."""
    e = filled(df, medians(df, cols))
    got = agg_dict(df, {(c, s): f(x) for c, x in e.items() for s, f in (("m", F.avg), ("s", F.stddev_pop))})
    return df.withColumns({f"x{i}": (x - got[(c, "m")]) / (got[(c, "s")] or 1.0) for i, (c, x) in enumerate(e.items())})


def dbscan_noise(df: DataFrame, columns: Sequence[str], eps: float = 3.0, min_samples: int = 5) -> DataFrame:
    """Noise points of density clustering: not dense, and no dense point near.

    Only noise is wanted, so no components are labelled.  A point is dense when
    its ``min_samples``-th nearest point (itself counted) is within ``eps``."""
    cols = [f"x{i}" for i in range(len(columns))]
    rows = _standard(df, columns)
    pts = distinct_points(rows, cols)
    near = knn(pts, len(cols), min_samples - 1) if min_samples > 1 else None
    reach = F.element_at("nn", -1)["d"] <= eps
    have = F.aggregate("nn", F.lit(0).cast("long"), lambda a, t: a + t["m"]) >= min_samples - 1
    dense = near.select("pid", (F.coalesce(reach & have, F.lit(False))).alias("dense"))
    tagged = pts.join(dense, "pid", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    core, rest = tagged.filter("dense").drop("dense"), tagged.filter("not dense").drop("dense")
    if core.limit(1).count() == 0:
        noise = rest.select("pid")
    else:
        near_core = knn(core, len(cols), 1, rest, within=eps)
        noise = rest.join(near_core.filter(F.size("nn") > 0), "pid", "left_anti").select("pid")
    noise = noise.withColumn("is_outlier", F.lit(True))
    out = rows.withColumn("pid", point_id(cols)).join(noise, "pid", "left")
    return out.withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False))).drop("pid", *cols)


def isolation_flags(df: DataFrame, columns: Sequence[str], key: Sequence[str], trees: int = 100, sample: int = 256,
                    contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Isolation forest: trees from a bounded hash sample, scores on executors."""
    cols = list(columns)
    e = filled(df, medians(df, cols))
    rows = df.withColumns({f"x{i}": x for i, x in enumerate(e.values())})
    n = df.count()
    want = trees * sample
    picked = rows.filter(unit_hash(list(key), seed) < min(1.0, 1.2 * want / max(n, 1))) \
        .select(*[f"x{i}" for i in range(len(cols))]).limit(2 * want).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(picked))
    forest = [_grow(picked[rng.choice(len(picked), size, replace=False)], 0, math.ceil(math.log2(max(size, 2))), rng)
              for _ in range(trees)]
    norm = _path_norm(size)

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(float) for s in xs])
        depth = np.zeros(len(x))
        for t in forest:
            _depth(x, t, np.arange(len(x)), 0, depth)
        return pd.Series(np.exp2(-depth / len(forest) / norm))

    out = rows.withColumn("score", score(*[f"x{i}" for i in range(len(cols))]))
    # the quantile reads the scores several times: they are stored, so that rows go through the trees once for it
    cut = quantiles(cut_lineage(out.select("score")), ["score"], [1 - contamination])["score"][0]
    return out.withColumn("is_outlier", F.col("score") > cut).drop(*[f"x{i}" for i in range(len(cols))])


def _path_norm(n: int) -> float:
    return 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng):
    spread = x.max(0) - x.min(0) if len(x) else np.zeros(x.shape[1])
    if depth >= limit or len(x) <= 1 or not spread.any():
        return _path_norm(len(x)) if len(x) > 1 else 0.0
    axis = int(rng.choice(np.flatnonzero(spread)))
    cut = rng.uniform(x[:, axis].min(), x[:, axis].max())
    left = x[:, axis] < cut
    return axis, cut, _grow(x[left], depth + 1, limit, rng), _grow(x[~left], depth + 1, limit, rng)


def _depth(x, node, rows, depth, out) -> None:
    if not isinstance(node, tuple):
        out[rows] += depth + node
        return
    axis, cut, lo, hi = node
    left = x[rows, axis] < cut
    _depth(x, lo, rows[left], depth + 1, out)
    _depth(x, hi, rows[~left], depth + 1, out)


def envelope_flags(df: DataFrame, columns: Sequence[str], key: Sequence[str], support: float = 0.9,
                   contamination: float = 0.09, starts: int = 2, steps: int = 8, seed: int = 42) -> DataFrame:
    """Robust covariance by concentration steps, each one Gram job and one quantile."""
    cols = list(columns)
    e = filled(df, medians(df, cols))
    rows = df.withColumns({f"x{i}": x for i, x in enumerate(e.values())})
    xs = {f"x{i}": F.col(f"x{i}") for i in range(len(cols))}
    n = df.count()

    def dist(g) -> Column:
        inv = np.linalg.pinv(g.cov(0))
        return quadratic_form([F.col(x) - float(m) for x, m in zip(xs, g.mean)], inv)

    best = None
    for s in range(starts):
        share = min(1.0, max(50, 20 * len(cols)) / max(n, 1)) if s else 1.0
        g, det = gram(rows.filter(unit_hash(list(key), seed + s) < share), xs)[None], math.inf
        for _ in range(steps):
            d = dist(g)
            cut = quantiles(rows, {"d": d}, [support])["d"][0]
            g = gram(rows.filter(d <= cut), xs)[None]
            new = float(np.linalg.det(g.cov(0)))
            if abs(det - new) <= 1e-9 * abs(new):
                break
            det = new
        if best is None or det < best[0]:
            best = (det, g)
    g = best[1]
    # consistency factor, then one reweighting at the 97.5 % point
    half = quantiles(rows, {"d": dist(g)}, [0.5])["d"][0]
    p = len(cols)
    factor = half / _chi2_point(0.5, p)
    g = gram(rows.filter(dist(g) / factor < _chi2_point(0.975, p)), xs)[None]
    out = rows.withColumn("score", dist(g))
    cut = quantiles(out, ["score"], [1 - contamination])["score"][0]
    return out.withColumn("is_outlier", F.col("score") > cut).drop(*xs)


def _chi2_point(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi2_tail(mid, k) < p else (lo, mid)
    return lo


def _places(got: dict, pids: list) -> np.ndarray:
    return np.array([got[x] for x in pids], np.float64)


def _ids(packed: bytes) -> list:
    return [packed[at:at + 16] for at in range(0, len(packed), 16)]


class _Edges:
    """The neighbours of the points of a cell, from their packed row."""

    def __init__(self, row: dict):
        self.own, self.refs = _ids(row["own"]), _ids(row["refs"])
        counts, self.at, self.m = (np.frombuffer(row[c], np.int32) for c in ("counts", "at", "m"))
        self.d, self.of = np.frombuffer(row["d"], np.float64), np.repeat(np.arange(len(counts)), counts)
        self.some, self.last = np.flatnonzero(counts), np.cumsum(counts) - 1

    def total(self, v: np.ndarray) -> np.ndarray:
        """Sums over the neighbours of each point that has some."""
        return np.bincount(self.of, weights=v, minlength=len(self.own))[self.some]


def lof_flags(df: DataFrame, columns: Sequence[str], k: int = 20, contamination: float = 0.05) -> DataFrame:
    """Local outlier factor over distinct points with multiplicities.

    The neighbours of a cell's points stay together in one packed row. What a cell must know of points, its own and those
    of other cells, comes to it as one number for each point, never for each pair of neighbours."""
    cols = list(columns)
    e = filled(df, medians(df, cols))
    xs = [f"x{i}" for i in range(len(cols))]
    rows = df.withColumns(dict(zip(xs, e.values())))
    pts = distinct_points(rows, xs)

    def pack(a, pid, _px, ids, dist, mult):
        counts = np.array([len(i) for i in ids], np.int32)
        used, at = np.unique(np.concatenate([np.asarray(i, np.int64) for i in ids]), return_inverse=True)
        d, m = (np.concatenate([np.asarray(x, t) for x in v]) for v, t in ((dist, np.float64), (mult, np.int32)))
        return pd.DataFrame({"cell": [a["cell"].iloc[0]], "own": [b"".join(a["pid"])], "refs": [b"".join(pid[used])], "counts": [counts.tobytes()],
                             "at": [at.astype(np.int32).tobytes()], "d": [d.tobytes()], "m": [m.tobytes()]})

    cells = cut_lineage(nearest(pts, len(xs), k, pack, "cell bigint, own binary, refs binary, counts binary, at binary, d binary, m binary"))

    def farthest(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                t = _Edges(row)
                yield pd.DataFrame({"pid": [t.own[i] for i in t.some], "v": t.d[t.last[t.some]]})

    def wanted(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                t = _Edges(row)
                pids = list({*t.refs, *(t.own[i] for i in t.some)})
                yield pd.DataFrame({"pid": pids, "to": np.full(len(pids), row["cell"], np.int64)})

    def folded(values: DataFrame, fold) -> DataFrame:
        """``pid, v`` of all points, from a number of each point that a cell knows of."""
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"pid": pd.Series([], dtype=object), "v": pd.Series([], dtype=float)})
            t, got = _Edges(a.iloc[0].to_dict()), dict(zip(b["pid"], b["v"]))
            pids = [t.own[i] for i in t.some]
            return pd.DataFrame({"pid": pids, "v": fold(t, _places(got, t.refs)[t.at], _places(got, pids))})

        known = cells.mapInPandas(wanted, "pid binary, to bigint").hint("merge").join(values.hint("merge"), "pid")
        return cut_lineage(cells.groupBy("cell").cogroup(known.groupBy("to")).applyInPandas(run, "pid binary, v double"))

    lrd = folded(cells.mapInPandas(farthest, "pid binary, v double"),
                 lambda t, far, _own: t.total(t.m) / (t.total(t.m * np.maximum(t.d, far)) + 1e-10 * t.total(t.m)))
    ratio = folded(lrd, lambda t, near, own: t.total(t.m * near) / t.total(t.m) / own).withColumnRenamed("v", "score")
    out = rows.withColumn("pid", point_id(xs)).join(ratio, "pid", "left").drop("pid", *xs)
    cut = quantiles(out, ["score"], [1 - contamination])["score"][0]
    return out.withColumn("is_outlier", F.coalesce(F.col("score") > cut, F.lit(False)))


def rpca_flags(df: DataFrame, columns: Sequence[str], lam: float | None = 0.1, max_iter: int = 30,
               tol: float = 1e-6, threshold: float = 7.0) -> DataFrame:
    """Sparse part of a low-rank plus sparse split, row L1 norm above a limit.

    The row state after t steps is a function of the row and of t small p x p
    matrices, so tasks rebuild it from those; nothing row-sized is kept between
    iterations and a lost task simply reruns."""
    cols = list(columns)
    e = filled(df, medians(df, cols))
    xs = [f"x{i}" for i in range(len(cols))]
    rows = df.withColumns(dict(zip(xs, e.values())))
    n, p = df.count(), len(xs)
    if lam is None:
        lam = 1 / math.sqrt(max(n, p))
    base = _raw_gram(rows, xs, [], 1.0, lam)[0]
    sigma = math.sqrt(max(np.linalg.eigvalsh(base).max(), 1e-300))
    mu, frob = 1.25 / sigma, math.sqrt(np.trace(base)) + 1e-10
    maps: list[np.ndarray] = []
    a = base
    for _ in range(max_iter):
        vals, vecs = np.linalg.eigh(a)
        s = np.sqrt(np.maximum(vals, 0))
        keep = np.where(s > 0, np.maximum(s - 1 / mu, 0) / np.where(s > 0, s, 1), 0)
        maps.append((vecs * keep) @ vecs.T)
        a, gap = _raw_gram(rows, xs, maps, mu, lam)
        if math.sqrt(gap) / frob < tol:
            break

    @F.pandas_udf("double")
    def score(*c: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(float) for s in c])
        return pd.Series(np.abs(_rpca_state(x, maps, mu, lam)[1]).sum(1))

    out = rows.withColumn("score", score(*xs))
    return out.withColumn("is_outlier", F.col("score") > threshold).drop(*xs)


def _rpca_state(x, maps, mu, lam):
    s, y, low = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    for m in maps:
        low = (x - s + y / mu) @ m
        r = x - low + y / mu
        s = np.sign(r) * np.maximum(np.abs(r) - lam / mu, 0)
        y = y + mu * (x - low - s)
    return low, s, y


def _raw_gram(rows: DataFrame, xs, maps, mu, lam):
    """(A'A for the next step, squared residual) summed over tasks."""
    p = len(xs)

    def part(batches):
        acc, gap = np.zeros((p, p)), 0.0
        for pdf in batches:
            x = pdf.to_numpy(float)
            low, s, y = _rpca_state(x, maps, mu, lam)
            a = x - s + y / mu
            acc += a.T @ a
            gap += float(((x - low - s) ** 2).sum())
        yield pd.DataFrame({"i": range(p * p + 1), "v": np.append(acc.ravel(), gap)})

    got = rows.select(*xs).mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    v = got.sort_values("i")["v"].to_numpy()
    return v[:-1].reshape(p, p), v[-1]


#: values of other rows that a task of the random graphs holds at a time, tasks at least, and rows that draw at a time
GRAPH_ROWS, GRAPH_TASKS, DRAWING = 8_000_000, 8, 200_000


def _drawn(i: np.ndarray, g: int, n: int, k: int, seed: int) -> np.ndarray:
    """rows x k: the first k different offsets, 1 to n - 1, that each row draws in a graph; 0 where it draws fewer."""
    start = hashed(g, hashed(i, wide=True))

    def draw(at, j):
        return np.mod(hashed(seed, hashed(j, at)).view(np.int64), max(n - 1, 1)) + 1

    out = np.column_stack([draw(start, j) for j in range(k)])
    ordered = np.sort(out, axis=1)
    again = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
    if len(again):
        for r, draws in zip(again, np.column_stack([draw(start[again], j) for j in range(3 * k)]).tolist()):
            first = list(dict.fromkeys(draws))[:k]
            out[r] = first + [0] * (k - len(first))
    return out


def _met(blocks: DataFrame, n: int, size: int, graphs: Sequence[int], k: int, seed: int, term, done, schema: str) -> DataFrame:
    """Sums of ``term(own, other)`` over the random neighbours of each row, one for each graph, handed to ``done(first row, own, sums)``.

    ``blocks`` (b, v) holds the values of ``size`` rows each. A task has a block of rows, and all blocks pass by it: which rows
    are neighbours is drawn from their numbers there, so no edge is ever a row."""
    tasks, group = -(-n // size), max(1, GRAPH_ROWS // size)
    keys = dealt_keys(blocks.sparkSession, tasks)
    number = {key: t for t, key in enumerate(keys)}

    def add(sums, own, first, base, values):
        for at in range(0, len(own), DRAWING):
            mine = own[at:at + DRAWING]
            i = np.arange(first + at, first + at + len(mine))
            for g, graph in enumerate(graphs):
                off = _drawn(i, graph, n, k, seed)
                j = i[:, None] + off
                j = np.where(j >= n, j - n, j) - base
                here = (off > 0) & (j >= 0) & (j < len(values))
                sums[g, at:at + len(mine)] += np.where(here, term(mine[:, None], values[np.where(here, j, 0)]), 0.0).sum(axis=1)

    def run(batches):
        to, own, sums, held, base = None, None, None, [], 0
        for pdf in batches:
            for t, b, v in zip(pdf["to"], pdf["b"], pdf["v"]):
                x, b = np.frombuffer(v, np.float64), int(b)
                if b < 0 or (held and b % group == 0):
                    if held:
                        add(sums, own, to * size, base, np.concatenate(held))
                        held = []
                if b < 0:  # a row block of its own comes before all others
                    if to is not None:
                        yield from done(to * size, own, sums)
                    to, own, sums = number[int(t)], x, np.zeros((len(graphs), len(x)))
                    continue
                if not held:
                    base = b * size
                held.append(x)
        if held:
            add(sums, own, to * size, base, np.concatenate(held))
        if to is not None:
            yield from done(to * size, own, sums)

    asked = F.array(*[F.lit(key) for key in keys])
    sent = (blocks.select("v", F.explode(F.concat(F.transform(asked, lambda t: F.struct(t.cast("bigint").alias("to"), F.col("b").cast("bigint").alias("b"))),
                                                  F.array(F.struct(F.element_at(asked, F.col("b").cast("int") + 1).cast("bigint").alias("to"), F.lit(-1).cast("bigint").alias("b"))))).alias("s"))
            .select("s.to", "s.b", "v").repartition(tasks, F.col("to")).sortWithinPartitions("to", "b"))
    return sent.mapInPandas(run, schema)


def fluctuation_flags(df: DataFrame, columns: Sequence[str], key: Sequence[str], graphs: int = 2, k: int = 10,
                      drop: int = 20, seed: int = 42) -> DataFrame:
    """Rows whose share of a random neighbourhood's total differs most from their neighbours'.

    Only row totals enter. They go to tasks as packed blocks of eight bytes a row; the random graphs are drawn there."""
    e = filled(df, medians(df, columns))
    rows = cut_lineage(dense_index(df.withColumn("__s", sum(e.values(), F.lit(0.0))), list(key), "__i"))
    n = rows.count()
    k = min(k, n - 1)
    if k < 1 or graphs < 1:
        return rows.withColumns({"score": F.lit(None).cast("double"), "is_outlier": F.lit(False)}).drop("__i", "__s")
    size = min(GRAPH_ROWS, -(-n // GRAPH_TASKS))

    def packed(b: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [b[0]], "v": [pdf.sort_values("__i")["__s"].to_numpy(np.float64).tobytes()]})

    def shares(_first, own, sums):
        yield pd.DataFrame({"b": [_first // size], "v": [sum(own / (own + t + 1e-10) for t in sums).tobytes()]})

    def scores(first, _own, sums):
        for at in range(0, sums.shape[1], DRAWING):
            part = sums[0, at:at + DRAWING]
            yield pd.DataFrame({"__i": np.arange(first + at, first + at + len(part)), "score": part})

    blocks = rows.select(F.expr(f"__i div {size}").alias("b"), "__i", "__s").groupBy("b").applyInPandas(packed, "b bigint, v binary")
    coef = cut_lineage(_met(blocks, n, size, range(graphs), k, seed, lambda own, other: other, shares, "b bigint, v binary"))
    score = cut_lineage(_met(coef, n, size, [graphs - 1], k, seed, lambda own, other: np.abs(own - other), scores, "__i bigint, score double"))
    top = score.orderBy(F.desc("score"), "__i").limit(drop).select("__i", F.lit(True).alias("is_outlier"))
    # both sides have all rows: never built in the driver
    out = rows.hint("merge").join(score.hint("merge"), "__i", "left").join(F.broadcast(top), "__i", "left")
    return out.withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False))).drop("__i", "__s")


# ---- moment-optimised fence ----------------------------------------------

def fence_score(df: DataFrame, column: str, base: str = "iqr") -> tuple[Column, float, float]:
    """Distance in units of theta: rows with score <= theta are kept."""
    v = value(df, column).cast("double")
    if base == "zscore":
        got = agg_dict(df, {"m": F.avg(v), "s": F.stddev_samp(v)})
        return F.abs(v - got["m"]) / (got["s"] or 1.0), 0.5, 6.0
    a, b = quantiles(df, {"v": v}, [0.25, 0.75])["v"]
    w = (b - a) or 1.0
    return F.greatest((F.lit(a) - v) / w, (v - F.lit(b)) / w), 0.1, 5.0


def objective_grid(df: DataFrame, column: str, score: Column, thetas: Sequence[float], *, target_kurtosis=0.0,
                   target_skewness=0.0, w_kurtosis=1.0, w_skewness=1.0, w_retention=0.5, min_retention=0.5) -> list[dict]:
    """Objective at each threshold from power sums, all in one aggregate."""
    v = value(df, column).cast("double")
    base = agg_dict(df, {"n": F.count(v), "m": F.avg(v), "s": F.stddev_pop(v)})
    n, z = base["n"], (v - base["m"]) / (base["s"] or 1.0)
    sums = agg_dict(df, {(i, j): F.sum(F.when(score <= t, z ** j)) if j else F.count_if(score <= t)
                         for i, t in enumerate(thetas) for j in range(5)})
    out = []
    for i, t in enumerate(thetas):
        m = sums[(i, 0)]
        row = {"theta": t, "kept": m, "kurtosis": None, "skewness": None, "objective": math.inf}
        if m >= max(4, int(n * min_retention)):
            s1, s2, s3, s4 = (sums[(i, j)] / m for j in (1, 2, 3, 4))
            var = s2 - s1 ** 2
            if var > 0:
                c3 = s3 - 3 * s1 * s2 + 2 * s1 ** 3
                c4 = s4 - 4 * s1 * s3 + 6 * s1 ** 2 * s2 - 3 * s1 ** 4
                ku, sk = c4 / var ** 2 - 3, c3 / var ** 1.5
                row.update(kurtosis=ku, skewness=sk, objective=w_kurtosis * (ku - target_kurtosis) ** 2
                           + w_skewness * (sk - target_skewness) ** 2 + w_retention * (n - m) / n)
        out.append(row)
    return out


def fit_moment_fence(df: DataFrame, column: str, base: str = "iqr", grid: int = 33, rounds: int = 3, **kw) -> dict:
    """Threshold with the least objective: a grid, narrowed around its best point."""
    score, lo, hi = fence_score(df, column, base)
    best, trace = None, []
    for _ in range(rounds):
        step = (hi - lo) / (grid - 1)
        rows = objective_grid(df, column, score, [lo + i * step for i in range(grid)], **kw)
        trace += rows
        top = min(rows, key=lambda r: (r["objective"], r["theta"]))
        best = top if best is None or top["objective"] < best["objective"] else best
        lo, hi = max(lo, best["theta"] - step), min(hi, best["theta"] + step)
    return {"method": "moment_opt", "column": column, "base": base, "best": best, "trace": trace}


def flag_moment_fence(df: DataFrame, params: dict) -> DataFrame:
    score, _, _ = fence_score(df, params["column"], params["base"])
    return _flagged(df, score, params["best"]["theta"])


def shape_labels(skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Words for population skewness and excess kurtosis."""
    s = (F.when(F.abs(skew) < 0.5, "symmetric").when(skew > 1.0, "strong right skew").when(skew > 0, "mild right skew")
         .when(skew < -1.0, "strong left skew").otherwise("mild left skew"))
    k = F.when(F.abs(kurt) < 0.5, "normal tails").when(kurt > 0, "heavy tails").otherwise("light tails")
    return F.when(skew.isNotNull(), s), F.when(kurt.isNotNull(), k)


def shape_change(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skewness and kurtosis of each column before and after a step."""
    rows = []
    for stage, df in (("before", before), ("after", after)):
        m = moments(df, columns)
        rows += [(stage, c, fin(m[c]["skew"]) if m[c]["n"] >= 3 else None, fin(m[c]["kurt"]) if m[c]["n"] >= 3 else None)
                 for c in columns]
    t = rows_frame(before.sparkSession, rows, "stage string, column string, skewness double, kurtosis double")
    s, k = shape_labels(F.col("skewness"), F.col("kurtosis"))
    return t.withColumns({"skew_label": s, "kurt_label": k})

