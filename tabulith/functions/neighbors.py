"""Exact k nearest neighbours as Spark joins on the cells of a tree.

Rows collapse to distinct points with a multiplicity, so copies cannot fill a
cell.  Cells with too many points are cut on their two widest axes, level by
level, until all are small; cuts and points stay in tables.  A query first
looks at its own cell, which bounds its k-th distance, and at the boxes of all
cells.  Each cell then hands over its points that lie near the queries of
another, packed, and a query is answered once, where it is: neither queries nor
partial answers travel.  Cells that attract many queries are salted.  The
driver gets counts and the boxes, so many at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .columns import drop_missing, q

CELL_POINTS = 2000
#: parts of each of the two axes on which a cell is cut
PARTS = 8
QUERIES_PER_TASK = 20_000
#: a counted table of at most so many rows (cuts of open cells, or hot cells) is sent to all tasks
SENT_ROWS = 10_000
#: boxes of cells that are sent to all tasks at a time, and queries that ask, or are answered, together
BOXES, ASKED, ANSWERED = 100_000, 256, 64
ROOT = 0


def point_id(xs: Sequence[str]) -> Column:
    """Two 64-bit hashes of the coordinates, as 16 bytes."""
    cols = [F.col(x).cast("double") for x in xs]
    return F.unhex(F.concat(F.lpad(F.hex(F.xxhash64(*cols)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), *cols)), 16, "0")))


def distinct_points(df: DataFrame, cols) -> DataFrame:
    """``pid, x0.., m``: distinct complete points, their hash id and copies."""
    # adding zero makes one point of the two signs of zero
    clean = drop_missing(df.select(*[(q(c).cast("double") + 0.0).alias(f"x{i}") for i, c in enumerate(cols)]))
    xs = [f"x{i}" for i in range(len(cols))]
    return clean.groupBy(*xs).agg(F.count("*").alias("m")).withColumn("pid", point_id(xs))


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= SENT_ROWS else small


# ---- the tree ------------------------------------------------------------------------

def _cuts(placed: DataFrame, xs: list[str]) -> DataFrame:
    """``cell, axis, cuts, axis2, cuts2`` of the cells with more than CELL_POINTS points.

    The middle of the widest side is always among the cuts, so a cell falls apart whatever its points are like."""
    shares = [i / PARTS for i in range(1, PARTS)]
    got = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.array(*[F.min(x) for x in xs]).alias("lo"), F.array(*[F.max(x) for x in xs]).alias("hi"),
        F.array(*[F.percentile_approx(x, shares, 1000) for x in xs]).alias("at")).where(F.col("n") > CELL_POINTS)
    # no more parts than make cells of about half as many points: small cells ask many others
    wide = F.greatest(F.lit(1), F.floor(F.lit(PARTS) / F.when(F.col("n") <= 2 * CELL_POINTS, 2).when(F.col("n") <= 8 * CELL_POINTS, 4).otherwise(PARTS)))
    got = got.withColumn("at", F.transform("at", lambda cuts: F.filter(cuts, lambda _, i: (i + 1) % wide == 0)))
    sides = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(xs) - 1)), lambda i: F.struct((F.col("lo")[i] - F.col("hi")[i]).alias("less"), i.alias("axis"))))
    got = got.withColumn("axis", sides[0]["axis"]).withColumn("axis2", F.coalesce(F.get(sides, F.lit(1))["axis"], sides[0]["axis"]))
    # parts of a side that is far shorter than the other lie near the same queries
    got = got.withColumn("flat", F.coalesce(F.get(sides, F.lit(1))["less"] * PARTS > sides[0]["less"], F.lit(False)))
    middle = F.col("lo")[F.col("axis")] / 2 + F.col("hi")[F.col("axis")] / 2
    return got.select("cell", "axis", F.array_union(F.col("at")[F.col("axis")], F.array(middle)).alias("cuts"),
                      "axis2", F.when((F.col("axis") == F.col("axis2")) | F.col("flat"), F.array().cast("array<double>")).otherwise(F.col("at")[F.col("axis2")]).alias("cuts2"))


def _moved(rows: DataFrame, cuts: DataFrame, xs: list[str]) -> DataFrame:
    """Rows of cells that are cut go to the part where they lie, ``to``, named by a hash of the cell and the part."""
    x = F.array(*xs)
    part = [F.size(F.filter(F.col("cuts"), lambda v: v < x[F.col("axis")])), F.size(F.filter(F.col("cuts2"), lambda v: v < x[F.col("axis2")]))]
    to = F.when(F.col("axis").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", *part))
    return rows.join(cuts, "cell", "left").withColumn("to", to).drop("cell", "axis", "cuts", "axis2", "cuts2")


def _tree(points: DataFrame, xs: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their cell, and the cuts of each level."""
    placed, cuts = points.withColumn("cell", F.lit(ROOT).cast("bigint")).withColumn("new", F.lit(True)), []
    while True:
        level = cut_lineage(_cuts(placed.where("new"), xs))
        if not level.head(1):
            return placed.drop("new"), cuts
        cuts.append(_sent(level))
        placed = cut_lineage(_moved(placed.withColumn("parent", F.col("cell")).drop("new"), cuts[-1], xs)
                             .withColumn("new", F.col("parent") != F.col("to")).drop("parent").withColumnRenamed("to", "cell"))


def _boxes(placed: DataFrame, xs: list[str]):
    """The cells' boxes as arrays (cell, n, lo, hi), so many at a time."""
    lo, hi = ([f(x).alias(f"{s}{i}") for i, x in enumerate(xs)] for s, f in (("lo", F.min), ("hi", F.max)))
    boxes = cut_lineage(placed.groupBy("cell").agg(F.count("*").alias("n"), *lo, *hi))
    turns = -(-boxes.count() // BOXES)
    for t in range(turns):
        got = boxes.where(F.pmod(F.xxhash64("cell"), F.lit(turns)) == t).toPandas()
        yield (got["cell"].to_numpy(), got["n"].to_numpy(), *(got[[f"{s}{i}" for i in range(len(xs))]].to_numpy(float) for s in ("lo", "hi")))


# ---- the search ------------------------------------------------------------------------

def _pairs(x: np.ndarray, px: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all queries to all points, axis by axis."""
    out = np.zeros((len(x), len(px)))
    for i in range(x.shape[1]):
        gap = x[:, i, None] - px[None, :, i]
        if metric == "max":
            np.maximum(out, np.abs(gap, out=gap), out=out)
        else:
            out += np.square(gap, out=gap)
    return out if metric == "max" else np.sqrt(out, out=out)


def _search(qx, px, pid, pm, k, own, metric, limit=None):
    """Per query the nearest points until the multiplicities reach k.

    ``own`` holds the id of a point that counts one copy less for the query, or None; ``limit`` the distance beyond which
    the query needs no points, as it knows k nearer ones."""
    ids, dist, mult = [], [], []
    for at in range(0, len(qx), 256):
        block = qx[at:at + 256]
        d = _pairs(block, px, metric)
        if d.shape[1] > 4 * (k + 1):  # all that tie with the last are ordered too
            edge = np.partition(d, k, axis=1)[:, k]
        else:
            edge = np.full(len(block), np.inf)
        for r in range(len(block)):
            i = np.flatnonzero(d[r] <= (edge[r] if limit is None else min(edge[r], limit[at + r])))
            i = i[np.argsort(d[r, i], kind="stable")]
            m = pm[i].copy()
            if own[at + r] is not None:
                m[[x == own[at + r] for x in pid[i]]] -= 1
            keep = m > 0
            i, m = i[keep], m[keep]
            before = np.cumsum(m) - m
            ok = before < k
            ids.append(pid[i[ok]].tolist())
            dist.append(d[r, i[ok]].tolist())
            mult.append(np.minimum(m, k - before)[ok].tolist())
    return ids, dist, mult


_NN = "array<struct<d:double,pid:binary,m:bigint>>"


def _pack(ids, dist, mult):
    return [[{"d": d, "pid": i, "m": m} for i, d, m in zip(a, b, c)] for a, b, c in zip(ids, dist, mult)]


def _length(gap: np.ndarray, metric: str) -> np.ndarray:
    return gap.max(-1) if metric == "max" else np.sqrt((gap ** 2).sum(-1))


def _blocks(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of queries that lie together: halves of halves along the widest axis."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        axis = np.argmax(x[at].max(0) - x[at].min(0))
        order = at[np.argsort(x[at, axis], kind="stable")]
        todo += [order[:len(at) // 2], order[len(at) // 2:]]
    return out


def _bound(x: np.ndarray, px: np.ndarray, k: int, metric: str, most: float) -> np.ndarray:
    """A distance within which each query has k of the points, one of which may be its own."""
    if len(px) <= k:
        return np.full(len(x), most)
    return np.minimum(np.partition(_pairs(x, px, metric), k, axis=1)[:, k], most)


def _ball(x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the boxes around what lies within the limit, a little wide for rounded sums."""
    wide = limit[:, None] * (1 + 1e-9) + np.abs(x) * 1e-12
    return x - wide, x + wide


def _asks(a: pd.DataFrame, b: pd.DataFrame, boxes: tuple, xs: list[str], k: int, metric: str, most: float) -> pd.DataFrame:
    """For the queries of a cell: cells that may hold one of their k nearest points, and the box within which points are wanted."""
    cell, n, lo, hi = boxes
    x, px, found = a[xs].to_numpy(float), b[xs].to_numpy(float) if len(b) else np.empty((0, len(xs))), {}
    for at in _blocks(x, ASKED):
        q, limit = x[at], _bound(x[at], px, k, metric, most)
        first, last = q.min(0), q.max(0)
        some = _length(np.maximum(np.maximum(lo - last, first - hi), 0), metric)
        top = limit.max()
        if np.isinf(top):  # cells that hold k points bound what a box can be away
            reach = _length(np.maximum(np.abs(hi - first), np.abs(last - lo)), metric)
            order = np.argsort(reach)
            enough = np.flatnonzero(np.cumsum(n[order]) > k)
            top = reach[order[enough[0]]] if len(enough) else top
        some = np.flatnonzero(some <= top * (1 + 1e-12))
        if not len(some):
            continue
        left, right, y = lo[some][None], hi[some][None], q[:, None, :]
        near, reach = _length(np.maximum(np.maximum(left - y, y - right), 0), metric), _length(np.maximum(np.abs(left - y), np.abs(y - right)), metric)
        order = np.argsort(reach, axis=1)
        enough = np.cumsum(n[some][order], axis=1) > k
        edge = np.where(enough.any(1), np.take_along_axis(reach, order, 1)[np.arange(len(q)), enough.argmax(1)], np.inf)
        limit = np.minimum(limit, edge)
        hit = near <= (limit * (1 + 1e-12))[:, None]
        begin, end = _ball(q, limit)
        for c in np.flatnonzero(hit.any(0)):
            got = begin[hit[:, c]].min(0), end[hit[:, c]].max(0)
            old = found.get(some[c])
            found[some[c]] = got if old is None else (np.minimum(got[0], old[0]), np.maximum(got[1], old[1]))
    at = list(found)
    if not at:
        return _nothing(("cell", "home", "salt", "lo", "hi"))
    return pd.DataFrame({"cell": cell[at], "home": a["cell"].iloc[0], "salt": a["salt"].iloc[0],
                         "lo": [found[c][0].tolist() for c in at], "hi": [found[c][1].tolist() for c in at]})


def _nothing(names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})


_ASKS = "cell bigint, home bigint, salt bigint, lo array<double>, hi array<double>"
_HANDED = "home bigint, salt bigint, here boolean, pid binary, x binary, m binary"


def _hands(a: pd.DataFrame, b: pd.DataFrame, xs: list[str]) -> pd.DataFrame:
    """The points of a cell that lie in each box asked for, packed."""
    x, m, pid, out = b[xs].to_numpy(float), b["m"].to_numpy(np.int64), b["pid"].to_numpy(), []
    for cell, home, salt, lo, hi in zip(a["cell"], a["home"], a["salt"], a["lo"], a["hi"]):
        at = np.flatnonzero(((x >= np.asarray(lo)) & (x <= np.asarray(hi))).all(axis=1))
        if len(at):
            out.append((home, salt, cell == home, b"".join(pid[at]), x[at].tobytes(), m[at].tobytes()))
    return pd.DataFrame(out, columns=["home", "salt", "here", "pid", "x", "m"]) if out else _nothing(("home", "salt", "here", "pid", "x", "m"))


def _answers(a: pd.DataFrame, b: pd.DataFrame, xs: list[str], k: int, metric: str, most: float):
    """Points (ids, coordinates) that the queries of a cell got, and for each query places among them, distances and multiplicities."""
    pid = np.array([x[at:at + 16] for x in b["pid"] for at in range(0, len(x), 16)], object)
    px = np.concatenate([np.frombuffer(x, np.float64) for x in b["x"]]).reshape(-1, len(xs))
    pm = np.concatenate([np.frombuffer(x, np.int64) for x in b["m"]])
    here = np.repeat(b["here"].to_numpy(bool), [len(x) // 8 for x in b["m"]])
    if len(b) > 1:  # points of several cells that tie stand in the order of their ids, those of one cell in that of its rows
        order = np.array(sorted(range(len(pid)), key=pid.__getitem__), np.int64)
        pid, px, pm, here = pid[order], px[order], pm[order], here[order]
    place = dict(zip(pid, range(len(pid))))
    x, own = a[xs].to_numpy(float), [None if o is None else place.get(o, -1) for o in a["own"]]
    ids, dist, mult = [None] * len(a), [None] * len(a), [None] * len(a)
    for at in _blocks(x, ANSWERED):
        limit = _bound(x[at], px[here], k, metric, most)
        lo, hi = _ball(x[at], np.where(np.isinf(limit), np.finfo(float).max / 4, limit))
        some = np.flatnonzero(((px >= lo.min(0)) & (px <= hi.max(0))).all(axis=1))
        if len(some):
            got = _search(x[at], px[some], some, pm[some], k, [own[i] for i in at], metric, limit)
        else:
            got = [[[] for _ in at] for _ in range(3)]
        for r, i in enumerate(at):
            ids[i], dist[i], mult[i] = got[0][r], got[1][r], got[2][r]
    return pid, px, ids, dist, mult


def nearest(points: DataFrame, p: int, k: int, finish: Callable, schema: str, queries: DataFrame | None = None, keep: Sequence[str] = (),
            metric: str = "euclid", within: float | None = None) -> DataFrame:
    """What ``finish`` makes of the queries of each cell and their nearest points, see :func:`knn`.

    It gets the queries (with the columns ``keep``), the ids and coordinates of the points that came there, and for each query
    lists of places among those points, distances and multiplicities."""
    xs = [f"x{i}" for i in range(p)]
    placed, cuts = _tree(cut_lineage(points.select("pid", "m", *xs)), xs)
    if queries is None:
        qs = placed.select("pid", F.col("pid").alias("own"), "cell", *xs).withColumn("salt", F.lit(0).cast("bigint"))
        cells = placed.withColumn("salt", F.lit(0).cast("bigint"))
    else:
        own = F.col("own") if "own" in queries.columns else F.lit(None).cast("binary")
        qs = cut_lineage(queries.select("pid", own.alias("own"), *keep, *xs)).withColumn("cell", F.lit(ROOT).cast("bigint"))
        for level in cuts:
            qs = _moved(qs, level, xs).withColumnRenamed("to", "cell")
        qs, cells = _salted(cut_lineage(qs), placed)
    most = float("inf") if within is None else float(within)
    # columns of their own: a cogroup loses those that both sides share
    mine, theirs = qs.select("cell", "salt", *xs), cells.select(*[F.col(c).alias(c) for c in ("cell", "salt", *xs)])

    def asking(boxes):
        def ask(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _asks(a, b, boxes, xs, k, metric, most) if len(a) else _nothing(("cell", "home", "salt", "lo", "hi"))
        return mine.groupBy("cell", "salt").cogroup(theirs.groupBy("cell", "salt")).applyInPandas(ask, _ASKS)

    asks = None
    for boxes in _boxes(placed, xs):
        asks = asking(boxes) if asks is None else asks.unionByName(asking(boxes))
    if asks is None:
        return placed.sparkSession.createDataFrame([], schema)

    def hand(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _hands(a, b, xs) if len(a) else _nothing(("home", "salt", "here", "pid", "x", "m"))

    handed = asks.groupBy("cell").cogroup(placed.groupBy("cell")).applyInPandas(hand, _HANDED)

    names = T.StructType.fromDDL(schema).names

    def answer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return _nothing(names)
        return finish(a, *_answers(a, b, xs, k, metric, most))

    return qs.groupBy("cell", "salt").cogroup(handed.groupBy("home", "salt")).applyInPandas(answer, schema)


def _salted(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``; where the left side has very many rows of a cell they are split and the right side's are copied."""
    hot = left.groupBy("cell").count().where(F.col("count") > QUERIES_PER_TASK).select("cell", F.ceil(F.col("count") / QUERIES_PER_TASK).alias("salts"))
    if hot.head(1):
        hot = _sent(cut_lineage(hot))
        left, right = left.join(hot, "cell", "left"), right.join(hot, "cell", "left")
    else:
        left, right = left.withColumn("salts", F.lit(None).cast("bigint")), right.withColumn("salts", F.lit(None).cast("bigint"))
    salts = F.coalesce("salts", F.lit(1)).cast("bigint")
    return (left.withColumn("salt", F.pmod(F.xxhash64("pid"), salts)).drop("salts"),
            right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("salts"))


def knn(points: DataFrame, p: int, k: int, queries: DataFrame | None = None,
        metric: str = "euclid", within: float | None = None) -> DataFrame:
    """``pid, nn`` with ``nn`` an array of (d, pid, m) rising by distance.

    ``points`` comes from :func:`distinct_points`; ``queries`` has the same
    coordinates and a ``pid`` of its own, unique among queries, and may have
    ``own``, the id of a point that counts one copy less.  Without queries the
    points themselves ask (a point is then not its own neighbour, its other
    copies are).  ``within`` leaves out what is farther away."""
    def finish(a, pid, _px, ids, dist, mult):
        return pd.DataFrame({"pid": a["pid"].to_numpy(), "nn": _pack([pid[i].tolist() if len(i) else [] for i in ids], dist, mult)})

    return nearest(points, p, k, finish, f"pid binary, nn {_NN}", queries, (), metric, within)
