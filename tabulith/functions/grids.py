"""Information of all equal-frequency grids of a pair of columns, from points in the order of one column.

The side with fewer bins (at most the root of the budget) is coded by cuts that the driver knows.  The other side may
have half the budget of bins, whose cuts are as many as rows: those are found while the points pass in order, in packed
slices, and a task keeps the counts of the bin that is open in each of its grids and the sums of those that are closed."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt_keys

#: points of a slice, rows that a task packs, and tasks that share the grids of an ordered pair
SLICE_POINTS, PACKED_ROWS, SHARES = 1 << 18, 4_000_000, 4


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def coarse_codes(edges: Mapping[int, Sequence[float]], fine: Sequence[float]) -> dict[int, np.ndarray]:
    """Bins -> bin of each fine code, once for all numbers of bins that part the values in the same way; the least number stays."""
    out, seen = {}, set()
    for k in sorted(edges):
        code = np.searchsorted(edges[k], [*fine, math.inf], side="left")
        if code.tobytes() not in seen:
            seen.add(code.tobytes())
            out[k] = code
    return out


class Grids:
    """Grids of one ordered pair: the first side has bins as ``codes`` says, the second ``k`` (+ 1 if strict) to ``budget / k``."""

    def __init__(self, n: int, budget: int, codes: Mapping[int, np.ndarray], strict: bool):
        self.n, self.codes = n, codes
        self.span = {k: (k + strict, budget // k) for k in codes if budget // k >= k + strict}
        self.most = max((hi for _, hi in self.span.values()), default=1)
        self.seen, self.least, self.late = 0, None, np.zeros(0, np.int64)
        self.last, self.sums, self.bins = (np.zeros(self.most + 1) for _ in range(3))
        wide = {k: int(codes[k].max()) + 1 for k in self.span}
        self.open = {k: np.zeros((wide[k], hi - lo + 1)) for k, (lo, hi) in self.span.items()}
        self.joint = {k: np.zeros(hi - lo + 1) for k, (lo, hi) in self.span.items()}
        self.own = {k: np.zeros(wide[k]) for k in self.span}

    def _cuts(self, ends: np.ndarray, values: np.ndarray, following: float) -> tuple[np.ndarray, np.ndarray]:
        """Bins of the second side, and the run after which a cut lies, for all cuts in this slice."""
        n, start, end, runs = self.n, self.seen, int(ends[-1]), len(ends)
        ny = np.arange(2, self.most + 1)
        first = np.maximum(np.floor(start / (n - 1) * ny).astype(np.int64) - 1, 1)
        count = np.maximum(np.minimum(np.ceil(end / (n - 1) * ny).astype(np.int64) + 1, ny - 1) - first + 1, 0)
        bins = np.repeat(ny, count)
        i = np.arange(len(bins)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        place = (n - 1) * (i / bins)
        row = np.floor(place)
        ok = (row >= start) & (row < end)
        bins, place, row = bins[ok], place[ok], row[ok]
        run, part = np.searchsorted(ends, row, side="right"), place - row
        between = (row + 1 == ends[run]) & (part > 0)
        with np.errstate(invalid="ignore"):
            low, high = values[run], np.append(values[1:], following)[run]
            edge = np.where(between, low + (high - low) * part, low)
            run = run + (between & (edge >= high))  # a quantile that rounds to the next value
        ok = edge != self.least
        bins, run = bins[ok], run[ok]
        late, self.late = self.late, bins[run == runs]
        bins, run = bins[run < runs], run[run < runs]
        if len(late):
            bins, run = np.append(bins, late), np.append(run, np.zeros(len(late), np.int64))
            order = np.lexsort((run, bins))
            bins, run = bins[order], run[order]
        ok = ends[run] < n
        ok[1:] &= (run[1:] != run[:-1]) | (bins[1:] != bins[:-1])
        return bins[ok], run[ok]

    def add(self, values: np.ndarray, points: np.ndarray, code: np.ndarray, count: np.ndarray, following: float) -> None:
        """The next slice: values of the second side, points of each, and the fine code and rows of each point."""
        if self.least is None:
            self.least = values[0]
        ends = self.seen + np.cumsum(np.add.reduceat(count, np.cumsum(points) - points))
        bins, run = self._cuts(ends, values, following)
        if len(bins):
            begins = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
            upto = ends[run].astype(float)
            size = np.diff(upto, prepend=0.0)
            size[begins] = upto[begins] - self.last[bins[begins]]
            self.sums[bins[begins]] += np.add.reduceat(_xlogx(size), begins)
            self.bins += np.bincount(bins, minlength=len(self.bins))
            self.last[bins[begins]] = upto[np.append(begins[1:], len(bins)) - 1]
        of, weight = np.repeat(np.arange(len(values)), points), count.astype(float)
        for k, (lo, hi) in self.span.items():
            a, b = np.searchsorted(bins, [lo, hi + 1])
            at, mine = run[a:b], bins[a:b] - lo
            cut = np.zeros(len(values), np.int64)
            cut[at] = 1
            upto = np.cumsum(cut)
            parts = int(upto[-1]) + 1
            wide = len(self.own[k])
            cells = np.bincount(self.codes[k][code] * parts + (upto - cut)[of], weights=weight, minlength=wide * parts).reshape(wide, parts)
            cells = np.cumsum(cells, axis=1)
            whole = cells[:, -1]
            self.own[k] += whole
            if not len(at):
                self.open[k] += whole[:, None]
                continue
            begins = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            below = cells[:, upto[at] - 1]
            size = np.diff(below, axis=1, prepend=0.0)
            size[:, begins] = below[:, begins] + self.open[k][:, mine[begins]]
            self.joint[k][mine[begins]] += np.add.reduceat(_xlogx(size).sum(axis=0), begins)
            ended = below[:, np.append(begins[1:], len(at)) - 1]
            self.open[k] += whole[:, None]
            self.open[k][:, mine[begins]] = whole[:, None] - ended
        self.seen = int(ends[-1])

    def best(self) -> float:
        """The greatest information over the logarithm of the lesser number of bins in use."""
        sums, bins, top = self.sums + _xlogx(self.n - self.last), self.bins + 1, 0.0
        for k, (lo, hi) in self.span.items():
            joint = self.joint[k] + _xlogx(self.open[k]).sum(axis=0)
            least = np.minimum((self.own[k] > 0).sum(), bins[lo:hi + 1])
            info = (joint - _xlogx(self.own[k]).sum() - sums[lo:hi + 1]) / self.n + math.log(self.n)
            ok = least >= 2
            if ok.any():
                top = max(top, float((info[ok] / np.log(least[ok])).max()))
        return top


def _packed(batches):
    """Rows (o, v, f, m) in order become slices; rows with equal o and v stay together."""
    def blob(o, part):
        v = part["v"].to_numpy(float)
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        return {"o": o, "v": v[0], "values": v[starts].tobytes(), "points": np.diff(np.append(starts, len(v))).tobytes(),
                "code": part["f"].to_numpy(np.int32).tobytes(), "count": part["m"].to_numpy(np.int64).tobytes()}

    held, of, size = [], None, 0
    for pdf in batches:
        for o, part in pdf.groupby("o", sort=False):
            if held and (o != of or size >= SLICE_POINTS):
                whole = pd.concat(held, ignore_index=True)
                rest = whole.iloc[:0] if o != of else whole[whole["v"] == part["v"].iloc[0]]
                if len(rest) < len(whole):
                    yield pd.DataFrame([blob(of, whole.iloc[:len(whole) - len(rest)])])
                held, size = ([rest] if len(rest) else []), len(rest)
            of = o
            held.append(part)
            size += len(part)
    if held:
        yield pd.DataFrame([blob(of, pd.concat(held, ignore_index=True))])


def best_grids(points: DataFrame, n: int, budget: int, sides: Sequence[tuple[Mapping[int, np.ndarray], bool]]) -> dict[int, float]:
    """Ordered pair -> best score, from ``points`` (o, v, f, m): pair, value of the second side, fine code of the first, rows.

    ``sides`` has for each pair the bins of the fine codes by number of bins, and whether the second side has more bins."""
    shares = []
    for o, (codes, strict) in enumerate(sides):
        load = [[0.0, {}] for _ in range(min(SHARES, len(codes)))]
        for k in sorted(codes):  # fewer bins have more grids
            least = min(load, key=lambda x: x[0])
            least[0] += n + budget * budget / (2 * k)
            least[1][k] = codes[k]
        shares += [(o, ks, strict) for _, ks in load]
    spark = points.sparkSession
    keys = dealt_keys(spark, len(shares))
    number = {key: s for s, key in enumerate(keys)}
    asked = [[keys[s] for s, share in enumerate(shares) if share[0] == o] for o in range(len(sides))]

    def run(batches):
        grids, at, held, ended = None, None, None, {}

        def take(following):
            grids.add(*(np.frombuffer(held[c], t) for c, t in (("values", np.float64), ("points", np.int64), ("code", np.int32), ("count", np.int64))), following)

        for pdf in batches:
            for row in pdf.to_dict("records"):
                if grids is not None:
                    take(row["v"] if row["to"] == at else math.nan)
                if row["to"] != at:
                    if grids is not None:
                        ended[at] = grids.best()
                    at = row["to"]
                    _, codes, strict = shares[number[at]]
                    grids = Grids(n, budget, codes, strict)
                held = row
        if grids is not None:
            take(math.nan)
            ended[at] = grids.best()
        yield pd.DataFrame({"o": [shares[number[t]][0] for t in ended], "best": list(ended.values())})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(sides) // PACKED_ROWS)
    slices = points.repartitionByRange(tasks, "o", "v").sortWithinPartitions("o", "v").mapInPandas(
        _packed, "o int, v double, values binary, points binary, code binary, count binary")
    to = F.element_at(F.array(*[F.array(*[F.lit(t) for t in ts]) for ts in asked]), F.col("o") + 1)
    sent = slices.withColumn("to", F.explode(to)).repartition(len(shares), F.col("to").cast("bigint")).sortWithinPartitions("to", "v")
    got = sent.mapInPandas(run, "o int, best double").groupBy("o").agg(F.max("best").alias("best")).collect()  # one row a pair
    return {r["o"]: r["best"] for r in got}
