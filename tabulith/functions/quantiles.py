"""Exact quantiles (linear interpolation) and moments.

A quantile needs one or two order statistics.  Columns of at most ``EXACT_ROWS``
values are sorted in one bounded array.  Above that no task may hold a column,
so the order statistics are selected: a bounded sketch gives cut points, one
scan counts what lies on each cut and between cuts, and the gaps that hold a
wanted rank are cut again, several thousandfold per scan, until their values
fit in an array.  The answer is exact in both cases."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import agg_dict, rows_frame, value

EXACT_ROWS = 1_000_000
#: Values sorted by one task at a time, over all columns of a job.
ARRAY_VALUES = 3_000_000
#: a gap between cuts with at most so many values is sorted in one array
BRACKET_VALUES = 16_384
#: parts of a gap and accuracy of the sketch that cuts it, and gaps handled by one scan
_GRID, _ACCURACY, _GAPS = 5_000, 10_000, 20_000


def _as_exprs(df: DataFrame, cols: Iterable[str] | Mapping[str, Column]) -> dict[str, Column]:
    if isinstance(cols, Mapping):
        return {k: v.cast("double") for k, v in cols.items()}
    return {c: value(df, c).cast("double") for c in cols}


def quantiles(df: DataFrame, cols, probs: Iterable[float], *,
              exact_rows: int | None = None) -> dict[str, list]:
    """``{column: [quantile, ...]}``; None for a column without values.

    ``cols`` is a list of names or a mapping of label to Column."""
    exprs, probs = _as_exprs(df, cols), [float(p) for p in probs]
    if not exprs:
        return {}

    def ranks(n):
        return {r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}

    sizes, found = order_stats(df, exprs, ranks, exact_rows=exact_rows)
    return {k: [_interpolate(found[k], n, p) for p in probs] for k, n in sizes.items()}


def _interpolate(values: dict[int, float], n: int, p: float) -> float | None:
    if not n:
        return None
    h = (n - 1) * p
    a, b = values[math.floor(h)], values[math.ceil(h)]
    return a + (b - a) * (h - math.floor(h))


def order_stats(df: DataFrame, cols, ranks_of, *, exact_rows: int | None = None) -> tuple[dict, dict]:
    """({column: count}, {column: {rank: value}}) for ranks chosen from the count."""
    exprs = _as_exprs(df, cols)
    sizes = agg_dict(df, {k: F.count(e) for k, e in exprs.items()})
    want = {k: {r for r in ranks_of(n) if 0 <= r < n} for k, n in sizes.items()}
    if max(sizes.values(), default=0) > (EXACT_ROWS if exact_rows is None else exact_rows):
        return sizes, order_statistics(df, exprs, sizes, want)
    return sizes, _sorted_picks(df, exprs, sizes, want)


def _picked(array: str, ranks: list[int]) -> Column:
    """Elements of a sorted array at 0-based ranks, in an expression of bounded depth.

    The array is bound to a variable of its own: the optimizer moves a column's expression to each place that names the
    column, and inside the inner function it would be sorted anew for every rank."""
    wanted = F.array(*[F.lit(r + 1) for r in ranks])
    return F.transform(F.array(array), lambda a: F.transform(wanted, lambda r: F.element_at(a, r)))[0]


def _sorted_picks(df: DataFrame, exprs: dict[str, Column], sizes: dict[str, int], want: dict[str, set[int]]) -> dict:
    """Order statistics of bounded columns: sort each in one array, return only the picks."""
    out: dict[str, dict[int, float]] = {k: {} for k in exprs}
    keys = [k for k, w in want.items() if w]
    step = max(1, ARRAY_VALUES // max(max(sizes.values(), default=1), 1))
    for at in range(0, len(keys), step):
        part = keys[at:at + step]
        arrays = df.agg(*[F.sort_array(F.collect_list(exprs[k])).alias(f"a{i}") for i, k in enumerate(part)])
        picks = arrays.select(*[_picked(f"a{i}", sorted(want[k])) for i, k in enumerate(part)]).first()
        for i, k in enumerate(part):
            out[k] = dict(zip(sorted(want[k]), picks[i]))
    return out


def order_statistics(df: DataFrame, exprs: dict[str, Column], sizes: dict[str, int],
                     want: dict[str, set[int]]) -> dict[str, dict[int, float]]:
    """Exact order statistics (0-based rank -> value) for each expression.

    Cut points part a column into gaps. One scan counts for all columns at once how many values equal each cut and lie in each
    gap, by binary search, however many ranks are wanted; gaps that hold a wanted rank get cuts of their own until all are small."""
    names = [k for k in exprs if want[k]]
    found: dict[str, dict[int, float]] = {k: {} for k in exprs}
    rows = df.select(*[exprs[k].alias(f"c{i}") for i, k in enumerate(names)])
    # gaps that hold wanted ranks: column, ends, values up to the lower end, values inside, ranks
    todo = [(i, None, None, 0, sizes[k], sorted(want[k])) for i, k in enumerate(names)]
    while True:
        small = [t for t in todo if t[4] <= BRACKET_VALUES]
        for at in range(0, len(small), _GAPS):
            for (i, _lo, _hi, below, _n, ranks), got in zip(small[at:at + _GAPS], _gap_picks(rows, small[at:at + _GAPS])):
                found[names[i]].update(zip(ranks, got))
        todo = [t for t in todo if t[4] > BRACKET_VALUES]
        if not todo:
            return found
        nxt = []
        for at in range(0, len(todo), _GAPS):
            nxt += _split(rows, todo[at:at + _GAPS], names, found)
        todo = nxt


def _split(rows: DataFrame, gaps: list[tuple], names: list[str], found: dict) -> list[tuple]:
    """The parts of the gaps that hold wanted ranks; ranks of values that equal a cut are found."""
    if all(lo is None and hi is None for _, lo, hi, *_ in gaps):
        grid = {g: F.percentile_approx(f"c{t[0]}", _shares(t[4]), _ACCURACY) for g, t in enumerate(gaps)}
        sketch = agg_dict(rows, grid)
    else:
        most = _shares(max(t[4] for t in gaps))
        sketch = {r["g"]: r["at"] for r in _in_gaps(rows, gaps).groupBy("g").agg(F.percentile_approx("v", most, _ACCURACY).alias("at")).collect()}
    cuts: dict[int, set] = {}
    for g, (i, lo, hi, *_) in enumerate(gaps):
        cuts.setdefault(i, set()).update(x + 0.0 for x in [*sketch[g], lo, hi] if x is not None and x == x)
    # NaN is greater than all numbers and a cut of its own
    ordered = {i: np.array([*sorted(c), math.nan]) for i, c in cuts.items()}

    def counted(batches):
        total = {i: np.zeros(2 * len(c) + 1, np.int64) for i, c in ordered.items()}
        for batch in batches:
            for i, c in ordered.items():
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                at = np.searchsorted(c, x)
                total[i] += np.bincount(2 * at + ((c[at] == x) | np.isnan(x)), minlength=len(total[i]))
        for i, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(at), i, np.int32)), "at": pa.array(at), "n": pa.array(n[at])})

    counts = {i: np.zeros(2 * len(c) + 1, np.int64) for i, c in ordered.items()}
    for r in rows.mapInArrow(counted, "i int, at bigint, n bigint").groupBy("i", "at").agg(F.sum("n").alias("n")).collect():  # one row for each cut and gap
        counts[r["i"]][r["at"]] = r["n"]
    out: dict = {}
    for i, _lo, _hi, _below, _n, ranks in gaps:
        c, upto = ordered[i], np.cumsum(counts[i])
        for r, at in zip(ranks, np.searchsorted(upto, ranks, "right").tolist()):
            if at % 2:
                found[names[i]][r] = float(c[at // 2])
            else:
                inside = int(counts[i][at])
                part = (i, float(c[at // 2 - 1]) if at else None, float(c[at // 2]), int(upto[at]) - inside, inside)
                out.setdefault(part, []).append(r)
    return [(*part, ranks) for part, ranks in out.items()]


def _shares(inside: int) -> Column:
    """Parts of a gap, so many that most will be small."""
    parts = min(_GRID, max(8, 4 * inside // BRACKET_VALUES))
    return F.lit(np.linspace(0.0, 1.0, parts + 1))


def _in_gaps(rows: DataFrame, gaps: list[tuple]) -> DataFrame:
    """``g, v``: the values inside each gap; gaps of a column do not overlap."""
    of: dict[int, list[tuple]] = {}
    for g, (i, lo, hi, *_) in enumerate(gaps):
        of.setdefault(i, []).append((-math.inf if lo is None else lo, math.inf if hi is None else hi, lo is None, hi is None, g))
    sides = {}
    for i, found in of.items():
        found.sort()
        sides[i] = [np.array(x) for x in zip(*found)]

    def inside(batches):
        for batch in batches:
            for i, (lo, hi, first, last, g) in sides.items():
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                # the last gap that begins below the value; a gap without a lower end holds all below its upper one
                at = np.searchsorted(lo, x) - 1
                at = np.where((at < 0) & first[0], 0, at)
                ok = (at >= 0) & ((x < hi[at]) | last[at] | (np.isnan(hi[at]) & ~np.isnan(x)))
                yield pa.RecordBatch.from_pydict({"g": pa.array(g[at[ok]], pa.int32()), "v": pa.array(x[ok], pa.float64())})

    return rows.mapInArrow(inside, "g int, v double")


def _gap_picks(rows: DataFrame, gaps: list[tuple]) -> list[list[float]]:
    """The values at the wanted ranks of small gaps, each sorted in one bounded array."""
    places = {g: [r - below for r in ranks] for g, (_i, _lo, _hi, below, _n, ranks) in enumerate(gaps)}
    wanted = rows_frame(rows.sparkSession, list(places.items()), "g int, places array<int>")
    arrays = _in_gaps(rows, gaps).groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("a")).join(F.broadcast(wanted), "g")
    picks = {r["g"]: r["p"] for r in arrays.select("g", F.transform(F.array("a"), lambda a: F.transform("places", lambda p: F.get(a, p)))[0].alias("p")).collect()}
    return [picks[g] for g in range(len(gaps))]


def moments(df: DataFrame, cols) -> dict[str, dict]:
    """Count, mean, deviations, extremes, population skewness and excess kurtosis.

    Sample-corrected ``skew_sample``/``kurt_sample`` follow the usual G1/G2 factors."""
    exprs = _as_exprs(df, cols)
    aggs = {}
    for k, e in exprs.items():
        for name, fn in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp),
                         ("sd0", F.stddev_pop), ("min", F.min), ("max", F.max)):
            aggs[(k, name)] = fn(e)
    base = agg_dict(df, aggs)
    out = {k: {s: base[(k, s)] for s in ("n", "mean", "sd", "sd0", "min", "max")} for k in exprs}
    spread = {k: e for k, e in exprs.items() if out[k]["sd0"]}
    shape = agg_dict(df, {(k, s): fn(e) for k, e in spread.items()
                          for s, fn in (("skew", F.skewness), ("kurt", F.kurtosis))})
    for k, m in out.items():
        n, g1, g2 = m["n"], shape.get((k, "skew")), shape.get((k, "kurt"))
        m["skew"], m["kurt"] = g1, g2
        m["skew_sample"] = g1 * math.sqrt(n * (n - 1)) / (n - 2) if g1 is not None and n > 2 else None
        m["kurt_sample"] = ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
                            if g2 is not None and n > 3 else None)
    return out
