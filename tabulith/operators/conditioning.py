"""Conditioned variants of a table: admissible clamps chosen on a percentile grid.

A column's clamp is a monotone map, so its quantiles follow from a few order
statistics of the raw column; the whole grid costs one quantile job and one
aggregate.  Only the 49 candidates and per-column numbers reach the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rows_frame, agg_dict, drop_missing, numeric_columns, q, value
from ..functions.quantiles import order_stats, quantiles
from ..plans.ledger import operation

# fixed values: the grid, weights, tolerances and budgets
LOW_PCT = (0.5, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0)
HIGH_PCT = (90.0, 92.5, 95.0, 97.0, 98.0, 99.0, 99.5)
WEIGHTS = {"tail_lo": 1.0, "tail_hi": 1.0, "q05_dev": 0.5, "q95_dev": 0.5}
TAIL_TOL, Q_TOL, BUDGET, COLUMN_SHARE = 0.05, 0.20, 0.30, 0.6
SAMPLE_IQRS, SAMPLE_PCT, BOUND_EPS = 3.0, 90.0, 1e-9
SOFTNESS, N_VARIANTS, MIN_ROWS, IQR_FLOOR, TINY = 0.15, 5, 10, 0.01, 1e-12


@dataclass(frozen=True)
class Bound:
    col: str
    lo: float | None = None
    hi: float | None = None


def winsorize(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def soft_clamp(c: Column, lo: float, hi: float, softness: float = SOFTNESS) -> Column:
    """Smooth map of the line into (lo, hi); slope 0.5/softness at the middle."""
    width = hi - lo
    if abs(width) < TINY:
        return c
    return lo + width * (0.5 + 0.5 * F.tanh((c - (lo + hi) / 2) / max(softness * width, TINY)))


def clamp(c: Column, lo: float, hi: float, kind: str = "winsorize", softness: float = SOFTNESS) -> Column:
    return soft_clamp(c, lo, hi, softness) if kind == "soft_clamp" else winsorize(c, lo, hi)


def _clamp_number(x: float, lo: float, hi: float, kind: str, softness: float) -> float:
    if kind == "soft_clamp":
        w = hi - lo
        return x if abs(w) < TINY else lo + w * (0.5 + 0.5 * math.tanh((x - (lo + hi) / 2) / max(softness * w, TINY)))
    return min(max(x, lo), hi)


@dataclass
class Reference:
    """Numbers of one raw column that every candidate is judged against."""
    col: str
    n: int
    q05: float
    q95: float
    iqr: float
    order: dict[int, float]
    low: float
    high: float
    cuts: dict[float, float] = field(default_factory=dict)

    def percentile(self, p: float, fn=lambda v: v) -> float:
        """Quantile of a monotone map of the column."""
        h = (self.n - 1) * p
        k = math.floor(h)
        a, b = fn(self.order[k]), fn(self.order[min(k + 1, self.n - 1)])
        return a + (b - a) * (h - k)


def _near(p: float, n: int) -> set[int]:
    """Ranks around a quantile, enough for the leave-one-out form too."""
    k = math.floor((n - 1) * p)
    return {max(0, min(n - 1, k + d)) for d in (-1, 0, 1, 2)}


def references(df: DataFrame, cols: Sequence[str]) -> dict[str, Reference]:
    probs = (0.05, 0.25, 0.75, 0.95)
    cuts = [p / 100 for p in (*LOW_PCT, *HIGH_PCT)]
    sizes, order = order_stats(df, cols, lambda n: set().union(*[_near(p, n) for p in (*probs, *cuts)]) | {0, n - 1})
    out = {}
    for c in cols:
        n = sizes[c]
        r = Reference(c, n, 0.0, 0.0, 0.0, order[c], order[c][0], order[c][n - 1])
        r.q05, r.q95 = r.percentile(0.05), r.percentile(0.95)
        # a nearly constant column keeps a scale from its range
        r.iqr = max(r.percentile(0.75) - r.percentile(0.25), (r.high - r.low) * IQR_FLOOR, TINY)
        r.cuts = {p: r.percentile(p / 100) for p in (*LOW_PCT, *HIGH_PCT)}
        out[c] = r
    return out


def residuals(df: DataFrame, exprs: Mapping[str, Column], refs: Mapping[str, Reference],
              bounds: Mapping[str, Bound]) -> dict[str, dict[str, float]]:
    """The four constraint residuals per (mapped) column."""
    aggs = {}
    for c, e in exprs.items():
        b = bounds.get(c, Bound(c))
        aggs[(c, "tail_lo")] = F.avg((e < b.lo).cast("double")) if b.lo is not None else F.lit(0.0)
        aggs[(c, "tail_hi")] = F.avg((e > b.hi).cast("double")) if b.hi is not None else F.lit(0.0)
    got, qs = agg_dict(df, aggs), quantiles(df, exprs, (0.05, 0.95))
    return {c: {"tail_lo": got[(c, "tail_lo")] or 0.0, "tail_hi": got[(c, "tail_hi")] or 0.0,
                "q05_dev": abs(qs[c][0] - refs[c].q05) / refs[c].iqr,
                "q95_dev": abs(qs[c][1] - refs[c].q95) / refs[c].iqr} for c in exprs}


def distortion(res: Mapping[str, Mapping[str, float]], tail_tol: float = TAIL_TOL, q_tol: float = Q_TOL) -> float:
    """Weighted excess of the residuals over their tolerances."""
    tol = {"tail_lo": tail_tol, "tail_hi": tail_tol, "q05_dev": q_tol, "q95_dev": q_tol}
    return sum(w * max(0.0, r[name] - tol[name]) for r in res.values() for name, w in WEIGHTS.items())


def displacement(df: DataFrame, col: str, mapped: Column, iqr: float) -> DataFrame:
    """Mean absolute move in IQR units."""
    return df.agg((F.avg(F.abs(mapped - value(df, col))) / max(iqr, TINY)).alias("omega"))


@dataclass
class Candidate:
    lo_pct: float
    hi_pct: float
    d_after: float
    omega: float
    feasible: bool
    params: dict[str, tuple[float, float]]


def grid(df: DataFrame, refs: Mapping[str, Reference], bounds: Mapping[str, Bound], kind: str = "winsorize",
         softness: float = SOFTNESS, tail_tol: float = TAIL_TOL, q_tol: float = Q_TOL,
         budget: float = BUDGET) -> list[Candidate]:
    """All candidates, feasible first, then by distortion and displacement."""
    pairs = [(a, b) for a in LOW_PCT for b in HIGH_PCT]
    moves = {c: _moves(df, r, bounds.get(c, Bound(c)), kind, softness, pairs) for c, r in refs.items()}
    out = []
    for pair in pairs:
        res, omegas, ok, params = {}, [], True, {}
        for c, r in refs.items():
            lo, hi = r.cuts[pair[0]], r.cuts[pair[1]]
            b, m = bounds.get(c, Bound(c)), moves[c][pair]
            def fn(v, lo=lo, hi=hi):
                return _clamp_number(v, lo, hi, kind, softness)
            low, high = fn(r.low), fn(r.high)
            ok &= b.lo is None or low >= b.lo - BOUND_EPS
            ok &= b.hi is None or high <= b.hi + BOUND_EPS
            ok &= m["within"] and m["omega"] <= budget * COLUMN_SHARE
            res[c] = {"tail_lo": m["tail_lo"], "tail_hi": m["tail_hi"],
                      "q05_dev": abs(r.percentile(0.05, fn) - r.q05) / r.iqr,
                      "q95_dev": abs(r.percentile(0.95, fn) - r.q95) / r.iqr}
            omegas.append(m["omega"])
            params[c] = (lo, hi)
        out.append(Candidate(*pair, distortion(res, tail_tol, q_tol), sum(omegas) / max(len(omegas), 1), bool(ok), params))
    return sorted(out, key=lambda c: (not c.feasible, c.d_after, c.omega))


def _moves(df: DataFrame, r: Reference, b: Bound, kind: str, softness: float, pairs) -> dict:
    """Per candidate: displacement, tail shares and the 90th-percentile move check."""
    x, far = value(df, r.col).cast("double"), SAMPLE_IQRS * r.iqr
    if kind == "winsorize":
        # low and high moves never meet on one row, so 14 sums serve all 49 pairs
        aggs = {}
        for p in LOW_PCT:
            aggs[("s", p)], aggs[("f", p)] = F.sum(F.greatest(r.cuts[p] - x, F.lit(0.0))), F.count_if(x < r.cuts[p] - far)
        for p in HIGH_PCT:
            aggs[("s", p)], aggs[("f", p)] = F.sum(F.greatest(x - r.cuts[p], F.lit(0.0))), F.count_if(x > r.cuts[p] + far)
        aggs["below"] = F.count_if(x < b.lo) if b.lo is not None else F.lit(0)
        aggs["above"] = F.count_if(x > b.hi) if b.hi is not None else F.lit(0)
        got = agg_dict(df, aggs)
        raw = {(lo, hi): {
            "omega": (got[("s", lo)] + got[("s", hi)]) / r.n / r.iqr, "near": r.n - got[("f", lo)] - got[("f", hi)],
            "tail_lo": _tail(got["below"], r.n, b.lo is not None, b.lo is not None and r.cuts[lo] >= b.lo,
                             b.lo is not None and r.cuts[hi] < b.lo),
            "tail_hi": _tail(got["above"], r.n, b.hi is not None, b.hi is not None and r.cuts[hi] <= b.hi,
                             b.hi is not None and r.cuts[lo] > b.hi)} for lo, hi in pairs}
    else:
        aggs = {}
        for lo, hi in pairs:
            t = soft_clamp(x, r.cuts[lo], r.cuts[hi], softness)
            aggs[(lo, hi, "omega")] = F.avg(F.abs(t - x)) / r.iqr
            aggs[(lo, hi, "near")] = F.count_if(F.abs(t - x) <= far)
            aggs[(lo, hi, "tail_lo")] = F.avg((t < b.lo).cast("double")) if b.lo is not None else F.lit(0.0)
            aggs[(lo, hi, "tail_hi")] = F.avg((t > b.hi).cast("double")) if b.hi is not None else F.lit(0.0)
        got = agg_dict(df, aggs)
        raw = {(lo, hi): {s: got[(lo, hi, s)] for s in ("omega", "near", "tail_lo", "tail_hi")} for lo, hi in pairs}
    k = math.floor((r.n - 1) * SAMPLE_PCT / 100)
    for (lo, hi), m in raw.items():
        if m["near"] == k + 1 < r.n:  # the limit falls between the two order statistics
            t = clamp(x, r.cuts[lo], r.cuts[hi], kind, softness)
            m["within"] = quantiles(df, {"m": F.abs(t - x)}, [SAMPLE_PCT / 100])["m"][0] <= far
        else:
            m["within"] = m["near"] > k
    return raw


def _tail(outside: int, n: int, bounded: bool, cured: bool, all_out: bool) -> float:
    if not bounded:
        return 0.0
    return 1.0 if all_out else 0.0 if cured else outside / n


def diverse(cands: Sequence[Candidate], k: int = N_VARIANTS, feasible_only: bool = False) -> list[Candidate]:
    """The best candidate, then the ones farthest from those chosen; by displacement."""
    pool = [c for c in cands if c.feasible] or list(cands) if feasible_only else list(cands)
    if not pool:
        return []
    chosen, rest = pool[:1], pool[1:]
    while rest and len(chosen) < k:
        gap = [min((c.lo_pct - s.lo_pct) ** 2 + (c.hi_pct - s.hi_pct) ** 2 for s in chosen) for c in rest]
        chosen.append(rest.pop(gap.index(max(gap))))
    return sorted(chosen, key=lambda c: c.omega)


@dataclass
class Conditioned:
    """A family of variants as parameters; tables stay lazy."""
    df: DataFrame
    cols: list[str]
    kind: str
    softness: float
    variants: list[Candidate]
    best: int
    d_before: float
    residual_rows: list[tuple]
    refs: dict[str, Reference]
    bounds: dict[str, Bound]
    valid: bool = True
    message: str = ""

    def params(self, i: int) -> dict:
        return {"kind": self.kind, "softness": self.softness,
                "columns": {c: list(b) for c, b in self.variants[i].params.items()}}

    def variant(self, i: int) -> DataFrame:
        return apply(self.df, self.params(i))

    def stacked(self) -> DataFrame:
        return stack_variants(self.df, [self.params(i) for i in range(len(self.variants))])

    def variant_table(self) -> DataFrame:
        rows = [(i, c, lo, hi, v.lo_pct, v.hi_pct, v.omega, v.d_after)
                for i, v in enumerate(self.variants) for c, (lo, hi) in v.params.items()]
        return rows_frame(self.df.sparkSession, rows, "variant_id int, col string, lo_val double, hi_val double, lo_pct double, hi_pct double, "
                  "distortion double, d_after double")

    def residual_table(self) -> DataFrame:
        return rows_frame(self.df.sparkSession, self.residual_rows, "col string, constraint string, weight double, residual_before double, tolerance double, "
                                "excess_before double, residual_after_best double, excess_after_best double")


@operation("conditioning")
def apply(df: DataFrame, params: dict) -> DataFrame:
    """Clamp the fitted columns of the full table; missing stays missing."""
    return df.withColumns({c: clamp(value(df, c).cast("double"), lo, hi, params.get("kind", "winsorize"),
                                    params.get("softness", SOFTNESS))
                           for c, (lo, hi) in params["columns"].items() if c in df.columns})


def stack_variants(df: DataFrame, params: Sequence[dict]) -> DataFrame:
    """All variants in one scan: each row fans out to one row per variant."""
    cols = sorted({c for p in params for c in p["columns"]})
    items = []
    for i, p in enumerate(params):
        fields = [F.lit(i).alias("variant_id")]
        for c in cols:
            x = value(df, c).cast("double")
            lo_hi = p["columns"].get(c)
            fields.append((clamp(x, *lo_hi, p["kind"], p["softness"]) if lo_hi else x).alias(c))
        items.append(F.struct(*fields))
    return df.select(*[q(c) for c in df.columns if c not in cols], F.inline(F.array(*items)))


def condition(df: DataFrame, columns: Sequence[str], bounds: Sequence[Bound] = (), *, tail_tol: float = TAIL_TOL,
              q_tol: float = Q_TOL, budget: float = BUDGET, kind: str = "winsorize", softness: float = SOFTNESS,
              n_variants: int = N_VARIANTS, feasible_only: bool = False) -> Conditioned:
    """Fit the whole family: references, residuals, grid, diverse choice."""
    nums = set(numeric_columns(df))
    cols = [c for c in columns if c in nums]
    by = {b.col: b for b in bounds}
    bare = Conditioned(df, cols, kind, softness, [], 0, 0.0, [], {}, by, False, "no numeric columns")
    if not cols:
        return bare
    rows = drop_missing(df, cols)
    n = rows.count()
    if n < MIN_ROWS:
        bare.message = f"only {n} complete rows"
        return bare
    refs = references(rows, cols)
    raw = {c: value(rows, c).cast("double") for c in cols}
    before = residuals(rows, raw, refs, by)
    chosen = diverse(grid(rows, refs, by, kind, softness, tail_tol, q_tol, budget), n_variants, feasible_only)
    best = min(range(len(chosen)), key=lambda i: chosen[i].d_after)
    after = residuals(rows, {c: clamp(raw[c], *chosen[best].params[c], kind, softness) for c in cols}, refs, by)
    tol = {"tail_lo": tail_tol, "tail_hi": tail_tol, "q05_dev": q_tol, "q95_dev": q_tol}
    table = [(c, k, w, before[c][k], tol[k], max(0.0, before[c][k] - tol[k]), after[c][k], max(0.0, after[c][k] - tol[k]))
             for c in cols for k, w in WEIGHTS.items()]
    return Conditioned(df, cols, kind, softness, chosen, best, distortion(before, tail_tol, q_tol), table, refs, by)


def influence(df: DataFrame, refs: Mapping[str, Reference], bounds: Mapping[str, Bound], tail_tol: float = TAIL_TOL,
              q_tol: float = Q_TOL) -> DataFrame:
    """Exact leave-one-out effect of each row on the distortion, per column and total.

    Leaving one row out moves a quantile to one of a few neighbouring order
    statistics, so the exact value is a row expression at any table size."""
    aggs = {}
    for c in refs:
        x, b = value(df, c), bounds.get(c, Bound(c))
        aggs[(c, "lo")] = F.count_if(x < b.lo) if b.lo is not None else F.lit(0)
        aggs[(c, "hi")] = F.count_if(x > b.hi) if b.hi is not None else F.lit(0)
    got = agg_dict(df, aggs)
    out = {}
    for c, r in refs.items():
        x, b, n = value(df, c).cast("double"), bounds.get(c, Bound(c)), r.n
        total = F.lit(0.0)
        if n > 1:
            for side, w, limit in (("lo", WEIGHTS["tail_lo"], b.lo), ("hi", WEIGHTS["tail_hi"], b.hi)):
                if limit is not None:
                    k = got[(c, side)]
                    full = max(0.0, k / n - tail_tol)
                    inside, outside = max(0.0, k / (n - 1) - tail_tol), max(0.0, (k - 1) / (n - 1) - tail_tol)
                    hit = x < limit if side == "lo" else x > limit
                    total = total + F.when(hit, w * (full - outside)).otherwise(w * (full - inside))
            for p, ref, w in ((0.05, r.q05, WEIGHTS["q05_dev"]), (0.95, r.q95, WEIGHTS["q95_dev"])):
                full = max(0.0, abs(r.percentile(p) - ref) / r.iqr - q_tol)
                h = p * (n - 2)
                k, f = math.floor(h), h - math.floor(h)
                s = [r.order[max(0, min(n - 1, k + d))] for d in (0, 1, 2)]
                low = F.when(x <= s[0], s[1]).otherwise(s[0])
                high = F.when(x <= s[1], s[2]).otherwise(s[1])
                loo = low * (1 - f) + high * f
                total = total + w * (full - F.greatest(F.abs(loo - ref) / r.iqr - q_tol, F.lit(0.0)))
        out[f"evi_{c}"] = F.when(x.isNotNull(), total)
    df = df.withColumns(out)
    return df.withColumn("evi_total", sum((F.coalesce(q(c), F.lit(0.0)) for c in out), F.lit(0.0)))
