"""Order-dependent primitives without a single-partition window.

Spark tables have no row order, so an order is named by key columns.  Rows are
cut into value ranges at sketched split points (``order_bucket``); a window then
runs inside each range and per-range summaries carry the state across ranges."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .columns import agg_dict, q, value

ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 10_000
#: Ranges at or below this many rows may be broadcast (one summary row each).
BLOCK, _B2 = "__bucket", "__bucket2"


def bucket_count(rows: int) -> int:
    return max(2, min(MAX_BUCKETS, math.ceil(rows / ROWS_PER_BUCKET)))


def _splits(points) -> tuple[list[float], list[float]]:
    """Inner split points, and the hot values (several quantiles equal)."""
    points = [float(p) for p in points or [] if p is not None and math.isfinite(p)]
    hot = sorted({a for a, b in zip(points, points[1:]) if a == b})
    cuts = set(points)
    for h in hot:  # a hot value gets a range of its own
        cuts.add(math.nextafter(h, math.inf))
    return sorted(cuts) or [0.0], hot


def _bucketize(df: DataFrame, col: str, out: str, cuts: Sequence[float]) -> DataFrame:
    edges = [-math.inf, *cuts, math.inf]
    return Bucketizer(splits=edges, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def order_number(df: DataFrame, name: str) -> Column:
    """A double that never falls as the key rises (text by its first six bytes); keys may share one."""
    t, c = df.schema[name].dataType, q(name)
    if isinstance(t, T.StringType):
        head = F.hex(F.substring(F.encode(c, "utf-8"), 1, 6))
        return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
    if isinstance(t, (T.DateType, T.TimestampNTZType)):
        c = c.cast("timestamp")
    return c.cast("double")


def order_bucket(df: DataFrame, keys: Sequence[str], out: str = BLOCK,
                 buckets: int | None = None) -> DataFrame:
    """Add ``out``: a range number that never falls as the keys rise, compared one after another.

    A number made from the first key cuts the ranges. Where many rows share that number, because the
    key is frequent or because the number holds only its start, the whole keys themselves cut further,
    so only rows with all keys equal have to stay together. Rows without a first key come first."""
    n = None
    if buckets is None:
        n = df.count()
        buckets = bucket_count(n)
    k1 = F.coalesce(order_number(df, keys[0]), F.lit(-sys.float_info.max))
    probs = [i / buckets for i in range(1, buckets)]
    acc = max(10_000, 10 * buckets)
    points = df.agg(F.percentile_approx(k1, probs, acc)).first()[0]
    cuts, hot = _splits(points)
    df = _bucketize(df.withColumn("__k1", k1), "__k1", "__b1", cuts)
    inner = F.lit(0)
    if hot:
        df, inner = _cut_hot(df, keys, Counter(points), hot, df.count() if n is None else n, buckets)
    return df.withColumn(out, (F.col("__b1") * 1048576 + inner).cast("long")).drop("__k1", "__b1", "__coarse", "__fine", "__g")


#: Sampled rows for each wanted cut, and cuts that one row is compared with at a time.
_SAMPLED, _GROUP = 40, 64


def _cut_hot(df: DataFrame, keys: Sequence[str], weight: Counter, hot: list[float], rows: int, buckets: int):
    """Number of whole-key cuts at or below each row of a hot number, finer the hotter it is.

    The cuts are every fortieth row, in key order, of a sample of at most some forty rows for each
    range. They are searched in two steps; both tables have at most one row for each range."""
    key = F.struct(*[q(k) for k in keys])
    share = min(1.0, _SAMPLED * buckets / max(rows, 1))
    wanted = F.lit(0)
    for h in hot:
        wanted = F.when(F.col("__k1") == h, F.lit(weight[h] + 1)).otherwise(wanted)
    sampled = (df.filter(F.col("__k1").isin(hot)).sample(share, seed=11).select("__k1", wanted.alias("m"), key.alias("key"))
               .groupBy("__k1", "m").agg(F.sort_array(F.collect_list("key")).alias("all")))
    step = F.greatest(F.lit(1), F.floor(F.size("all") / F.col("m"))).cast("int")
    found = sampled.withColumn("cuts", F.array_distinct(F.filter("all", lambda k, i: (i > 0) & (i % step == 0)))).select("__k1", "cuts").filter(F.size("cuts") > 0)
    found = cut_lineage(found)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("cuts") - 1) / _GROUP).cast("int")), lambda i: F.slice("cuts", i * _GROUP + 1, _GROUP))
    coarse = found.select("__k1", F.transform(groups, lambda g: g[0]).alias("__coarse"))
    fine = found.select("__k1", F.posexplode(groups)).select("__k1", (F.col("pos") + 1).alias("__g"), F.col("col").alias("__fine"))
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c <= key))
    df = df.join(F.broadcast(coarse), "__k1", "left").withColumn("__g", F.when(F.col("__coarse").isNotNull(), below("__coarse")).otherwise(F.lit(0)))
    df = df.join(F.broadcast(fine), ["__k1", "__g"], "left")
    return df, F.when(F.col("__fine").isNotNull(), (F.col("__g") - 1) * _GROUP + below("__fine")).otherwise(F.lit(0))


def running(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column],
            partition: Sequence[str] = (), inclusive: bool = False,
            bucketed: bool = False) -> DataFrame:
    """Add running sums in key order (before each row, or through it).

    Per-range totals are prefix-summed and joined back as offsets, so no task
    sees more than one range."""
    part = list(partition)
    if not bucketed:
        df = order_bucket(df, keys)
    df = df.withColumns({f"__in_{n}": e for n, e in sums.items()})
    totals = df.groupBy(*part, BLOCK).agg(*[F.sum(f"__in_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*part).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, BLOCK, *[
        F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    if not part:  # at most one row per range
        offsets = F.broadcast(offsets)
    joined = df.join(offsets, [*part, BLOCK])
    w = Window.partitionBy(*part, BLOCK).orderBy(*[q(k) for k in keys]) \
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = joined.withColumns({
        n: F.col(f"__o_{n}") + F.coalesce(F.sum(f"__in_{n}").over(w), F.lit(0)) for n in sums})
    return out.drop(BLOCK, *[f"__in_{n}" for n in sums], *[f"__o_{n}" for n in sums])


def dense_index(df: DataFrame, keys: Sequence[str], out: str = "idx",
                partition: Sequence[str] = ()) -> DataFrame:
    """0-based row position in key order; keys must order the rows totally."""
    return running(df, keys, {out: F.lit(1).cast("long")}, partition)


def halo(df: DataFrame, index: str, before: int, after: int = 0,
         partition: Sequence[str] = (), rows: int = ROWS_PER_BUCKET) -> tuple[DataFrame, Window]:
    """Blocks of consecutive rows, each with copies of its neighbours' edge rows.

    Returns the frame and the window to use; keep rows where ``__home`` is true
    after computing frames that reach ``before`` back and ``after`` forward."""
    rows = max(rows, before, after, 1)
    block, pos = F.floor(q(index) / rows), F.pmod(q(index), F.lit(rows))
    copies = [F.struct(block.alias("b"), F.lit(True).alias("home"))]
    if before:
        copies.append(F.when(pos >= rows - before, F.struct((block + 1).alias("b"), F.lit(False).alias("home"))))
    if after:
        copies.append(F.when((pos < after) & (block > 0), F.struct((block - 1).alias("b"), F.lit(False).alias("home"))))
    out = df.withColumn("__c", F.explode(F.array_compact(F.array(*copies))))
    out = out.withColumns({BLOCK: F.col("__c.b"), "__home": F.col("__c.home")}).drop("__c")
    return out, Window.partitionBy(*partition, BLOCK).orderBy(q(index))


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter("__home").drop("__home", BLOCK)


def with_lags(df: DataFrame, index: str, lags: Mapping[str, tuple[str, int]],
              partition: Sequence[str] = ()) -> DataFrame:
    """``lags``: new name -> (column, distance back)."""
    reach = max(k for _, k in lags.values())
    out, w = halo(df, index, reach, 0, partition)
    return home_rows(out.withColumns({n: F.lag(q(c), k).over(w) for n, (c, k) in lags.items()}))


def rank_table(df: DataFrame, col: str, partition: Sequence[str] = (),
               points: list | None = None) -> DataFrame:
    """One row per distinct value: ``v, cnt, below, rank`` (average rank)."""
    part = list(partition)
    # declared non-null, so no inferred filter sets the two readers of the counts apart
    # and their shuffle is shared
    counts = (df.select(*part, value(df, col).cast("double").alias("v")).filter("v is not null")
              .withColumn("v", F.coalesce("v", F.lit(0.0))).groupBy(*part, "v").agg(F.count("*").alias("cnt")))
    if points is not None:
        counts = _bucketize(counts, "v", BLOCK, _splits(points)[0]).withColumn(BLOCK, F.coalesce(F.col(BLOCK).cast("long"), F.lit(0)))
    got = running(counts, ["v"], {"below": F.col("cnt")}, part, bucketed=points is not None)
    return got.withColumn("rank", F.col("below") + (F.col("cnt") + 1) / 2.0)


#: Rank tables at or below this many rows are broadcast to the rows.
BROADCAST_VALUES = 200_000


def with_ranks(df: DataFrame, cols: Sequence[str], names: Mapping[str, str] | None = None,
               extra: Sequence[str] = ()) -> DataFrame:
    """Add average ranks of each column (``<col>_rank`` unless named).

    Ranks come from value counts, so ties cost nothing and a hot value is one
    row of the table joined back; the join broadcasts only a counted table."""
    names = dict(names or {c: f"{c}_rank" for c in cols})
    vals = {c: value(df, c).cast("double") for c in cols}
    n = df.count()
    probs = [i / bucket_count(n) for i in range(1, bucket_count(n))]
    acc = max(10_000, 10 * len(probs))
    stats = agg_dict(df, {(c, s): e for c, v in vals.items() for s, e in (
        ("pts", F.percentile_approx(v, probs, acc)), ("ndv", F.approx_count_distinct(v)))})
    out = df
    for i, c in enumerate(cols):
        table = rank_table(df, c, points=stats[(c, "pts")] or [])
        table = table.select(F.col("v").alias(f"__v{i}"), F.col("rank").alias(names[c]),
                             *[F.col(x).alias(f"{names[c]}_{x}") for x in extra])
        # the 5 % sketch error leaves a wide margin under the bound
        if stats[(c, "ndv")] <= BROADCAST_VALUES:
            table = F.broadcast(table)
        out = out.withColumn(f"__v{i}", vals[c]).join(table, f"__v{i}", "left").drop(f"__v{i}")
    return out


def fill_edges(df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column], forward: bool,
               partition: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Carry the nearest earlier (or later) non-null value of each expression.

    Adds ``name`` for each entry; the row's own value counts.  ``dense`` says
    the key is a row position, which needs no sketch to cut into ranges."""
    part = list(partition)
    df = df.withColumn(BLOCK, F.floor(q(keys[0]) / ROWS_PER_BUCKET)) if dense else order_bucket(df, keys)
    df = df.withColumns({f"__in_{n}": e for n, e in cols.items()})
    order = F.struct(*[q(k) for k in keys])
    pick = F.max_by if forward else F.min_by
    ends = df.groupBy(*part, BLOCK).agg(*[
        pick(F.col(f"__in_{n}"), F.when(F.col(f"__in_{n}").isNotNull(), order)).alias(f"__e_{n}") for n in cols])
    # backward fills run over the reversed order: a frame that grows from its start is
    # one pass, one that shrinks towards the end is recomputed for every row
    def way(name):
        return q(name).asc() if forward else q(name).desc()

    outer = Window.partitionBy(*part).orderBy(way(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*part, BLOCK, *[F.last(F.col(f"__e_{n}"), ignorenulls=True).over(outer).alias(f"__c_{n}") for n in cols])
    if not part:
        carry = F.broadcast(carry)
    w = Window.partitionBy(*part, BLOCK).orderBy(*[way(k) for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(carry, [*part, BLOCK]).withColumns({
        n: F.coalesce(F.last(F.col(f"__in_{n}"), ignorenulls=True).over(w), F.col(f"__c_{n}")) for n in cols})
    return out.drop(BLOCK, *[f"__{p}_{n}" for n in cols for p in ("in", "c")])
