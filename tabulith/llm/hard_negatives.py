"""Hard negatives of embeddings by table look-ups (the method of the Four Russians).

Components become integers. Every row is stored as packed bit planes: for each binary digit of its components, one byte for
every eight dimensions. An anchor gets, for every eight dimensions, a table of the 256 sums of subsets of its components
there. An inner product is then a sum of shifted look-ups, ``sum over planes p of 2^p sum over groups g of table[g][byte]``,
exact to the last digit."""

from __future__ import annotations

import math
from functools import partial
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: one step of a component
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: negatives score between these hundredths of the positive's score
LOW, HIGH = 50, 95
#: rows and anchors that meet in one tile, at most on average; the packed rows of a tile take some 25 MB
TILE_ROWS, TILE_ANCHORS = 262_144, 32_768
#: look-up tables and scores of so many anchors and rows are held at a time (2 MB each)
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 128, 2_048
#: subsets of the components of eight dimensions, as rows of zeros and ones
SUBSETS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)

PACKED = "id bigint, label bigint, planes binary, seq bigint"
ANCHORS = "seq bigint, id bigint, label bigint, vector array<bigint>"


def pack(vectors: np.ndarray, digits: int) -> np.ndarray:
    """Bit planes of integer rows in two's complement: rows x (planes * groups) bytes, the plane of the sign last."""
    n, groups = len(vectors), -(-vectors.shape[1] // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :vectors.shape[1]] = vectors
    planes = [np.packbits(((wide >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(digits)]
    return np.concatenate(planes, axis=1) if planes else np.zeros((n, 0), np.uint8)


def tables(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """groups x 256 x anchors: sums of all subsets of each eight dimensions."""
    n, groups = len(anchors), -(-anchors.shape[1] // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :anchors.shape[1]] = anchors
    return np.stack([SUBSETS @ wide[:, g * 8:g * 8 + 8].T for g in range(groups)]).astype(kind) if groups else np.zeros((0, 256, n), kind)


def scores(table: np.ndarray, planes: np.ndarray, digits: int) -> np.ndarray:
    """rows x anchors inner products, by shifted look-ups; the plane of the sign counts negative."""
    groups = len(table)
    total = np.zeros((len(planes), table.shape[2]), table.dtype)
    found = np.empty_like(total)
    for p in range(digits - 1, -1, -1):  # Horner's rule: shift, then add
        total += total
        for g in range(groups):
            np.take(table[g], planes[:, p * groups + g], axis=0, out=found, mode="clip")
            if p == digits - 1:
                total -= found
            else:
                total += found
    return total


def _best(keep: int, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the first ``keep`` of each (anchor, slot): higher scores, then earlier rows."""
    order = np.lexsort((row, -score, slot, anchor))
    a, s = anchor[order], slot[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < keep]


def _search(rows: pa.Table, anchors: pa.Table, digits: int, width: int, kind, windows: list | None) -> tuple[list, ...]:
    """The first rows of a tile for its anchors: POSITIVES of the same label, or NEGATIVES of other labels for each window.

    windows: for each anchor its (positive's place, least score, greatest score); None searches the positives."""
    order = np.lexsort((rows["seq"].to_numpy(), rows["id"].fill_null(np.iinfo(np.int64).max).to_numpy(), rows["id"].is_null().to_numpy(zero_copy_only=False)))
    planes = np.frombuffer(b"".join(rows["planes"].to_pylist()), np.uint8).reshape(len(order), -1)[order]
    label, seq = rows["label"].to_numpy()[order], rows["seq"].to_numpy()[order]
    own, own_label = anchors["seq"].to_numpy(), anchors["label"].to_numpy()
    vectors = np.zeros((len(own), width), np.int64)
    for i, v in enumerate(anchors["vector"].to_pylist()):
        vectors[i, :len(v)] = v
    keep = POSITIVES if windows is None else NEGATIVES
    out = []
    by_label = np.argsort(own_label, kind="stable")
    for at in range(0, len(own), ANCHORS_AT_ONCE):
        # anchors of one label stand together, so that few rows are scored in vain for positives
        chosen = by_label[at:at + ANCHORS_AT_ONCE]
        table = tables(vectors[chosen], kind)
        usable = np.flatnonzero(np.isin(label, own_label[chosen])) if windows is None else np.arange(len(label))
        slots = 1 if windows is None else max(len(windows[c]) for c in chosen)
        low, high = np.full((slots, len(chosen)), 1, np.int64), np.zeros((slots, len(chosen)), np.int64)
        for j, c in enumerate(chosen):
            for s, (_, lo, hi) in enumerate(windows[c] if windows is not None else [(0, np.iinfo(np.int64).min, np.iinfo(np.int64).max)]):
                low[s, j], high[s, j] = lo, hi
        best = [np.zeros(0, np.int64)] * 4
        for start in range(0, len(usable), ROWS_AT_ONCE):
            part = usable[start:start + ROWS_AT_ONCE]
            got = scores(table, planes[part], digits)
            same = label[part][:, None] == own_label[chosen][None, :]
            fits = same & (seq[part][:, None] != own[chosen][None, :]) if windows is None else ~same
            more = [best]
            for s in range(slots):
                r, a = np.nonzero(fits & (got >= low[s]) & (got <= high[s]))
                more.append([a, np.full(len(a), s), got[r, a].astype(np.int64), part[r]])
            best = [np.concatenate(x) for x in zip(*more)]
            first = _best(keep, *best)
            best = [x[first] for x in best]
            # what cannot come in any more: rows are taken in order of their ids, so a later one must score higher
            a, s, score, _ = best
            full = np.bincount(a * slots + s, minlength=len(chosen) * slots) >= keep
            least = np.full(len(chosen) * slots, np.iinfo(np.int64).max)
            np.minimum.at(least, a * slots + s, score)
            least = np.where(full, least + 1, np.iinfo(np.int64).min).reshape(len(chosen), slots).T
            low = np.maximum(low, least)
        out.append([chosen[best[0]], *best[1:]])
    anchor, slot, score, row = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
    return anchor, slot, score, order[row]


def _positives(anchors: pa.Table, rows: pa.Table, digits: int, width: int, kind) -> pa.Table:
    schema = pa.schema([("seq", pa.int64()), ("positive_seq", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    if not len(rows) or not len(anchors):
        return schema.empty_table()
    anchor, _, score, row = _search(rows, anchors, digits, width, kind, None)
    return pa.Table.from_arrays([anchors["seq"].take(pa.array(anchor)).combine_chunks(), rows["seq"].take(pa.array(row)).combine_chunks(),
                                 rows["id"].take(pa.array(row)).combine_chunks(), pa.array(score)], schema=schema)


def _negatives(anchors: pa.Table, rows: pa.Table, digits: int, width: int, kind) -> pa.Table:
    schema = pa.schema([("seq", pa.int64()), ("positive_seq", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    if not len(rows) or not len(anchors):
        return schema.empty_table()
    windows = [[(p["positive_seq"], -(-LOW * p["positive_score"] // 100), HIGH * p["positive_score"] // 100) for p in ps] for ps in anchors["positives"].to_pylist()]
    anchor, slot, score, row = _search(rows, anchors, digits, width, kind, windows)
    positive = pa.array([windows[a][s][0] for a, s in zip(anchor, slot)], pa.int64())
    return pa.Table.from_arrays([anchors["seq"].take(pa.array(anchor)).combine_chunks(), positive, rows["id"].take(pa.array(row)).combine_chunks(), pa.array(score)], schema=schema)


def _packed(batches: Iterator[pa.RecordBatch], digits: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        vectors = np.zeros((len(batch), width), np.int64)
        for i, v in enumerate(batch.column(2).to_pylist()):
            vectors[i, :len(v)] = v
        bits = pack(vectors, digits)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in bits], pa.binary()), batch.column(3)], names=["id", "label", "planes", "seq"])


def quantised(df: DataFrame, *, key: str, vector: str, label: str) -> DataFrame:
    """id, label, vector (floor of SCALE times each component) and seq (a number of the row), of the rows that take part."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    fine = F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"),
                                 F.transform(v, lambda x: F.floor(x * SCALE)).alias("vector"), F.monotonically_increasing_id().alias("seq"))


def index(rows: DataFrame) -> tuple[DataFrame, int, int, type]:
    """The packed rows, with the digits of a component, the width of a vector, and the integers that hold every score."""
    got = rows.agg(F.max(F.size("vector")).alias("width"), F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high")).first()
    width, low, high = got["width"] or 0, got["low"] or 0, got["high"] or 0
    digits = max((~low if low < 0 else low).bit_length(), (~high if high < 0 else high).bit_length()) + 1
    # every partial sum of the shifted look-ups is below 2^digits times the sum of the anchor's components
    bits = 2 * digits + math.ceil(math.log2(max(width, 1) + 1)) + 1
    if bits > 63:
        raise ArithmeticError("scores do not fit in 64 bits")
    packed = rows.mapInArrow(partial(_packed, digits=digits, width=width), PACKED)
    return packed, digits, width, np.int32 if bits <= 31 else np.int64


def _tiles(anchors: DataFrame, packed: DataFrame, n_anchors: int, n_rows: int, search, schema: str) -> DataFrame:
    """Every block of anchors against every block of rows, a tile to a group; blocks are bounded, whatever the rows are like."""
    spark = packed.sparkSession
    across = -(-n_anchors // TILE_ANCHORS)
    down = max(-(-n_rows // TILE_ROWS), -(-4 * spark.sparkContext.defaultParallelism // across))
    a = anchors.withColumn("across", F.pmod(F.xxhash64("seq"), F.lit(across))).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)).cast("array<bigint>")))
    r = packed.withColumn("down", F.pmod(F.xxhash64("seq"), F.lit(down))).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<bigint>")))
    return a.groupBy("across", "down").cogroup(r.groupBy("across", "down")).applyInArrow(search, schema)


def mine(df: DataFrame, anchors, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: the hard negatives of the rows that ``anchors`` (a condition on id) names.

    Each row is a row of its own, so a repeated row may be the positive of its copy and repeated anchors each give their
    answers. Rows without a label or vector, or with a component that is null or not finite, take no part; rows without an
    id do, and come last among ties. Missing components of shorter vectors count as zero. ``label`` may be an expression.
    Scores beyond 64 bits raise ArithmeticError. No anchor, no positive or no negative gives no row.

    Two searches over the same packed rows: the first finds the positives, the second the negatives within their windows.
    Each is a grid of tiles, blocks of anchors by blocks of rows, from which only the first rows for each anchor come back."""
    name, = fresh(df, "label")
    rows = stored(quantised(df.withColumn(name, label if not isinstance(label, str) else F.col(f"`{label}`")), key=key, vector=vector, label=name), "vectors")
    asked = stored(rows.where(anchors).select("seq", "id", "label", "vector"), "anchors")
    n_anchors, n_rows = asked.count(), rows.count()
    empty = df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if not n_anchors:
        return empty
    packed, digits, width, kind = index(rows)
    packed = stored(packed, "planes")
    first = partial(_positives, digits=digits, width=width, kind=kind)
    some = _tiles(asked, packed, n_anchors, n_rows, first, "seq bigint, positive_seq bigint, positive_id bigint, positive_score bigint")
    by_anchor = Window.partitionBy("seq").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_seq")
    positives = stored(some.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= POSITIVES), "positives")
    together = positives.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("place", "positive_seq", "positive_score"))).alias("positives"))
    some = _tiles(asked.join(together, "seq"), packed, n_anchors, n_rows, partial(_negatives, digits=digits, width=width, kind=kind),
                  "seq bigint, positive_seq bigint, negative_id bigint, negative_score bigint")
    by_pair = Window.partitionBy("seq", "positive_seq").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    best = some.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= NEGATIVES)
    return (best.join(positives, ["seq", "positive_seq"]).join(asked.select("seq", F.col("id").alias("anchor_id")), "seq")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def shifted_label(key: str = "vec_id", label: str = "label"):
    """The label, moved on by one of ten where the key is divisible by seven."""
    return F.when(F.col(key) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))


ORACLE = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS seq
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.seq, a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM fine a, fine r WHERE a.vec_id % 50 = 0 AND a.seq <> r.seq),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, id NULLS LAST) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.seq, p.id ORDER BY n.score DESC, n.id NULLS LAST)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.seq = p.seq AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.seq, p.id ORDER BY n.score DESC, n.id NULLS LAST) <= 3
"""
