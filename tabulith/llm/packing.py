"""Packing into optimal length buckets: boundaries by dynamic programming over the global histogram, batches by token budget."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, keyed_text, small_batches
from .tokens import held

#: rows of a bucket that are numbered together, until there are MOST_SLICES slices
SLICE_ROWS = 1_000
MOST_SLICES = 20_000


def _lengths(batches: Iterator[pa.RecordBatch], tokenizer: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    tok = held(tokenizer)
    for batch in batches:
        for keys, texts in blocks(batch):
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array([len(p) // tok.width + 1 for p in tok.packed(texts)], pa.int64())], schema=schema)


def token_lengths(df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens: the tokens of every whole text and one end token; a null text is empty and has the end token alone."""
    small_batches(df.sparkSession)
    rows = keyed_text(df, key, text)
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = pa.schema([("key", to_arrow_schema(rows.schema).field(0).type), ("n_tokens", pa.int64())])
    return rows.mapInArrow(partial(_lengths, tokenizer=tokenizer, schema=schema),
                           f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("key", key)


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length ranges with the least total padding.

    ``lengths`` are distinct and rising. best[k][j] is the least padding of the first j lengths in k ranges; the best last
    cut never moves back as j grows, so each layer is filled by halving: k n log n steps."""
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    top = lengths.astype(np.float64)
    best = top * c[1:] - s[1:]
    best = np.concatenate([[0.0], best])
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, where = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + top[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
            k = int(np.argmin(cost))
            new[j], where[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best, cuts = new, [*cuts, where]
    ends, j = [], n
    for where in reversed(cuts):
        if j:
            ends.append(int(lengths[j - 1]))
            j = int(where[j])
    return ends[::-1]


def pack(lengths: DataFrame, *, key: str = "doc_id", length: str = "n_tokens", buckets: int = 12, sequence: int = 4096, budget: int = 65_536) -> DataFrame:
    """One row for each piece: key, piece, n_tokens, bucket_len, batch, slot.

    A document longer than ``sequence`` tokens is cut into whole sequences and a rest, so nothing is dropped and the
    histogram has at most ``sequence`` entries, which are all that the driver sees. Bucket boundaries minimise padding over
    all rows. A batch of a bucket holds as many pieces as fit ``budget`` when padded to the bucket's length; only the last of
    a bucket may hold fewer. Batches are numbered from 0 in order of bucket. Pieces are ordered by a hash of their key.

    Null, zero and negative lengths take no place in a batch: bucket_len, batch and slot are null. Repeated rows are packed
    each on its own; their places among one another are arbitrary. A hot bucket is numbered in slices of bounded size, and
    only the counts of slices are summed up over the bucket. ``budget`` must be at least ``sequence``."""
    if budget < sequence:
        raise ValueError("a batch must hold one whole sequence")
    n = F.col(f"`{length}`").cast("bigint")
    rows = lengths.select(F.col(f"`{key}`").alias("key"), n.alias("n"))
    whole = F.greatest(F.ceil(F.col("n") / F.lit(sequence)), F.lit(1))
    pieces = (rows.select("key", "n", F.explode(F.sequence(F.lit(0), F.coalesce(whole, F.lit(1)).cast("int") - 1)).alias("piece"))
              .select("key", "piece", F.when(F.col("n").isNull() | (F.col("n") < 1), F.col("n")).otherwise(
                  F.least(F.col("n") - F.col("piece") * F.lit(sequence), F.lit(sequence))).cast("bigint").alias("n_tokens")))
    found = pieces.where(F.col("n_tokens") >= 1).groupBy("n_tokens").count().collect()
    found = sorted((r[0], r[1]) for r in found)
    values, counts = (np.asarray([f[i] for f in found], np.int64) for i in (0, 1))
    ends = boundaries(values, counts, buckets)
    slices = int(min(MOST_SLICES, max(1, counts.sum() // SLICE_ROWS)))
    bucket = F.lit(None).cast("bigint")
    for e in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= e, F.lit(e)).otherwise(bucket)
    bucket = F.when(F.col("n_tokens") >= 1, bucket)
    spread = F.xxhash64("key", "piece", "n_tokens")
    placed = pieces.withColumn("bucket_len", bucket).withColumn("h", spread).withColumn("slice", F.pmod("h", F.lit(slices)))
    # rows before each slice, and batches before each bucket: at most buckets x slices counts
    from pyspark.sql import Window
    sizes = placed.where("bucket_len IS NOT NULL").groupBy("bucket_len", "slice").count()
    before = F.sum("count").over(Window.partitionBy("bucket_len").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("bucket_len", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    index = np.searchsorted(np.asarray(ends, np.int64), values) if ends else np.zeros(0, np.int64)
    totals = np.bincount(index, weights=counts, minlength=len(ends)).astype(np.int64)
    first, at = {}, 0
    for e, t in zip(ends, totals.tolist()):
        first[e] = at
        at += -(-t // (budget // e))
    start = F.lit(None).cast("bigint")
    for e in ends:
        start = F.when(F.col("bucket_len") == e, F.lit(first[e])).otherwise(start)
    w = Window.partitionBy("bucket_len", "slice").orderBy("h", "key", "piece")
    joined = placed.join(sizes, ["bucket_len", "slice"], "left").withColumn("place", F.col("before") + F.row_number().over(w) - 1)
    held_by = F.floor(F.lit(budget) / F.col("bucket_len"))
    return joined.select(F.col("key").alias(key), "piece", "n_tokens", "bucket_len", (start + F.floor(F.col("place") / held_by)).cast("bigint").alias("batch"),
                         (F.col("place") % held_by).cast("bigint").alias("slot"))
