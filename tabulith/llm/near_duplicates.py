"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles, banded and verified.

A sample of a weighted set is the shingle (and step) with the least of ``a = c / (y e^r)``, ``y = e^(r (t - beta))``,
``t = floor(ln w / r + beta)``, where r, c ~ Gamma(2, 1) and beta ~ U(0, 1) belong to the shingle. Two sets share a sample
with the probability of their weighted Jaccard similarity. Here r, c and beta come from a table of 65,536 draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import WordHashes, blocks, bounded, fresh, mix64, small_batches, stored, strings

SHINGLE = 5
#: 16 bands of 4 samples: a pair at similarity 0.8 is missed with probability 0.0002
BANDS, ROWS = 16, 4
#: shingles share 2^18 counters; with 600 shingles a text the counts are too high by 0.25 % of the texts, at any size
DF_BITS = 18
#: shingles in over a tenth of the texts lose weight; all others weigh one, so copies are not told apart by being copied
RARE = 0.1
LEAST_IDF = 0.05
THRESHOLD = 0.8

_rng = np.random.default_rng(20)
_R = _rng.gamma(2.0, 1.0, 1 << 16)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16))
_BETA = _rng.random(1 << 16)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


def _ordered(log_a: np.ndarray) -> np.ndarray:
    """Order-preserving 32 bits of ln a, in the upper half of a word."""
    return (log_a + 100.0).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)


#: of weight one: t is 0
_UNIT = _ordered(_LOG_C + _R * _BETA - _R)

_WORDS = WordHashes()


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes of each text, rising, and how often each occurs.

    Words are lower-cased and parted by white space. A text with fewer than five words is one shingle; without words none."""
    flat, counts = _WORDS.flat([t.lower().split() for t in texts])
    ends = np.cumsum(counts)
    m = max(0, len(flat) - SHINGLE + 1)
    h = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        h += mix64(flat[k:k + m]) * _STEPS[k]
    h = mix64(h)
    out = []
    for e, n in zip(ends.tolist(), counts.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(h[e - n:e - SHINGLE + 1], return_counts=True))
        elif n:
            short = mix64(mix64(flat[e - n:e]) * _STEPS[:n])
            out.append((mix64(np.asarray([np.bitwise_xor.reduce(short)]) + np.uint64(n)), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(counts)) * idf[(hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)]


def bands(sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Band keys of non-empty weighted sets, one row each."""
    sizes = np.fromiter((len(s[0]) for s in sets), np.int64, len(sets))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = np.concatenate([s[0] for s in sets])
    w = weights(hashes, np.concatenate([s[1] for s in sets]), idf)
    other = np.flatnonzero(w != 1.0)
    log_w = np.log(w[other])
    samples = np.empty((BANDS * ROWS, len(sets)), np.uint64)
    for k, odd in enumerate(_ODD):
        h = hashes * odd
        key = _UNIT[h >> np.uint64(48)]
        low = h >> np.uint64(8)
        if len(other):
            at = (h[other] >> np.uint64(48)).astype(np.int64)
            t = np.floor(log_w / _R[at] + _BETA[at])
            key[other] = _ordered(_LOG_C[at] - _R[at] * (t - _BETA[at]) - _R[at])
            low[other] ^= t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1)
        key |= low & _LOW
        samples[k] = np.minimum.reduceat(key, starts) & _LOW
    out = np.empty((BANDS, len(sets)), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + samples[b * ROWS + r])
        out[b] = x
    return out.T.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard similarity."""
    wa, wb = weights(*a, idf), weights(*b, idf)
    if not len(wa) or not len(wb):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = b[0][at] == a[0]
    low = np.minimum(wa[shared], wb[at[shared]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def _weighted(found: tuple[np.ndarray, np.ndarray], idf) -> tuple[np.ndarray, np.ndarray]:
    return found[0], weights(*found, idf.value)


def _alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf, threshold: float) -> float | None:
    found = similarity(a, b, idf.value)
    return found if found >= threshold else None


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << DF_BITS, np.int64)
    for batch in batches:
        for _, texts in blocks(batch):
            found = [s[0] for s in shingles(texts)]
            if found:
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=1 << DF_BITS)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_pydict({"slot": at[i:i + 50_000], "n": total[at[i:i + 50_000]]})


def _sketches(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for nodes, texts in blocks(batch):
            sets = shingles(texts)
            full = [i for i, s in enumerate(sets) if len(s[0])]
            if full:
                got = bands([sets[i] for i in full], idf.value)
                size, bits = [], []
                for hashes, counts in (sets[i] for i in full):
                    size.append(float(weights(hashes, counts, idf.value).sum()))
                    # a shingle of full weight that one of two texts lacks parts them by at least one
                    heavy = hashes[idf.value[(hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)] >= 1.0]
                    bits.append(tiles.bitmap(heavy, len(heavy)))
                yield pa.RecordBatch.from_pydict({"id": pa.array([nodes[i] for i in full], pa.binary()), "bands": pa.array(list(got), pa.list_(pa.int64())),
                                                  "size": pa.array(size, pa.float64()), "bits": pa.array(bits, pa.binary())})


def _verified(batches: Iterator[pa.RecordBatch], idf, threshold: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        left, right = shingles(strings(batch.column(2))), shingles(strings(batch.column(3)))
        found = [similarity(x, y, idf.value) for x, y in zip(left, right)]
        keep = [i for i, s in enumerate(found) if s >= threshold]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary()),
                                          pa.array([found[i] for i in keep], pa.float64())], schema=schema)


def idf_table(texts: DataFrame) -> np.ndarray:
    """Weights of the shingle counters from distinct texts: 1 up to a tenth of the texts, then falling with the logarithm.

    The driver gets one number for each of the 2^18 counters."""
    n = texts.count()
    got = texts.select("node", "text").mapInArrow(_frequencies, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.ones(1 << DF_BITS)
    df[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return np.clip(np.log(max(n, 1) / np.maximum(df, 1.0)) / np.log(1.0 / RARE), LEAST_IDF, 1.0)


@dataclass
class Found:
    """links: a, b, similarity between contents; roots: node and root of all contents that met another in a bucket."""

    links: DataFrame
    roots: DataFrame


def _check(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Verified pairs. The text of ``a`` comes first, then rows are dealt by ``b``, of which a busy ``a`` has many."""
    joined = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b"))
    return joined.mapInArrow(partial(_verified, idf=idf, threshold=threshold), "a binary, b binary, similarity double")


def find(texts: DataFrame, *, threshold: float = THRESHOLD) -> Found:
    """Links between the distinct texts of ``texts`` (columns node, a digest of the text, and text; repeats are harmless).

    In each bucket of a band every text is compared with the bucket's least one. Buckets that then still hold more than one
    component are compared in tiles: bitmaps of the shingles of full weight bound the weighted similarity from above, and pairs
    that they do not rule out are verified on whole texts: each text names a few, and where that leaves some out, whole texts
    go to the tiles, which give back the links that join two components. So every pair of a bucket is in one component, verified, or ruled out
    by a bound. Pairs of one component are never all formed."""
    spark = texts.sparkSession
    small_batches(spark)
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]), "distinct")
    idf = spark.sparkContext.broadcast(idf_table(texts))
    sketches = stored(texts.mapInArrow(partial(_sketches, idf=idf), "id binary, bands array<bigint>, size double, bits binary"), "sketches")
    rows = sketches.select("id", F.explode("bands").alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least != most").select("bucket", "least")
    shared = stored(rows.join(least, "bucket").withColumn("short", F.lit(True)), "shared")
    wanted = shared.select(F.col("id").alias("node")).distinct()
    held = stored(texts.join(bounded(stored(wanted, "wanted")), "node", "left_semi"), "texts")
    sets = tiles.Sets(shingles, partial(_weighted, idf=idf), partial(_alike, idf=idf, threshold=threshold))
    links, roots = tiles.linked(shared, sketches.select("id", "size", "bits"), held.select(F.col("node").alias("id"), "text"), sets, partial(_check, idf=idf, threshold=threshold), threshold)
    return Found(links, roots.withColumnRenamed("id", "node"))


def classes(df: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``df``: key, class_id (the least key of its class), class_size (rows), n_links and kept.

    Equal texts are one node, so exact copies share a class whatever their number; n_links counts the verified links of the
    text to other texts, of which a large class has only as many as join it. ``kept`` marks the rows with the least key and, of those, the least text digest. Texts without a
    word, and nulls, are alike to nothing: each row is its own class and is kept. Null keys sort after all others. Repeated
    rows get the same answer each; other columns are not read."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn(
        "node", F.when(F.col("text").rlike(r"[^\s\x1c-\x1f]"), F.unhex(F.md5("text"))))
    found = find(rows.where("node IS NOT NULL").select("node", "text"), threshold=threshold)
    degree = found.links.select(F.col("a").alias("node")).unionAll(found.links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    # a digest with its class first, and the rows of a class as counts of digests
    slim = stored(rows.select("key", "node"), "keys")
    by_text = slim.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    linked = by_text.join(found.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first")
    per_class = linked.groupBy("root").agg(first, F.sum("n").alias("class_size"))
    answer = linked.select("node", "root").join(per_class, "root").join(degree, "node", "left").select(
        "node", F.col("first.least").alias("class_id"), F.col("first.node").alias("first_node"), "class_size", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return slim.join(answer, "node", "left").select(
        F.col("key").alias(key), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.col("node").isNull() | ((F.col("node") == F.col("first_node")) & F.col("key").eqNullSafe(F.col("class_id")))).alias("kept"), "node")


def drop(df: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``df``, with one row of each class: the one with the least key; rows without words all stay."""
    node, mark, node2, mark2 = fresh(df, "node", "mark", "node2", "mark2")
    found = classes(df, key=key, text=text, threshold=threshold).where("kept AND node IS NOT NULL").select(F.col("node").alias(node2), F.col(f"`{key}`").alias(mark2)).distinct()
    t = F.col(f"`{text}`").cast("string")
    marked = df.withColumn(node, F.when(t.rlike(r"[^\s\x1c-\x1f]"), F.unhex(F.md5(t)))).withColumn(mark, F.col(f"`{key}`"))
    kept = marked.where(F.col(node).isNotNull()).join(found, (F.col(node) == F.col(node2)) & F.col(mark).eqNullSafe(F.col(mark2)), "left_semi")
    return kept.dropDuplicates([node, mark]).unionByName(marked.where(F.col(node).isNull())).drop(node, mark)
