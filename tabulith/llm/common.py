"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: rows in an Arrow batch; texts may be long, so batches stay small
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: a counted table of at most so many ids (some 20 MB) is sent to all tasks
SENT_ROWS = 400_000


def bounded(ids: DataFrame) -> DataFrame:
    """A stored table of ids, sent to all tasks if a count says that it is small; else left to a shuffle join."""
    return F.broadcast(ids) if ids.count() <= SENT_ROWS else ids


#: places of a sieve of values (8 MB), and those that travel together
SIEVE, SIEVE_PART = 1 << 26, 1 << 20


def _sieve_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(SIEVE // 8, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy() & (SIEVE - 1)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    for i, part in enumerate(bits.reshape(-1, SIEVE_PART // 8)):
        if part.any():
            yield pa.RecordBatch.from_pydict({"part": [i], "bits": [part.tobytes()]})


def _sieve_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole[i] = whole.get(i, np.uint8(0)) | np.frombuffer(bits, np.uint8)
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(whole), pa.int64()), "bits": pa.array([w.tobytes() for w in whole.values()], pa.binary())})


def among(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``values`` (one stored column), and perhaps a few others.

    Few values are sent to all tasks; of many only a bit each, by hash, so that rows need not be shuffled to be left out."""
    name = values.columns[0]
    if values.count() <= SENT_ROWS:
        (value,) = fresh(rows, "value")
        one = values.distinct().withColumnRenamed(name, value)
        return rows.join(F.broadcast(one), F.col(column) == F.col(value), "left_semi")
    parts = values.select(F.xxhash64(name).alias("h")).mapInArrow(_sieve_parts, "part bigint, bits binary")
    bits = np.zeros(SIEVE // 8, np.uint8)
    for r in parts.repartition("part").mapInArrow(_sieve_joined, "part bigint, bits binary").collect():
        bits[r["part"] * SIEVE_PART // 8:(r["part"] + 1) * SIEVE_PART // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def there(h: pd.Series) -> pd.Series:
        at = h.to_numpy() & (SIEVE - 1)
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return rows.where(there(F.xxhash64(column)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(df: DataFrame) -> list[Column]:
    """The columns of simple types, by whose hash rows are chosen."""
    return [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant", "void"))]


def keyed_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Two columns, ``key`` and ``text``, whatever else the table holds."""
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def strings(column: pa.Array) -> list[str]:
    """Values of a string column, nulls as empty texts."""
    return [v or "" for v in column.to_pylist()]


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers), elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def flat(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words one after another, and the number of words of each text."""
        counts = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        get = self.__getitem__
        flat = np.fromiter((h for t in texts for h in map(get, t)), dtype=np.uint64, count=int(counts.sum()))
        return flat, counts


def blocks(table: pa.RecordBatch, most_chars: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Slices of a (key, text) batch that hold about ``most_chars`` characters; a longer text stands alone."""
    keys, texts = table.column(0).to_pylist(), strings(table.column(1))
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most_chars:
            yield keys[start:i], texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield keys[start:], texts[start:]
