"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

A shard ``shards/000012.bin`` is: raw ids (little-endian, 2 or 4 bytes each), then the documents' keys (int64, nulls as 0),
then the end of each document in ids (int64), then a trailer of five int64: magic, bytes of an id, documents, ids,
documents without a key.  Shards follow one another in key order.  ``index/000003.mph`` holds, for the keys that hash to
that file, a perfect hash, fingerprints, and shard, place in the shard, byte offset and number of rows of the key.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import perfect_hash
from .common import blocks, small_batches
from .tokens import held

MAGIC = 0x544F4B3149445331
#: keys in an index file once there are over 64 files; fewer keys are spread over up to 64
INDEX_KEYS = 200_000
#: characters that are encoded in one call
GATHERED = 4_000_000
#: bytes of payload read at once
READ_BYTES = 16 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _buckets(keys: int) -> int:
    return max(1, -(-keys // INDEX_KEYS), min(64, keys // 500))


def _put(path: str, write) -> None:
    """Write beside the target and move: a task that runs again, or twice, leaves one whole file."""
    fs, target = _open(path)
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    beside = f"{target}.{uuid.uuid4().hex}"
    with fs.open_output_stream(beside) as out:
        write(out)
    fs.move(beside, target)


def _shard(path: str, number: int) -> str:
    return f"{path}/shards/{number:06d}.bin"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of some batches at a time, about GATHERED characters: what stands in many of them is looked up once."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for some, more in blocks(batch):
            keys, texts, size = keys + some, texts + more, size + sum(map(len, more))
            if size >= GATHERED:
                yield keys, texts
                keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def _write_shard(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    tok, number = held(tokenizer), TaskContext.get().partitionId()
    end = tok.pack([end_id])
    keys, sizes = [], []

    def write(out) -> None:
        for some, texts in _gathered(batches):
            keys.extend(some)
            packed = tok.packed(texts)
            sizes.extend(len(p) // tok.width + 1 for p in packed)
            out.write(b"".join(x for p in packed for x in (p, end)))
        nulls = sum(k is None for k in keys)
        total = sum(sizes)
        out.write(np.asarray([0 if k is None else k for k in keys], "<i8").tobytes())
        out.write(np.cumsum(np.asarray(sizes, "<i8"), dtype="<i8").tobytes())
        out.write(np.asarray([MAGIC, tok.width, len(keys), total, nulls], "<i8").tobytes())

    _put(_shard(path, number), write)
    yield pa.RecordBatch.from_pydict({"shard": [number], "docs": [len(keys)], "ids": [sum(sizes)], "nulls": [sum(k is None for k in keys)]},
                                     schema=pa.schema([(c, pa.int64()) for c in ("shard", "docs", "ids", "nulls")]))


class Shard:
    """Reads one shard; memory is its keys and ends and one block of payload."""

    def __init__(self, path: str, number: int):
        fs, target = _open(_shard(path, number))
        self.file = fs.open_input_file(target)
        size = self.file.size()
        magic, self.width, self.docs, self.ids, self.nulls = np.frombuffer(self.file.read_at(40, size - 40), "<i8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{target} is no token shard")
        at = self.ids * self.width
        self.keys = np.frombuffer(self.file.read_at(8 * self.docs, at), "<i8")
        self.ends = np.frombuffer(self.file.read_at(8 * self.docs, at + 8 * self.docs), "<i8")
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]])[:self.docs]

    def payloads(self, places: np.ndarray) -> Iterator[bytes]:
        """Raw ids of documents at ascending places; neighbours are read together."""
        i = 0
        while i < len(places):
            j = i + 1
            first = int(self.starts[places[i]])
            while j < len(places) and places[j] <= places[j - 1] + 1 and (int(self.ends[places[j]]) - first) * self.width <= READ_BYTES:
                j += 1
            data = self.file.read_at((int(self.ends[places[j - 1]]) - first) * self.width, first * self.width)
            for p in places[i:j].tolist():
                yield data[(int(self.starts[p]) - first) * self.width:(int(self.ends[p]) - first) * self.width]
            i = j


def _entries(batches: Iterator[pa.RecordBatch], path: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each distinct key of a shard."""
    for batch in batches:
        for number in batch.column(0).to_pylist():
            s = Shard(path, number)
            keys = s.keys[s.nulls:]
            uniq, first, run = np.unique(keys, return_index=True, return_counts=True)
            place = first + s.nulls
            yield pa.RecordBatch.from_pydict({
                "bucket": perfect_hash.bucket_of(uniq, buckets), "key": uniq, "shard": np.full(len(uniq), number), "place": place.astype(np.int64),
                "offset": s.starts[place] * s.width, "run": run.astype(np.int64)})


def write(df: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Encode every whole text, append ``end_id``, and write shards in key order, the index and a manifest under ``path``.

    A null text counts as empty and becomes the end id alone. Keys are integers; rows without a key come first and are not
    indexed. Repeated keys stand side by side, ordered by a hash of the text, each a document of its own, and the index
    points at the first and counts them. An empty table gives an empty manifest. Other columns are not read. A key with
    very many rows is cut by that hash over several shards unless its texts are all the same. There is a shard for each
    part that Spark reads of the input, so shards do not grow with it."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.asc_nulls_first("key"), F.xxhash64("text").asc()]
    shards = max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = (rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
               .mapInArrow(partial(_write_shard, path=path, tokenizer=tokenizer, end_id=end_id), "shard bigint, docs bigint, ids bigint, nulls bigint"))
    written.write.parquet(f"{path}/manifest")
    total = max(1, spark.read.parquet(f"{path}/manifest").agg(F.sum("docs")).first()[0] or 0)
    buckets = _buckets(total)
    shards = spark.read.parquet(f"{path}/manifest").select("shard")
    entries = shards.repartition("shard").mapInArrow(partial(_entries, path=path, buckets=buckets),
                                                     "bucket bigint, key bigint, shard bigint, place bigint, offset bigint, run bigint")
    # a key cut over shards keeps its first place and all its rows
    entries = entries.groupBy("bucket", "key").agg(F.min(F.struct("shard", "place", "offset")).alias("at"), F.sum("run").alias("run"))

    def build(group):
        values = {c: group[c].to_numpy(np.int64) for c in ("shard", "place", "offset", "run")}
        data = perfect_hash.dump(group["key"].to_numpy(np.int64), values)
        number = int(group["bucket"].iloc[0])
        _put(f"{path}/index/{number:06d}.mph", lambda out: out.write(data))
        return group[["bucket"]].head(1).assign(keys=len(group))

    (entries.select("bucket", "key", "at.*", "run").groupBy("bucket").applyInPandas(build, "bucket bigint, keys bigint")
     .write.parquet(f"{path}/buckets"))


def _index(path: str, number: int) -> perfect_hash.Index | None:
    fs, target = _open(f"{path}/index/{number:06d}.mph")
    if fs.get_file_info(target).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(target) as f:
        return perfect_hash.Index(f.read())


class Reader:
    """Keyed access from any process: ``ids(key)`` costs one hash, one fingerprint and one read."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.spark = path, spark
        self.manifest = sorted(tuple(r) for r in spark.read.parquet(f"{path}/manifest").select("shard", "docs", "ids", "nulls").collect())
        self.documents = sum(m[1] for m in self.manifest)
        self.buckets = _buckets(self.documents)

    def ids(self, key: int) -> np.ndarray | None:
        """Ids of the first document with that key, None if there is none."""
        keys = np.asarray([key], np.int64)
        index = _index(self.path, int(perfect_hash.bucket_of(keys, self.buckets)[0]))
        there, at = index.find(keys) if index else ([False], {})
        if not there[0]:
            return None
        s = Shard(self.path, int(at["shard"][0]))
        place = int(at["place"][0])
        if s.keys[place] != key:
            return None
        width, n = s.width, int(s.ends[place] - s.starts[place])
        return np.frombuffer(s.file.read_at(n * width, int(at["offset"][0])), f"<u{width}")

    def fetch(self, keys: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
        """A row for each stored document whose key is in ``keys`` (a null there stands for the documents without a key):
        key, start, n_tokens, ids_crc32 and, if asked for, the raw ``ids``.

        Keys go to the index file they hash to, what is found goes to its shard, and each shard is read in order. The
        manifest, one row for each shard, travels with the tasks."""
        path, buckets = self.path, self.buckets
        shards = np.asarray([m[0] for m in self.manifest], np.int64)
        first_doc = np.concatenate([[0], np.cumsum([m[1] for m in self.manifest])]).astype(np.int64)
        first_id = dict(zip(shards.tolist(), np.concatenate([[0], np.cumsum([m[2] for m in self.manifest])]).tolist()))
        nulls = sum(m[3] for m in self.manifest)

        def spread(keys: list, firsts: np.ndarray, runs: np.ndarray):
            """Shard and place of each document, from global numbers of the first ones and their rows."""
            owners = np.repeat(np.arange(len(runs)), runs)
            numbers = np.repeat(firsts - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(int(runs.sum()))
            for i in range(0, len(numbers), 100_000):
                some, who = numbers[i:i + 100_000], owners[i:i + 100_000]
                s = np.searchsorted(first_doc, some, side="right") - 1
                yield pa.RecordBatch.from_pydict({"shard": shards[s], "place": some - first_doc[s], "key": pa.array(keys).take(pa.array(who)).cast(pa.int64())})

        def to_files(batches):
            for batch in batches:
                keys = batch.column(0)
                bucket = perfect_hash.bucket_of(keys.fill_null(0).to_numpy(zero_copy_only=False), buckets)
                yield pa.RecordBatch.from_pydict({"bucket": bucket, "key": keys})

        def look(batches):
            index, number = None, None
            for batch in batches:
                files, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                if keys.null_count and nulls:
                    yield from spread([None], np.zeros(1, np.int64), np.asarray([nulls]))
                there = keys.is_valid().to_numpy(zero_copy_only=False)
                files, keys = files[there], keys.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                for piece in np.split(np.arange(len(files)), np.flatnonzero(np.diff(files)) + 1):
                    if not len(piece):
                        continue
                    if files[piece[0]] != number:  # keys come sorted by file: one is held at a time
                        number = int(files[piece[0]])
                        index = _index(path, number)
                    if index:
                        found, v = index.find(keys[piece])
                        yield from spread(keys[piece][found].tolist(), first_doc[np.searchsorted(shards, v["shard"])] + v["place"], v["run"])

        schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        schema = pa.schema(schema + [("ids", pa.binary())] * with_ids)

        def read(batches):
            s, held_number = None, None
            for batch in batches:
                numbers, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                keys, known = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.diff(numbers)) + 1
                for piece in np.split(np.arange(len(numbers)), cuts):
                    number = int(numbers[piece[0]])
                    if number != held_number:
                        s, held_number = Shard(path, number), number
                    right = ~known[piece] | (s.keys[places[piece]] == keys[piece])  # a strange key may share a fingerprint
                    at, crcs, ids = places[piece][right], [], []
                    for raw in s.payloads(at):
                        crcs.append(zlib.crc32(raw if s.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
                        ids.append(raw) if with_ids else None
                    cols = {"doc_id": pa.array(s.keys[at], mask=at < s.nulls), "start": s.starts[at] + first_id[number],
                            "n_tokens": s.ends[at] - s.starts[at], "ids_crc32": np.asarray(crcs, np.int64)}
                    yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}), schema=schema)

        wanted = keys.select(F.col(f"`{key}`").cast("bigint").alias("key")).distinct().mapInArrow(to_files, "bucket bigint, key bigint")
        places = wanted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(look, "shard bigint, place bigint, key bigint")
        places = places.repartition("shard").sortWithinPartitions("shard", "place")
        return places.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


__all__ = ["Reader", "Shard", "write"]
