"""Texts joined by the exact Jaccard similarity of their word n-grams.

Two sets can only be alike enough if they share one of their first elements in an order that is the same for all sets (rarest
first, by counters over all texts): sets that share such an element meet in a bucket. There, size-banded tiles compare hashed
bitmaps, whose differing bits bound the overlap from above, and what is left is settled on the sorted arrays of both sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .common import MIX, among, blocks, bounded, mix64, small_batches, stored

WORDS = 5
#: least similarity in hundredths
PERCENT = 80
#: counters of how many texts hold an element; they bound work only, not results
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: elements whose counter is above this are summed up in parts before they meet, so that no task gets a hot element's rows
HOT = 1_000_000
_STEPS = np.random.default_rng(13).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
#: the low bytes of a 64-bit word, by how many
_LOW = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words one after another, eight bytes at a time, and the number of words of each text.

    A-Z are lower-cased; words are parted by blanks and control characters 9 to 13."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(parts).lower() + b" "  # of bytes: ASCII only
    chunks = np.frombuffer(data + bytes(16 - len(data) % 8), "<u8")
    blank = np.flatnonzero(_SPACES[np.frombuffer(data, np.uint8)])
    starts = np.concatenate([[0], blank[:-1] + 1])
    left = blank - starts
    starts, left = starts[left > 0], left[left > 0]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    h, who = left.astype(np.uint64) * MIX, slice(None)
    while len(starts):
        at, shift = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
        chunk = (chunks[at] >> shift | chunks[at + 1] << np.uint64(1) << np.uint64(63) - shift) & _LOW[np.minimum(left, 8)]
        h[who] = mix64(h[who] * MIX + chunk)
        more = np.flatnonzero(left > 8)
        who = more if isinstance(who, slice) else who[more]
        starts, left = starts[more] + 8, left[more] - 8
    return h, counts


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The rising different hashes of the ``words``-word shingles of each text.

    A text with fewer words is one shingle, one without words none. Shingles are told apart by 64 bits."""
    if not texts:
        return []
    mixed, counts = word_hashes(texts)
    m = max(0, len(mixed) - words + 1)
    h = np.zeros(m, np.uint64)
    for k in range(words):
        h += mixed[k:k + m] * _STEPS[k]
    h = mix64(h)
    out = []
    for e, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
        if n >= words:
            s = np.sort(h[e - n:e - words + 1])
            new = s[1:] != s[:-1]
            out.append(s if new.all() else s[np.append(True, new)])
        elif n:
            out.append(mix64((mixed[e - n:e] * _STEPS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two rising arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _counted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for _, texts in blocks(batch):
            sets = shingles(texts, words)
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    for i in range(0, COUNTERS, CHUNK):
        if total[i:i + CHUNK].any():
            yield pa.RecordBatch.from_pydict({"chunk": [i // CHUNK], "counts": [total[i:i + CHUNK].astype("<i4").tobytes()]})


def _standing_out(batches: Iterator[pa.RecordBatch], above: float | None) -> Iterator[pa.RecordBatch]:
    """Of the parts of one chunk after another: the sum of all counters (slot -1), or the counters above a bound."""
    chunk, total = None, np.zeros(CHUNK, np.int64)

    def out():
        if chunk is not None:
            at = np.flatnonzero(total > above) if above is not None else None
            yield pa.RecordBatch.from_pydict({"slot": pa.array([-1] if at is None else at + chunk * CHUNK, pa.int64()), "n": pa.array([total.sum()] if at is None else total[at], pa.int64())})

    for batch in batches:
        for c, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if c != chunk:
                yield from out()
                chunk, total = c, np.zeros(CHUNK, np.int64)
            total += np.frombuffer(counts, "<i4")
    yield from out()


def ranks(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """For each counter 0, or by how many steps of a quarter power of two it stands above twice the mean; 255 for hot ones.

    Tasks hand on their counters in chunks. The driver gets one row for each counter that stands out, a million at most."""
    parts = stored(texts.mapInArrow(partial(_counted, words=words), "chunk bigint, counts binary"), "counters").repartition("chunk").sortWithinPartitions("chunk")
    mean = (parts.mapInArrow(partial(_standing_out, above=None), "slot bigint, n bigint").agg(F.sum("n")).first()[0] or 0) / COUNTERS
    out = np.zeros(COUNTERS, np.uint8)
    high = parts.mapInArrow(partial(_standing_out, above=float(min(2 * mean + 1, HOT))), "slot bigint, n bigint").toPandas()
    n = high["n"].to_numpy(np.float64)
    step = np.clip(1 + 4 * np.log2(np.maximum(n / max(2 * mean + 1, 1), 1)), 1, 254)
    out[high["slot"].to_numpy(np.int64)] = np.where(n > HOT, 255, step).astype(np.uint8)
    return out


def _sketched(batches: Iterator[pa.RecordBatch], ranked, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    import xxhash
    schema = pa.schema([("row", pa.int64()), ("digest", pa.binary()), ("node", pa.binary()), ("n", pa.int64()), ("short", pa.int32()), ("cold", pa.int32()), ("first", pa.list_(pa.int64()))])
    for batch in batches:
        row, digest = batch.column(0), batch.column(1)
        at = 0
        for keys, texts in blocks(batch.select([0, 2])):
            node, size, short, cold, first = [], [], [], [], []
            for s in shingles(texts, words):
                n = len(s)
                rank = ranked.value[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                # a smaller or equal partner shares at least percent of n, a larger one 2 percent / (1 + percent) of it
                long = n - -(-percent * n // 100) + 1 if n else 0
                order = np.argsort(rank, kind="stable")[:long]  # ties by hash, as the hashes rise
                node.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                size.append(n)
                short.append(n - -(-2 * percent * n // (100 + percent)) + 1 if n else 0)
                cold.append(int((rank[order] < 255).sum()))
                first.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([row.slice(at, len(keys)), digest.slice(at, len(keys)), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(short, pa.int32()),
                                              pa.array(cold, pa.int32()), pa.array(first, pa.list_(pa.int64()))], schema=schema)
            at += len(keys)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for keys, texts in blocks(batch):
            sets = shingles(texts, words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(keys)), pa.array([float(len(s)) for s in sets]), pa.array([tiles.bitmap(s, len(s)) for s in sets], pa.binary()),
                                              batch.column(1).slice(at, len(keys))], names=["id", "size", "bits", "text"])
            at += len(keys)


def _unweighted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return found, np.ones(len(found))


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> float | None:
    both = overlap(a, b)
    union = len(a) + len(b) - both
    return both / union if 100 * both >= percent * union else None


def _settled(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
        one = {}  # the texts of a busy id stand in many rows
        for ids, texts in ((a, ta), (b, tb)):
            one.update(zip(ids, texts))
        sets = dict(zip(one, shingles(list(one.values()), words)))
        got = [(x, y, overlap(sets[x], sets[y])) for x, y in zip(a, b)]
        got = [(x, y, n / (len(sets[x]) + len(sets[y]) - n)) for x, y, n in got if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64()), "similarity": pa.array([g[2] for g in got], pa.float64())})


def check(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike, with their similarity, from texts (id, text)."""
    side = {c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab"}
    joined = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(partial(_settled, words=words, percent=percent), "a bigint, b bigint, similarity double")


def _shared(first: DataFrame) -> DataFrame:
    """Rows (bucket, id, short, least) of the buckets (elements) that several ids have first, one of them short."""
    rows = first.select(F.posexplode("first").alias("place", "bucket"), "id", "short", "cold").select("bucket", "id", (F.col("place") < F.col("short")).alias("short"), (F.col("place") >= F.col("cold")).alias("hot"))
    several = (F.col("least") != F.col("most")) & F.col("any")
    parts = {"least": F.min("id"), "most": F.max("id"), "any": F.max("short")}
    cold, hot = rows.where("NOT hot").drop("hot"), rows.where("hot").drop("hot")
    by = Window.partitionBy("bucket")
    met = cold.withColumns({k: v.over(by) for k, v in parts.items()}).where(several)
    per = hot.groupBy("bucket").agg(*[v.alias(k) for k, v in parts.items()]).where(several)
    return met.select("bucket", "id", "short", "least").unionByName(hot.join(per, "bucket").select("bucket", "id", "short", "least"))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Joined:
    """links: a, b, similarity of representatives (columns of ``ids``); ids: row, n, id, root; rows: row and key of each document."""

    def __init__(self, links: DataFrame, ids: DataFrame, rows: DataFrame):
        self.links, self.ids, self.rows = links, ids, rows


def join(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> Joined:
    """Links between documents whose shingle sets have ``100 * intersection >= percent * union``, as components.

    Documents with equal sets are one id, so copies are linked whatever their number. links holds verified pairs of ids, enough
    to join each component: pairs whose ends are already joined by others are left out, as a group of thousands of near copies
    has millions. Null and empty texts have no set and no link. Repeated rows and null keys are documents like others."""
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    ranked = spark.sparkContext.broadcast(ranks(texts.select(F.lit(0).alias("none"), "text"), words))
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest"), "text", "key")
    kind = numbered.schema["key"].dataType.simpleString()
    sketches = stored(_with_key(numbered, partial(_sketched, ranked=ranked, words=words, percent=percent), kind), "sketches")
    full = sketches.where("n > 0")
    # the least row stands for all rows with the same set
    reps = stored(full.groupBy("node").agg(F.min("row").alias("id")), "nodes")
    copies = stored(full.select("row", "node").join(reps, "node").where("row != id").select("row"), "copies")
    nodes = full.join(bounded(copies), "row", "left_anti").withColumnRenamed("row", "id")
    shared = stored(_shared(nodes), "shared")
    wanted = shared.select("id").distinct()
    need = stored(sketches.select(F.col("row").alias("id"), F.col("digest").alias("d"), F.col("key").alias("k")).join(wanted, "id", "left_semi"), "wanted")
    held = among(texts.withColumn("d2", digest(F.col("text"))), "d2", need.select("d")).join(bounded(need), (F.col("d2") == F.col("d")) & F.col("key").eqNullSafe(F.col("k"))).select("id", "text")
    signed = partial(_signed, words=words)
    held = stored(held.mapInArrow(signed, "id bigint, size double, bits binary, text string"), "held")
    if held.count() > need.count():  # rows that stand in the table more than once, key and text
        held = stored(held.dropDuplicates(["id"]), "held")
    sets = tiles.Sets(partial(shingles, words=words), _unweighted, partial(_alike, percent=percent))
    links, roots = tiles.linked(shared, held.select("id", "size", "bits"), held.select("id", "text"), sets, partial(check, words=words, percent=percent), percent / 100)
    ids = reps.join(roots, "id", "left").select("node", "id", F.coalesce("root", "id").alias("root"))
    return Joined(links, ids, sketches.select("row", "key", "node", "n"))


def _with_key(numbered: DataFrame, sketch, kind: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys, at = batch.column(3), 0
            for out in sketch(iter([batch.select([0, 1, 2])])):
                yield pa.RecordBatch.from_arrays([*out.columns, keys.slice(at, len(out))], names=[*out.schema.names, "key"])
                at += len(out)
    return numbered.mapInArrow(run, f"row bigint, digest binary, node binary, n bigint, short int, cold int, first array<bigint>, key {kind}")


def classes(df: DataFrame, **options) -> DataFrame:
    """key, n_shingles and component_id (the least key that links reach, the document's own included) for each row of ``df``.

    Options are those of ``join``. A component whose keys are all null has a null id."""
    key = options.get("key", "doc_id")
    found = join(df, **options)
    members = found.rows.join(found.ids.select("node", "root"), "node", "left")
    least = members.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("least"))
    return members.join(least, "root", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
same AS (SELECT min(r) AS id, any_value(s) AS s, list_sort(s) AS k FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
parts AS (SELECT id, len(s) AS n, unnest(s) AS x FROM same),
met AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS total, count(*) AS common FROM parts a JOIN parts b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * common >= 80 * (total - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT id, id FROM same),
reach AS (SELECT id AS a, id AS b FROM same UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
members AS (SELECT x.doc_id, len(x.s)::BIGINT AS n_shingles, t.root FROM sets x LEFT JOIN same m ON len(x.s) > 0 AND list_sort(x.s) = m.k LEFT JOIN roots t ON t.id = m.id)
SELECT doc_id, n_shingles, CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id FROM members
"""
