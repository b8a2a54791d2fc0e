"""Sets that meet in a bucket, compared in tiles by hashed bitmaps, and joined into components.

A bitmap holds the parity of a set's elements at each place, so two bitmaps differ in at most as many bits as the sets differ
in elements. Counting these bits bounds the overlap of two sets from above, and most pairs are told apart without a look at
the sets. Tiles hold the sets of a bucket whose sizes lie in one band or in neighbouring bands; buckets with many sets are
cut into blocks, and pairs of blocks are tiles of their own. Pairs of one component are never formed.

Rows that a tile makes grow with its sets, not with its pairs: in a first round a set names a few others at most, and where that
left some out, a second round compares whole sets inside the tile and gives back only links that join two components there."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, stored
from .components import components

#: a block of a large bucket has so many rows on average
BLOCK = 2_048
#: a task compares so many rows, or so many bytes of bitmaps, at a time, and one tile at least
ROWS_HELD, BYTES_HELD = 16_384, 32_000_000
#: where whole sets are compared, a block has about so much weight at most
WEIGHT = 1_000_000
#: partners in one component that a set names in the first round, and partners in all if a tile has more pairs than so many a set
FEW = 3
WIDEST = 1 << 17
ROUNDING = 1e-9


def bitmap(hashes: np.ndarray, size: int) -> bytes:
    """Parities of the places of ``hashes`` in a bitmap for ``size`` elements (2 to 4 bits an element)."""
    width = min(max(64, 1 << max(2 * size - 1, 0).bit_length()), WIDEST)
    places = (hashes & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of several widths; the wider of two is folded to the width of the other."""

    def __init__(self, column: list[bytes]):
        sizes = np.fromiter(map(len, column), np.int64, len(column))
        self.width = sizes
        self.place = np.zeros(len(column), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.frombuffer(b"".join(column[i] for i in at), np.uint64).reshape(len(at), -1)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of each pair differ."""
        out = np.zeros(len(i), np.int64)
        kinds = self.width[i] << 32 | self.width[j]
        for kind in np.unique(kinds).tolist():
            of = np.flatnonzero(kinds == kind)
            wi, wj = kind >> 32, kind & 0xFFFFFFFF
            a, b, w = self.rows[wi], self.rows[wj], min(wi, wj)
            step = max(1, 8_000_000 // max(wi, wj))
            for s in range(0, len(of), step):
                part = of[s:s + step]
                x, y = _folded(a[self.place[i[part]]], w // 8), _folded(b[self.place[j[part]]], w // 8)
                out[part] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def may_reach(differing: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of ``total`` weight together that differ in at least that much may be as similar as ``threshold``."""
    return differing * (1 + threshold) <= (1 - threshold) * total * (1 + ROUNDING)


def _edges(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each tile, and one more at the end; the bucket of each row."""
    keys = np.stack([t[c].to_numpy() for c in ("bucket", "band", "x", "y")])
    new = np.ones(len(t), bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    return np.append(np.flatnonzero(new), len(t)), keys[0]


class Rows:
    """Columns of rows that stand in tiles, and which pairs of them are to be compared."""

    def __init__(self, t: pa.Table, threshold: float):
        self.root = t["root"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.size, self.block = t["size"].to_numpy(), t["block"].to_numpy()
        self.short, self.own = (t[c].to_numpy(zero_copy_only=False) for c in ("short", "own"))
        self.alone = t["x"].to_numpy() == t["y"].to_numpy()
        self.bits = Bitmaps(t["bits"].to_pylist())
        self.threshold = threshold

    def meet(self, i, j: np.ndarray) -> np.ndarray:
        size, short, own, block = self.size, self.short, self.own, self.block
        ok = (own[i] | own[j]) & (self.alone[i] | (block[i] != block[j]))
        ok &= np.minimum(size[i], size[j]) >= self.threshold * np.maximum(size[i], size[j]) * (1 - ROUNDING)
        return ok & (((size[i] <= size[j]) & short[i]) | ((size[j] <= size[i]) & short[j]))

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that their bitmaps do not rule out, and how far apart they are at least."""
        total = self.size[i] + self.size[j]
        d = self.bits.differing(i, j)
        ok = may_reach(d, total, self.threshold)
        return i[ok], j[ok], d[ok] / total[ok]


def _first(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The place of each row in its group of equal keys, if rows are taken in ``order``, which has equal keys together."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _pairs(t: pa.Table, threshold: float) -> pa.RecordBatch:
    n = len(t)
    starts, bucket = _edges(t)
    counts = np.diff(starts)
    end, tile = np.repeat(starts[1:], counts), np.repeat(np.arange(len(counts)), counts)
    rows = Rows(t, threshold)
    root, found = rows.root, []
    active, lag, waiting, held = np.arange(n), 1, [], 0
    while True:
        active = active[active + lag < end[active]]
        if not len(active):
            break
        i, j = active, active + lag
        ok = (root[i] != root[j]) & rows.meet(i, j)
        if ok.any():
            waiting.append((i[ok], j[ok]))
            held += len(waiting[-1][0])
            if held > 1_000_000:
                found.append(rows.near(*(np.concatenate(x) for x in zip(*waiting))))
                waiting, held = [], 0
        lag += 1
    if waiting:
        found.append(rows.near(*(np.concatenate(x) for x in zip(*waiting))))
    i, j, far = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    # of each set the nearest few in each other component, and in a tile that then has many pairs the nearest few in all;
    # where there are more, and where not all tiles were formed, the bucket comes back
    a, b, f = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])
    other = root[b]
    named = _first(np.lexsort((b, f, other, a)), a, other) < FEW
    left_out = ~named
    a, b, f = a[named], b[named], f[named]
    more = [bucket[t["cut"].to_numpy(zero_copy_only=False)], bucket[np.concatenate([i, j])[left_out]]]
    many = np.bincount(tile[a], minlength=len(counts)) > 2 * FEW * counts
    named = ~many[tile[a]] | (_first(np.lexsort((b, f, a)), a) < FEW)
    more = np.unique(np.concatenate([*more, bucket[a[~named]]]))
    both = np.unique(np.minimum(a, b)[named] * n + np.maximum(a, b)[named])
    ids, nothing = t["id"].combine_chunks(), pa.nulls(len(more), t.schema.field("id").type)
    columns = [pa.concat_arrays([ids.take(pa.array(k)), nothing]) for k in (both // n, both % n)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([None] * len(both) + more.tolist(), pa.int64())], names=["x", "y", "more"])


@dataclass
class Sets:
    """How texts become sets and when two are alike; all of it is sent to tasks.

    read: the sets of texts. weighted: distinct hashes of a set, and their weights. alike: the similarity of two sets, or None
    if they are no link."""

    read: Callable[[list[str]], list]
    weighted: Callable[[object], tuple[np.ndarray, np.ndarray]]
    alike: Callable[[object, object], float | None]


class Overlaps:
    """Elements of the sets of a tile, as numbers, so that one set is compared with many at once."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.count = np.fromiter((len(h) for h, _ in sets), np.int64, len(sets))
        self.start = np.cumsum(self.count) - self.count
        distinct, element = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
        self.element, self.weight = element.astype(np.int32), np.concatenate([w for _, w in sets])
        self.total = np.asarray([w.sum() for _, w in sets])
        self.there = np.zeros(len(distinct))

    def may_reach(self, i: int, j: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the sets ``j``, which are not empty, are as similar to set ``i`` as ``threshold``, but for rounding."""
        own = slice(self.start[i], self.start[i] + self.count[i])
        self.there[self.element[own]] = self.weight[own]
        ends = np.cumsum(self.count[j])
        at = np.repeat(self.start[j] - (ends - self.count[j]), self.count[j]) + np.arange(ends[-1])
        low = np.add.reduceat(np.minimum(self.there[self.element[at]], self.weight[at]), ends - self.count[j])
        self.there[self.element[own]] = 0
        return low * (1 + threshold) >= threshold * (self.total[i] + self.total[j]) * (1 - ROUNDING)


def _joining(t: pa.Table, threshold: float, sets: Sets) -> pa.RecordBatch:
    """Links between sets of each tile, enough to join those that belong together: fewer than the tile has rows."""
    starts, _ = _edges(t)
    rows, ids = Rows(t, threshold), t["id"].combine_chunks()
    found: list[tuple[int, int, float]] = []
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        root, read, overlaps = rows.root[s:e].copy(), None, None
        for i in range(s, e - 1):
            j = np.arange(i + 1, e)
            j = j[(root[j - s] != root[i - s])]
            j = j[rows.meet(i, j)]
            if not len(j):
                continue
            _, j, far = rows.near(np.full(len(j), i), j)
            j, step = j[np.argsort(far, kind="stable")], 16
            if len(j) and read is None:
                read = sets.read(t["text"].slice(s, e - s).to_pylist())
                overlaps = Overlaps([sets.weighted(x) for x in read])
            while len(j):  # the nearest first, as one link to a component spares the others in it
                part, j = j[:step], j[step:]
                for k in part[overlaps.may_reach(i - s, part - s, threshold)].tolist():
                    if root[k - s] != root[i - s] and (share := sets.alike(read[i - s], read[k - s])) is not None:
                        found.append((i, k, share))
                        root[root == root[k - s]] = root[i - s]
                j, step = j[root[j - s] != root[i - s]], 2 * step
    a, b, share = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64())), pa.array(share, pa.float64())], names=["x", "y", "similarity"])


def _compare(batches: Iterator[pa.RecordBatch], tiles: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``tiles`` makes of some whole tiles at a time; rows come sorted by tile."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows < ROWS_HELD and size < BYTES_HELD:
            continue
        t = pa.Table.from_batches(held)
        keys = np.stack([t[c].to_numpy() for c in ("bucket", "band", "x", "y")])
        last = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        if len(last):  # the last tile may go on in the next batch
            cut = int(last[-1]) + 1
            yield tiles(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
            rows, size = sum(map(len, held)), sum(b.nbytes for b in held)
    if held:
        yield tiles(pa.Table.from_batches(held))


def _tiled(rows: DataFrame, threshold: float, some: bool) -> DataFrame:
    """Rows (bucket, id, root, short, size) with the tiles they go to: band, x, y, block, own, cut.

    A row stands in the band of its size (own) and in the next one, where smaller sets than its own band's meet it. In a bucket
    and band with more than BLOCK rows, rows of the component with most rows are one kind and the others another: the
    others are cut into blocks that meet each other and every block of the first kind, whose rows never meet among themselves.
    With ``some`` a block of the others meets itself and one block of the first kind only, so that tiles grow with the rows, and
    cut marks the rows of buckets and bands that have further tiles. Else blocks are smaller where sets are large."""
    # a little wider than the largest quotient of sizes, so that rounding parts no pair by two bands
    step = -math.log(threshold) * (1 + 1e-6)
    band = F.floor(F.log(F.greatest("size", F.lit(1e-9))) / step)
    rows = rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("own", F.col("band") == band)
    per_root = rows.groupBy("bucket", "band", "root").agg(F.count("*").alias("c"), F.max("own").alias("o"))
    groups = per_root.groupBy("bucket", "band").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"), F.max("o").alias("o")).where("m > top.c AND o")
    most = F.lit(BLOCK) if some else F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(WEIGHT / F.exp((F.col("band") + 1) * step))))
    groups = groups.select("bucket", "band", (F.col("m") <= most).alias("small"), F.col("top.root").alias("main"), F.ceil(F.col("top.c") / most).alias("mains"), F.ceil((F.col("m") - F.col("top.c")) / most).alias("others"))
    rows = rows.join(groups, ["bucket", "band"])
    small, h = F.col("small"), F.xxhash64("id", "band")
    is_main = F.col("root") == F.col("main")
    block = F.when(small, F.lit(0)).when(is_main, F.col("others") + F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("others")))
    rows = rows.withColumn("block", block.cast("bigint"))
    number = lambda x: F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")
    if some:
        of_main = F.when(F.col("block") - F.col("others") < F.col("others"), F.sequence(number(F.col("block") - F.col("others")), number(F.col("others") - 1), number(F.col("mains"))))
        with_ = F.when(small, F.array(number(0))).when(is_main, of_main).otherwise(F.array("block", number(F.col("others") + F.pmod("block", "mains"))))
        cut = ~small & ((F.col("others") > 1) | (F.col("mains") > 1))
    else:
        last = F.when(small, F.lit(0)).when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
        with_, cut = F.sequence(number(0), number(last)), F.lit(False)
    rows = rows.withColumn("cut", cut).withColumn("with", F.explode(with_))
    return rows.select("bucket", "band", F.least("with", "block").alias("x"), F.greatest("with", "block").alias("y"), "id", "root", "short", "size", "block", "own", "cut")


def _unseen(pairs: DataFrame, seen: list[DataFrame]) -> DataFrame:
    pairs = pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for other in seen:
        pairs = pairs.join(other, ["a", "b"], "left_anti")
    return pairs


def _bounded(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        bits = Bitmaps(batch.column(3).to_pylist() + batch.column(5).to_pylist())
        sa, sb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        ok = may_reach(bits.differing(np.arange(n), np.arange(n) + n), sa + sb, threshold) & (np.minimum(sa, sb) >= threshold * np.maximum(sa, sb) * (1 - ROUNDING))
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps folded once: they go to every tile of a set, and half is enough to tell most sets apart."""
    for batch in batches:
        wide = (np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_folded(b[None], max(1, len(b) // 2)).tobytes() for b in wide], pa.binary())], names=["id", "bits"])


def moved(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots (id, root) after ``links`` (a, b) between ids are added."""
    of = {c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"}
    joined = links.join(of["a"], "a").join(of["b"], "b")
    new = components(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return stored(roots.join(new, "root", "left").select("id", F.coalesce("new", "root").alias("root")), "roots")


def linked(shared: DataFrame, signatures: DataFrame, texts: DataFrame, sets: Sets, check: Callable[[DataFrame, DataFrame], DataFrame], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Verified links (what ``check`` returns for pairs a, b and their texts) and roots (id, root) of all ids of ``shared``.

    shared: bucket, id, short, least (the bucket's least id); a pair can be alike only if it meets in a bucket where the
    smaller of both is short. signatures: id, size, bits, where bitmaps differ in no more bits than sets differ in weight.
    texts: id, text, one row for each id of ``shared``.

    First every id is compared with the least id of each of its buckets, which joins most copies. Then the buckets that still
    hold more than one component are compared in tiles: each set names the few sets of other components that may be most
    like it. Buckets where that left sets out, or tiles, are compared once more: there tiles have whole sets, compare all that
    may reach the threshold and are not yet in one component, and give back a link for each two components that they join. So
    each pair that meets in a bucket is in one component, verified, or ruled out by its bound; the number of rounds is fixed, and
    no step makes more rows than a few for each set of a tile."""
    kind = shared.schema["id"].dataType.simpleString()
    ids = shared.select("id").distinct()
    side = {c: signatures.select(F.col("id").alias(c), F.col("size").alias(f"s{c}"), F.col("bits").alias(f"b{c}")) for c in "ab"}

    def verified(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "sa", "ba", "sb", "bb")
        likely = stored(likely.mapInArrow(partial(_bounded, threshold=threshold), f"a {kind}, b {kind}"), "likely")
        return stored(check(likely, among(texts, "id", likely.select(F.explode(F.array("a", "b")).alias("id")))), "links")

    first = stored(_unseen(shared.select(F.col("least").alias("x"), F.col("id").alias("y")), []), "pairs")
    links = verified(first)
    roots = moved(stored(ids.select("id", F.col("id").alias("root")), "ids"), links)
    halved = stored(signatures.select("id", "bits").mapInArrow(_halved, f"id {kind}, bits binary"), "halved")

    def tiled(of: DataFrame, some: bool) -> DataFrame:
        rows = of.drop("least").join(roots, "id")
        # of buckets that hold the same ids, as those of one shared passage do, one is enough
        open_ = (rows.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max("short").alias("any"), F.count("*").alias("n"),
                                            *[F.bit_xor(F.xxhash64(F.lit(k), "id", "short")).alias(f"h{k}") for k in range(2)])
                 .where("r != s AND any").groupBy("n", "h0", "h1").agg(F.min("bucket").alias("bucket")).select("bucket"))
        open_rows = stored(rows.join(open_, "bucket").join(signatures.select("id", "size"), "id"), "open")
        out, open_ids = _tiled(open_rows, threshold, some), stored(open_rows.select("id").distinct(), "ids")
        for more in (halved,) if some else (halved, texts):  # bitmaps and texts come in last, so that only one exchange moves them with each row
            out = out.join(among(more, "id", open_ids), "id")
        return out.repartition("bucket", "band", "x", "y").sortWithinPartitions("bucket", "band", "x", "y", "id")

    near = stored(tiled(shared, True).mapInArrow(partial(_compare, tiles=partial(_pairs, threshold=threshold)), f"x {kind}, y {kind}, more bigint"), "near")
    all_links = links.unionByName(more_links := verified(stored(_unseen(near.where("x IS NOT NULL"), [first]), "pairs")))
    roots = moved(roots, more_links)
    buckets = near.where("more IS NOT NULL").select(F.col("more").alias("bucket")).distinct()
    if buckets.head(1):
        whole = tiled(shared.join(buckets, "bucket", "left_semi"), False)
        found = whole.mapInArrow(partial(_compare, tiles=partial(_joining, threshold=threshold, sets=sets)), f"x {kind}, y {kind}, similarity double")
        last = stored(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").dropDuplicates(["a", "b"]), "joining")
        all_links, roots = all_links.unionByName(last), moved(roots, last)
    return all_links, roots
