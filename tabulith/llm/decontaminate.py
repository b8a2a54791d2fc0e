"""Benchmark passages in documents: latent semantic retrieval, then longest common subsequence and answer checks.

Texts become numbers of the benchmark's words once and are stored. Their passages are rows of a TF-IDF matrix, with frequencies
from all documents, whose leading right singular vectors a distributed randomised SVD finds: executors add up products of their
passages with a random test matrix, the driver solves the small problem that is left. Passages of documents and of the benchmark
are projected into that latent space; those close in cosine are compared word by word. So are, as the exact way, the places where
a text shares runs of three words with an item, as many as an item must leave that is there word for word or with up to a fifth
of its words replaced or left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, blocks, fresh, keyed_text, mix64, small_batches, stored

#: words of half a passage; passages are pairs of neighbouring halves, so each is met in whole or nearly so
HALF = 32
#: directions of the latent space; fewer where words or passages of the benchmark times directions would pass MOST_WEIGHTS (64 MB)
RANK = 128
MOST_WEIGHTS = 16_000_000
#: more columns of the test matrix than directions
SPARE = 16
#: words in fewer than this share of documents weigh the same; those in over half weigh nothing
RARE, COMMON = 0.005, 0.5
#: least cosine of two passages in the latent space
COSINE = 0.35
#: share of a benchmark item that is found in order: alone, and when its answer is found too
COPIED, PARAPHRASED, ANSWERED = 0.8, 0.6, 0.8
#: items shorter than this count only as a whole, word for word
SHORT = 8
#: words of a run by which texts and items meet exactly; shorter items meet as a whole
RUN = 3

#: bits for the words around a passage where items reach one half to either side, and bytes of all items' bits beyond which they get no more
MARKS, MOST_MARKED = 512, 16_000_000
#: rows of numbers that are gathered at a time: what fits a processor's cache
GATHERED = 2_048

_TOKEN = re.compile(r"[^\W_]+")
_PARTS = {c: " " for c in range(128) if not chr(c).isalnum()}


def tokens(text: str) -> list[str]:
    text = text.lower()
    return text.translate(_PARTS).split() if text.isascii() else _TOKEN.findall(text)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence; one machine-word-like step for each element of ``b``."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Item:
    """An item's words and answer, as numbers of the benchmark's words."""

    key: object
    words: list[int]
    answer: list[int]

    def __post_init__(self):
        self.distinct = frozenset(self.words)


def judged(item: Item, region: list[int]) -> float:
    """The share of the item found in the region if that makes it a leak, else 0.

    A short item must be there word for word. A longer one leaks if four fifths of it are there in order, or three fifths
    of it and its answer, which is its last sentence or at least its last words."""
    n = len(item.words)
    if n < SHORT:
        found = any(region[i:i + n] == item.words for i in range(len(region) - n + 1))
        return 1.0 if found and n else 0.0
    if len(item.distinct.difference(region)) > (1 - PARAPHRASED) * n:  # each of these is missing from any common subsequence
        return 0.0
    share = common_subsequence(item.words, region) / n
    if share >= COPIED:
        return share
    if share >= PARAPHRASED and common_subsequence(item.answer, region) >= ANSWERED * len(item.answer):
        return share
    return 0.0


def _answer(text: str, words: list[str]) -> list[str]:
    """The last sentence, if it has three words or more, else the last quarter."""
    last = next((t for t in reversed([tokens(s) for s in re.split(r"[.!?\n]+", text)]) if t), [])
    return last if 3 <= len(last) < len(words) else words[-max(1, len(words) // 4):]


def _encoded(batches: Iterator[pa.RecordBatch], place, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """key and ids: the numbers of a text's words as 32-bit integers, -1 for words that the benchmark lacks. Texts without any of its words are left out."""
    get = place.value.get
    for batch in batches:
        for keys, texts in blocks(batch):
            kept, out = [], []
            for k, t in zip(keys, texts):
                words = tokens(t)
                ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                if len(ids) and ids.max() >= 0:
                    kept.append(k)
                    out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, kind), pa.array(out, pa.binary())], names=["key", "ids"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each text has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.int32).astype(np.int64), np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, ids and counts of some texts at a time, about ``most`` words; a longer text stands alone."""
    for batch in batches:
        sizes = [len(p) // 4 for p in batch.column("ids").to_pylist()]
        start = held = 0
        for i, n in enumerate([*sizes, None]):
            if i > start and (n is None or held + n > most):
                yield batch.column("key").slice(start, i - start), *_flat(batch.column("ids").slice(start, i - start))
                start, held = i, 0
            held += n or 0


def _document_frequency(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(words, np.int64)
    for _, ids, counts in _slices(batches):
        owner = np.repeat(np.arange(len(counts)), counts)
        hit = ids >= 0
        total += np.bincount(np.unique(owner[hit] * words + ids[hit]) % words, minlength=words)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"word": at, "n": total[at]})


def _passages(words: list[int]) -> list[list[int]]:
    """Windows of two halves, one half apart; a shorter text is one."""
    return [words[i:i + 2 * HALF] for i in range(0, max(1, len(words) - HALF), HALF)]


def _halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the half passage of each word, and the first half of each text (one more at the end)."""
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-counts // HALF)))])
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first[:-1], counts) + inside // HALF, first


def _sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the ``rows`` of ``table`` of each group, some whole groups at a time; groups begin at ``starts``."""
    out = np.empty((len(starts), table.shape[1]), table.dtype)
    ends = np.append(starts[1:], len(rows))
    g = 0
    while g < len(starts):
        h = max(g + 1, int(np.searchsorted(ends, starts[g] + GATHERED, "right")))
        for i in range(starts[g], ends[h - 1], 32 * GATHERED):  # a group may be large
            part = table.take(rows[i:min(i + 32 * GATHERED, ends[h - 1])], axis=0)
            if i == starts[g]:
                np.add.reduceat(part, starts[g:h] - i, axis=0, out=out[g:h]) if h > g + 1 else part.sum(axis=0, out=out[g])
            else:
                out[g] += part.sum(axis=0)
        g = h
    return out


def _summed(table: np.ndarray, ids: np.ndarray, half: np.ndarray, halves: int) -> np.ndarray:
    """For each half passage the sum of the rows of ``table`` of its words; halves rise."""
    out = np.zeros((halves, table.shape[1]), np.float32)
    starts = np.flatnonzero(np.diff(half, prepend=-1))
    out[half[starts]] = _sums(table, ids, starts)
    return out


def _test_matrix(words: int, columns: int) -> np.ndarray:
    """The same in every task."""
    return np.random.default_rng(5).standard_normal((words, columns), dtype=np.float32)


def _products(batches: Iterator[pa.RecordBatch], idf, columns: int) -> Iterator[pa.RecordBatch]:
    """A task's part of A^T A times the test matrix: a row for each word, summed over half passages of unit length."""
    weights = idf.value.astype(np.float32)
    test, total = _test_matrix(len(weights) - 1, columns), None
    weighted = test * weights[:-1, None]
    for _, ids, counts in _slices(batches):
        half, first = _halves(counts)
        hit = np.flatnonzero(ids >= 0)
        hit = hit[weights[ids[hit]] > 0]
        if not len(hit):
            continue
        ids, half = ids[hit], half[hit]
        square = np.bincount(half, weights=weights[ids].astype(np.float64) ** 2, minlength=first[-1])
        # both factors of A^T A are of unit length
        b = _summed(weighted, ids, half, int(first[-1])) / np.maximum(square, 1e-30)[:, None].astype(np.float32)
        order = np.argsort(ids, kind="stable")
        ids, half = ids[order], half[order]
        total = np.zeros(test.shape, np.float32) if total is None else total
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        total[ids[starts]] += _sums(b, half, starts) * weights[ids[starts], None]
    if total is not None:
        at = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(at), 2_000):
            part = at[i:i + 2_000]
            yield pa.RecordBatch.from_pydict({"word": part, "sums": pa.array([r.tobytes() for r in total[part]], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each word's rows; rows come sorted by word."""
    word, total = None, None
    words, sums = [], []
    for batch in batches:
        for w, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = np.frombuffer(s, np.float32)
            if w != word:
                if word is not None:
                    words.append(word)
                    sums.append(total.astype(np.float32).tobytes())
                word, total = w, np.zeros(len(row))
            total = total + row
    if word is not None:
        words.append(word)
        sums.append(total.astype(np.float32).tobytes())
    yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.int64()), "sums": pa.array(sums, pa.binary())})


def singular_vectors(y: np.ndarray, test: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors of A and its singular values, from the test matrix and y = A^T A times it.

    The symmetric matrix A^T A is approximated by y (test^T y)^-1 y^T; a small shift keeps the inverse stable."""
    shift = 1e-6 * np.linalg.norm(y) + 1e-12
    y = y + shift * test
    core = test.T @ y
    values, inside = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(initial=0.0), 1e-300)
    b = y @ (inside[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    keep = np.flatnonzero(s ** 2 > 2 * shift)[:rank]
    return u[:, keep], np.sqrt(s[keep] ** 2 - shift)


@dataclass
class Runs:
    """Runs of ``size`` words of the items: sorted keys, and for each key the items that hold it."""

    size: int
    keys: np.ndarray
    starts: np.ndarray  # one more than the keys
    items: np.ndarray


@dataclass
class Space:
    """Weights of the benchmark's words, its items with their runs, and the latent space with its passages."""

    idf: np.ndarray  # one more than the words: the last is for words that the benchmark lacks
    items: list[Item]
    needed: np.ndarray  # runs that an item must share with a text
    words: list[np.ndarray]  # of each item
    reach: np.ndarray  # words to either side of a passage that are compared with the item
    least: np.ndarray  # words of the item that must be there for a leak
    vectors: np.ndarray  # words x directions, each row times its weight
    owners: np.ndarray  # item of each passage
    latent: np.ndarray  # directions x passages, of unit length
    runs: list[Runs]
    marks: np.ndarray = field(init=False)  # of each item, bits of its words

    def __post_init__(self):
        self.marks = _marks(self.words, int(self.reach.max()))


def _run_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` word numbers."""
    n = max(0, len(ids) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix64(h * MIX + ids[k:k + n].astype(np.uint64))
    return h


def _needed(n: int) -> int:
    """Runs of an item of n words that are left if it counts as copied and each missing word breaks as many as it can."""
    size = min(RUN, n)
    return max(1, n - size + 1 - (size * int((1 - COPIED) * n + 1e-9) if n >= SHORT else 0))


def _runs(items: list[Item]) -> list[Runs]:
    out = []
    for size in range(1, RUN + 1):
        keys, owners = [], []
        for k, item in enumerate(items):
            if min(RUN, len(item.words)) == size:
                got = np.unique(_run_keys(np.asarray(item.words, np.int64), size))
                keys.append(got)
                owners.append(np.full(len(got), k, np.int64))
        if keys:
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            distinct, starts = np.unique(keys[order], return_index=True)
            out.append(Runs(size, distinct, np.append(starts, len(keys)), owners[order]))
    return out


def _benchmark(benchmark: DataFrame, item_key: str, item_text: str) -> tuple[list[Item], dict[str, int]]:
    """The items and the numbers of their words. The benchmark is the given query set and goes to the driver; null and wordless items are left out, items with the same key stay apart."""
    rows = benchmark.select(F.col(f"`{item_key}`").alias("key"), F.col(f"`{item_text}`").cast("string").alias("text"))
    read = [(r["key"], r["text"] or "", tokens(r["text"] or "")) for r in sorted(rows.collect(), key=lambda r: (str(r["key"]), r["text"] or ""))]
    read = [(k, t, w) for k, t, w in read if w]
    place = {w: i for i, w in enumerate(sorted({w for _, _, words in read for w in words}))}
    return [Item(k, [place[w] for w in words], [place[w] for w in _answer(t, words)]) for k, t, words in read], place


def _weights(encoded: DataFrame, n: int, words: int) -> np.ndarray:
    """Inverse document frequencies of the benchmark's words and, last, of all others; the driver gets one number for each."""
    df = np.full(words, 1.0)
    for word, count in encoded.mapInArrow(partial(_document_frequency, words=words), "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect():
        df[word] = count
    most = np.log(1.0 / RARE)
    idf = np.clip(np.log(n / np.maximum(df, 1.0)), 0.0, most)
    idf = np.where(df > COMMON * n, 0.0, np.maximum(idf, 0.0))
    if not idf.any() or n < 1.0 / RARE:
        idf = np.where(idf > 0, idf, 0.1) if n < 1.0 / RARE else np.full(words, most)
    return np.append(idf, most if n >= 1.0 / RARE else np.log(max(n, 2)))


def fit(encoded: DataFrame, items: list[Item], n: int, words: int) -> Space:
    """The latent space of all passages of ``encoded`` (key, ids), and the benchmark's passages in it.

    The driver gets one row of RANK numbers for each word of the benchmark."""
    spark = encoded.sparkSession
    idf = _weights(encoded, n, words)
    passages = [(k, p) for k, item in enumerate(items) for p in _passages(item.words) if idf[p].any()]
    rank = max(8, min(RANK, MOST_WEIGHTS // max(words, len(passages), 1)))
    columns = min(rank + SPARE, words)
    sent = spark.sparkContext.broadcast(idf)
    sums = encoded.mapInArrow(partial(_products, idf=sent, columns=columns), "word bigint, sums binary")
    sums = sums.repartition("word").sortWithinPartitions("word").mapInArrow(_added, "word bigint, sums binary")
    y = np.zeros((words, columns))
    for r in sums.toLocalIterator():
        y[r["word"]] = np.frombuffer(r["sums"], np.float32)
    basis, _ = singular_vectors(y, _test_matrix(words, columns).astype(np.float64), rank)
    if not basis.shape[1]:
        basis = np.zeros((words, 1))
    vectors = (basis * idf[:-1, None]).astype(np.float32)
    latent = np.asarray([vectors[p].sum(axis=0) for _, p in passages], np.float32).reshape(len(passages), -1)
    latent /= np.maximum(np.sqrt((latent ** 2).sum(axis=1, keepdims=True)), 1e-12)
    return Space(idf, items, np.asarray([_needed(len(i.words)) for i in items], np.int64), [np.asarray(i.words, np.int64) for i in items],
                 np.asarray([_reach(len(i.words)) for i in items], np.int64), np.asarray([len(i.words) if len(i.words) < SHORT else PARAPHRASED * len(i.words) - 1e-9 for i in items]), vectors, np.asarray([k for k, _ in passages], np.int64), np.ascontiguousarray(latent.T), _runs(items))


def _reach(n: int) -> int:
    return max(HALF, n - HALF)


def _leaks(ids: np.ndarray, counts: np.ndarray, s: Space) -> Iterator[tuple[int, int, float]]:
    """Text, item and share for every leak in a block of texts."""
    half, first_half = _halves(counts)
    owner = np.repeat(np.arange(len(counts)), np.diff(first_half))
    met: dict[tuple[int, int], set[int]] = {}
    _near(s, ids, counts, half, owner, first_half, met)
    for runs in s.runs:
        _shared(runs, s, ids, half, owner, first_half, met)
    starts = np.cumsum(counts) - counts
    for (t, k), at in sorted(met.items()):
        reach, text = s.reach[k], ids[starts[t]:starts[t] + counts[t]]
        best = 0.0
        for h in sorted(at):
            best = max(best, judged(s.items[k], text[max(0, h * HALF - reach):(h + 2) * HALF + reach].tolist()))
            if best == 1.0:
                break
        if best:
            yield t, k, best


def _near(s: Space, ids: np.ndarray, counts: np.ndarray, half: np.ndarray, owner: np.ndarray, first_half: np.ndarray, met: dict[tuple[int, int], set[int]]) -> None:
    """Add the halves at which a passage of a text is close in the latent space to one of the benchmark, by text and item.

    Items of which too few words are anywhere around the passage are left out: no subsequence could make them leaks."""
    hit = np.flatnonzero(ids >= 0)
    hit = hit[s.idf[ids[hit]] > 0]
    if not len(hit) or not len(s.owners):
        return
    n = int(first_half[-1])
    z = np.vstack([_summed(s.vectors, ids[hit], half[hit], n), np.zeros((1, s.vectors.shape[1]), np.float32)])
    same = np.append(owner[1:] == owner[:-1], False)
    window = z[:-1] + np.where(same[:, None], z[1:], np.float32(0))
    size = np.sqrt((window ** 2).sum(axis=1))
    full = np.flatnonzero(size > 1e-9)
    starts, length = np.cumsum(counts) - counts, np.fromiter(map(len, s.words), np.int64, len(s.words))
    begin, all_words = np.cumsum(length) - length, np.concatenate(s.words)
    seen = _around(s, ids, half, owner)
    most = max(1, 1_000_000 // s.marks.shape[1])
    step = max(1, min(1024, MOST_WEIGHTS // len(s.idf), 1_000_000 // int(s.reach.max() + HALF)))
    few = max(1, 1_000_000 // int(length.max()))
    for i in range(0, len(full), 4096):
        some = full[i:i + 4096]
        cosine = (window[some] @ s.latent) / size[some, None]
        rows, passages = np.nonzero(cosine >= COSINE)
        pairs = rows * len(s.items) + s.owners[passages]
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]  # they rise, as passages follow their items
        rows, items = pairs // len(s.items), pairs % len(s.items)
        likely = [np.zeros(0, np.int64)]
        for k in range(0, len(rows), most):
            item = items[k:k + most]
            # several words share a bit: one that only the item has is a word that is not there, but not the other way
            absent = np.bitwise_count(s.marks[item] & ~seen[some[rows[k:k + most]]]).sum(axis=1, dtype=np.int64)
            likely.append(k + np.flatnonzero(length[item] - absent >= s.least[item]))
        likely = np.concatenate(likely)
        rows, items = rows[likely], items[likely]
        cuts = np.flatnonzero(np.diff(rows, prepend=-1))
        for c in range(0, len(cuts), step):  # windows at a time; of each, the words that are around it
            cut = cuts[c:c + step]
            last = cuts[c + step] if c + step < len(cuts) else len(rows)
            h, item = some[rows[cut]], items[cut[0]:last]
            t = owner[h]
            at = h - first_half[t]
            reach = np.maximum.reduceat(s.reach[item], cut - cut[0])
            low = starts[t] + np.maximum(0, at * HALF - reach)
            around, window_of = _ranges(low, starts[t] + np.minimum(counts[t], (at + 2) * HALF + reach) - low)
            present = np.zeros((len(cut), len(s.idf)), bool)
            present[window_of, ids[around]] = True  # words that the benchmark lacks are the last column
            of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, last)))
            for k in range(0, len(item), few):
                some_items = item[k:k + few]
                word, pair = _ranges(begin[some_items], length[some_items])
                there = np.bincount(pair[present[of[k:k + few][pair], all_words[word]]], minlength=len(some_items))
                for p in (k + np.flatnonzero(there >= s.least[some_items])).tolist():
                    met.setdefault((int(t[of[p]]), int(item[p])), set()).add(int(at[of[p]]))


def _bits(rows: np.ndarray, words: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each row a bit for each of its words, by hash."""
    out = np.zeros((n, width), bool)
    out[rows, mix64(words.astype(np.uint64)).astype(np.int64) & (width - 1)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _marks(items: list[np.ndarray], reach: int) -> np.ndarray:
    """Bits of the words of each item, more of them where passages reach further, as long as all have room."""
    width = MARKS
    while width < MARKS * -(-reach // HALF) and 2 * width * len(items) <= 8 * MOST_MARKED:
        width *= 2
    out = [np.zeros((0, width // 64), np.uint64)]
    for k in range(0, len(items), GATHERED):
        some = items[k:k + GATHERED]
        out.append(_bits(np.repeat(np.arange(len(some)), [len(w) for w in some]), np.concatenate(some), len(some), width))
    return np.concatenate(out)


def _around(s: Space, ids: np.ndarray, half: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Bits of the words around each passage, from all halves of its text that any item reaches."""
    far, n = -(-int(s.reach.max()) // HALF), len(owner)
    hit = np.flatnonzero(ids >= 0)
    own = np.zeros((n, s.marks.shape[1]), np.uint64)
    for h in range(0, n, GATHERED):
        some = hit[np.searchsorted(half[hit], h):np.searchsorted(half[hit], h + GATHERED)]
        own[h:h + GATHERED] = _bits(half[some] - h, ids[some], min(GATHERED, n - h), 64 * own.shape[1])
    seen = own.copy()
    for k in range(-min(far, n), min(far + 1, n) + 1):  # a passage is its half and the next one
        low, high = max(0, -k), n - max(0, k)
        if k and low < high:
            seen[low:high] |= np.where((owner[low:high] == owner[low + k:high + k])[:, None], own[low + k:high + k], np.uint64(0))
    return seen


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from each start on, as many as its count, one range after another; and the range of each."""
    of = np.repeat(np.arange(len(starts)), counts)
    return np.arange(len(of)) + np.repeat(starts - (np.cumsum(counts) - counts), counts), of


def _shared(runs: Runs, s: Space, ids: np.ndarray, half: np.ndarray, owner: np.ndarray, first_half: np.ndarray, met: dict[tuple[int, int], set[int]]) -> None:
    """Add the halves where a text shares runs with an item, if it shares as many as the item needs."""
    n = len(ids) - runs.size + 1
    if n <= 0:
        return
    text = owner[half]
    inside = text[:n] == text[runs.size - 1:]
    for k in range(runs.size):
        inside &= ids[k:k + n] >= 0
    at = np.flatnonzero(inside)
    keys = _run_keys(ids, runs.size)[at]
    found = np.minimum(np.searchsorted(runs.keys, keys), len(runs.keys) - 1)
    hit = runs.keys[found] == keys
    at, found = at[hit], found[hit]
    if not len(at):
        return
    many = runs.starts[found + 1] - runs.starts[found]
    ends = np.cumsum(many)
    item = runs.items[np.repeat(runs.starts[found], many) + np.arange(ends[-1]) - np.repeat(ends - many, many)]
    at = np.repeat(half[at], many)
    pair = owner[at] * len(s.items) + item
    _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
    enough = count[which] >= s.needed[item]
    places = np.unique(np.stack([at[enough], item[enough]], axis=1), axis=0)
    for h, k in places.tolist():
        t = int(owner[h])
        h -= int(first_half[t])
        # of a long item the region around one half may miss an end; the one before then has it
        met.setdefault((t, k), set()).update((h, max(0, h - 1)) if len(s.items[k].words) > HALF else (h,))


def _found(batches: Iterator[pa.RecordBatch], s, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for keys, ids, counts in _slices(batches):
        rows = list(_leaks(ids, counts, s.value))
        items = s.value.items
        yield pa.RecordBatch.from_arrays([keys.take(pa.array([t for t, _, _ in rows], pa.int64())), pa.array([items[k].key for _, k, _ in rows], schema.field(1).type),
                                          pa.array([share for _, _, share in rows], pa.float64())], schema=schema)


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it: key, item and share, the part of the item found in order.

    Whole texts are read once, whatever the size of the benchmark, and stored as word numbers, which three scans then read: for
    frequencies, for the latent space, and for the search in overlapping passages. Null and empty texts have no leak; without
    benchmark words the result is empty. Repeated documents are reported each; null keys are carried; other columns are not
    read. Only sums for the benchmark's words are shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed_text(docs, key, text)
    kinds = [rows.schema["key"].dataType, benchmark.schema[item_key].dataType]
    ddl = f"key {kinds[0].simpleString()}, item {kinds[1].simpleString()}, share double"
    arrow = [to_arrow_schema(rows.schema).field(0).type, to_arrow_schema(benchmark.select(F.col(f"`{item_key}`")).schema).field(0).type]
    schema = pa.schema([("key", arrow[0]), ("item", arrow[1]), ("share", pa.float64())])
    items, place = _benchmark(benchmark, item_key, item_text)
    if not items:
        return spark.createDataFrame([], ddl).withColumnsRenamed({"key": key, "item": item_key})
    encoded = rows.mapInArrow(partial(_encoded, place=spark.sparkContext.broadcast(place), kind=arrow[0]), f"key {kinds[0].simpleString()}, ids binary")
    encoded = stored(encoded, "words")
    space = spark.sparkContext.broadcast(fit(encoded, items, max(1, docs.count()), len(place)))
    return encoded.mapInArrow(partial(_found, s=space, schema=schema), ddl).withColumnsRenamed({"key": key, "item": item_key})


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with their columns. Texts are matched by digest, so repeated or
    null keys are no matter; a null text stays."""
    node, other = fresh(docs, "node", "node2")
    marked = docs.withColumn(node, F.unhex(F.md5(F.col(f"`{text}`").cast("string"))))
    slim = marked.select(F.col(node).alias("node"), F.col(f"`{text}`").alias("text"))
    found = leaks(slim, benchmark, key="node", item_key=item_key, item_text=item_text).select(F.col("node").alias(other)).distinct()
    return marked.join(found, F.col(node) == F.col(other), "left_anti").drop(node)
