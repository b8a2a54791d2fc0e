"""Quality from weak labels: overlapping heuristics vote, expectation-maximisation estimates how right each is, and the
posterior labels train a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blocks, keyed_text, mix64, small_batches, spread

BITS = 16
#: shares of fewer words say nothing
FEW = 12
#: votes of a heuristic: bad, none, good
BAD, NONE, GOOD = 0, 1, 2
# fixed values: frequent function words of the languages met
STOPWORDS = frozenset("the of and to in a is that it for was on are with as be at by this from "
                      "der die und das den von zu mit ist des im für auf ein eine nicht dem sich als auch "
                      "le la les de des et en un une du que est pour dans qui sur par au avec il "
                      "el los del y las por con una para su al lo como más pero se no".split())
SYMBOLS = "#*$%&|<>"
NAMES = ("symbols", "capitals", "repeats", "endings", "separators", "shouts", "word_length", "stopwords", "top_word", "compression")
_END = re.compile(r"[.!?…。]['\")\]]*$")


def _vote(value: float, good: float, bad: float) -> int:
    """GOOD up to ``good``, BAD from ``bad``; the other way round if good > bad."""
    if good < bad:
        return GOOD if value <= good else BAD if value >= bad else NONE
    return GOOD if value >= good else BAD if value <= bad else NONE


def votes(text: str) -> int:
    """The votes of all heuristics as one number in base three; texts without words get -1."""
    words = text.split()
    n = len(words)
    if not n:
        return -1
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    low = text.lower().split()
    got = (
        _vote(sum(text.count(c) for c in SYMBOLS) / n, 0.02, 0.3),
        _vote(sum(map(str.isupper, words)) / n, 0.15, 0.5),
        _vote(sum(map(eq, words, words[1:])) / n, 0.02, 0.15),
        _vote(sum(1 for x in lines if _END.search(x)) / len(lines), 0.6, 0.2),
        _vote(text.count("|") / n, 0.0, 0.1),
        _vote(text.count("!") / n, 0.05, 0.3),
        _vote(abs(len(text) / n - 6.5), 3.0, 6.0) if n >= FEW else NONE,
        _vote(sum(map(STOPWORDS.__contains__, low)) / n, 0.08, 0.01) if n >= FEW else NONE,
        _vote(max(Counter(low).values()) / n, 0.12, 0.2) if n >= FEW else NONE,
        _vote(len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / len(text), 0.38, 0.25) if n >= FEW else NONE,
    )
    code = 0
    for v in got:
        code = 3 * code + v
    return code


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Votes of each code, one column for each heuristic."""
    return np.stack([(codes // 3 ** (len(NAMES) - 1 - j)) % 3 for j in range(len(NAMES))], axis=1)


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each vote pattern, P(vote | class) of each heuristic, and the share of good texts.

    Heuristics are taken as independent given the class; majority votes are the start, which also says which class is good."""
    v = unpacked(codes)
    post = np.clip((0.5 + (v == GOOD).sum(1)) / (1.0 + (v != NONE).sum(1)), 0.05, 0.95)
    like, prior = np.zeros((len(NAMES), 2, 3)), 0.5
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        prior = float(np.clip(w[1].sum() / max(w.sum(), 1e-12), 0.01, 0.99))
        for j in range(len(NAMES)):
            for c in (0, 1):
                t = np.bincount(v[:, j], weights=w[c], minlength=3) + 0.5
                like[j, c] = t / (t[BAD] + t[GOOD])
                like[j, c, NONE] = 1.0  # no vote tells nothing
        logs = [np.log(p) + sum(np.log(like[j, c, v[:, j]]) for j in range(len(NAMES))) for c, p in ((0, 1 - prior), (1, prior))]
        new = 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, like, prior


class _Features(WordHashes):
    """token -> features of the word itself and of its shape, packed in one number."""

    def __missing__(self, token: str) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        shape = re.sub(r"(.)\1+", r"\1\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in token))
        shape = re.sub("x+", "x", re.sub("X{2,}", "XX", shape))
        h = self[token] = ((xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass")) >> (64 - BITS)) << 32
                           | xxhash.xxh3_64_intdigest(b"shape" + shape.encode("utf-8", "surrogatepass")) >> (64 - BITS))
        return h


_FEATURES = _Features()
_SAME, _LINE = (int(mix64(np.asarray([k], np.uint64))[0] >> np.uint64(64 - BITS)) for k in (1, 2))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: words, shapes of words, repeats and ends of lines; a vector of length one."""
    words = text.split()
    packed = np.fromiter(map(_FEATURES.__getitem__, words), np.uint64, len(words))
    both = np.concatenate([packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)]).astype(np.int64)
    at, n = np.unique(both, return_counts=True)
    value = np.log1p(n)
    extra = ((_SAME, sum(map(eq, words, words[1:]))), (_LINE, sum(1 for x in text.split("\n") if _END.search(x.rstrip()))))
    at = np.concatenate([at, [k for k, _ in extra]])
    value = np.concatenate([value, [np.log1p(c) for _, c in extra]])
    return at, value / np.sqrt((value ** 2).sum() or 1.0)


@dataclass
class Model:
    posterior: np.ndarray  # of good, by vote code; NaN for codes that were not met
    accuracy: dict[str, tuple[float, float]]  # of each heuristic: P(says bad | bad), P(says good | good) among its votes
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        at, value = features(text)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.weights[at] @ value + self.bias, -50, 50))))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in blocks(batch):
            yield pa.RecordBatch.from_pydict({"code": pa.array([votes(t) for t in texts], pa.int32())})


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in blocks(batch):
            rows = [(votes(t), *features(t)) for t in texts]
            yield pa.RecordBatch.from_pydict({"code": pa.array([r[0] for r in rows], pa.int32()), "at": pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary()),
                                              "value": pa.array([r[2].astype("<f4").tobytes() for r in rows], pa.binary())})


def fit(df: DataFrame, *, text: str = "text", most: int = 6_000, epochs: int = 12) -> Model:
    """Votes of all texts give the accuracies; at most about ``most`` texts, chosen by a hash, train the scorer.

    The driver gets a count for each vote pattern, at most 3^10, and the features of the chosen texts."""
    small_batches(df.sparkSession)
    rows = keyed_text(df, text, text)
    counted = rows.mapInArrow(_codes, "code int").where("code >= 0").groupBy("code").count().collect()
    posterior = np.full(3 ** len(NAMES), np.nan)
    weights, bias = np.zeros(1 << BITS), 0.0
    if not counted:
        return Model(posterior, {}, weights, bias)
    counted = sorted((r[0], r[1]) for r in counted)
    codes, counts = (np.asarray([c[i] for c in counted], np.int64) for i in (0, 1))
    post, like, _ = expectation_maximisation(codes, counts.astype(float))
    posterior[codes] = post
    accuracy = {n: (float(like[j, 0, BAD] / (like[j, 0, BAD] + like[j, 0, GOOD])), float(like[j, 1, GOOD] / (like[j, 1, BAD] + like[j, 1, GOOD]))) for j, n in enumerate(NAMES)}
    share = int(min(1.0, most / counts.sum()) * 1_000_000)
    # rows are chosen each on its own, also those with equal texts; the limit only holds if very many rows are equal
    chosen = df.where(F.pmod(F.xxhash64(*spread(df)), F.lit(1_000_000)) < share)
    sampled = keyed_text(chosen, text, text).mapInArrow(_sampled, "code int, at binary, value binary").where("code >= 0").limit(2 * most)
    got = sorted(tuple(map(lambda x: x if isinstance(x, int) else bytes(x), r)) for r in sampled.collect())
    data = [(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4").astype(float), float(posterior[c])) for c, a, v in got]
    bad = max(1e-9, sum(1 - y for *_, y in data))
    balance = min(20.0, max(0.05, sum(y for *_, y in data) / bad))
    total, bias_total, rng = np.zeros_like(weights), 0.0, np.random.default_rng(3)
    for epoch in range(epochs):
        rate = 2.0 / (1.0 + epoch)
        for i in rng.permutation(len(data)):
            at, value, y = data[i]
            p = 1.0 / (1.0 + np.exp(-np.clip(weights[at] @ value + bias, -50, 50)))
            step = rate * (y * (1 - p) - np.sqrt(balance) * (1 - y) * p)
            weights[at] += step * value
            bias += 0.1 * step
        total += weights
        bias_total += bias
    return Model(posterior, accuracy, (total / epochs).astype(np.float32), bias_total / epochs)


def _scored(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, texts in blocks(batch):
            codes = [votes(t) for t in texts]
            score = [model.value.score(t) if c >= 0 else 0.0 for c, t in zip(codes, texts)]
            weak = [float(model.value.posterior[c]) if c >= 0 else 0.0 for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(score, pa.float64()), pa.array([0.5 if w != w else w for w in weak], pa.float64()),
                                              pa.array([s >= 0.5 for s in score])], schema=schema)


def score(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, score (of good, 0 to 1), weak_score (the posterior of its votes, 0.5 if they were never
    met) and kept (score of at least a half), from the whole text.

    A null or blank text scores 0 and is not kept. Repeated rows and null keys stay as they are; other columns are not read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    small_batches(df.sparkSession)
    rows = keyed_text(df, key, text)
    schema = pa.schema([("key", to_arrow_schema(rows.schema).field(0).type), ("score", pa.float64()), ("weak_score", pa.float64()), ("kept", pa.bool_())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_scored, model=sent, schema=schema),
                           f"key {rows.schema['key'].dataType.simpleString()}, score double, weak_score double, kept boolean").withColumnRenamed("key", key)
