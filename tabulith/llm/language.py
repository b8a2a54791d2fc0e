"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, keyed_text, mix64, small_batches, spread

#: fixed values: families of languages by their codes; a language that is not here is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}
UNKNOWN = "und"
DIMENSIONS = 1 << 15
_ORDERS = (1, 2, 3)


class _Letters:
    """Which code points are letters, filled when first asked for."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        return cls.table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character n-grams of lower-cased texts with all but letters as blanks: features, the text of each, letters of each text."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(t + "   " for t in lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    sizes = np.fromiter((len(t) + 3 for t in lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _Letters.get()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter | np.concatenate([[True], letter[:-1]])  # one blank between words
    codes, owner, letter = codes[keep], owner[keep], letter[keep]
    found, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in _ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:].astype(np.uint64) + np.uint64(n)
        same = owner[:m] == owner[n - 1:]
        if n == 1:
            same &= letter
        found.append((mix64(h[same]) % np.uint64(DIMENSIONS)).astype(np.int32))
        owners.append(owner[:m][same])
    features, owners = (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    return features, owners, np.bincount(owner[letter], minlength=len(texts))


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, epochs: int = 10, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged sub-gradient steps over unit rows; both classes weigh the same."""
    w, total, bias, bias_total = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    scale, steps = 1.0, 0
    share = {1: 0.5 * len(signs) / max(1, (signs > 0).sum()), -1: 0.5 * len(signs) / max(1, (signs < 0).sum())}
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            steps += 1
            rate = 1.0 / (ridge * (steps + 1.0 / ridge))
            index, value = rows[i]
            y = signs[i]
            margin = y * (scale * float(w[index] @ value) + bias)
            scale *= 1.0 - rate * ridge
            if margin < 1:
                w[index] += rate * y * share[int(y)] * value / scale
                bias += 0.1 * rate * y * share[int(y)]
        total += w * scale
        bias_total += bias
    return total / epochs, bias_total / epochs


@dataclass
class Model:
    """Weights: one machine for each family against the others, one for each pair of languages in a family."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    machines: list[tuple[str, str]] = field(default_factory=list)  # (family, "") or a pair of languages
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        features, owner, letters = grams(texts)
        n = len(texts)
        counts = np.bincount(owner, minlength=n).astype(np.float64)
        # rows of n-gram counts are scaled by their root of squares, estimated from the counts themselves
        order = np.argsort(owner, kind="stable")
        features, owner = features[order], owner[order]
        starts = np.searchsorted(owner, np.arange(n))
        norms = _norms(features, owner, n)
        scores = np.zeros((len(self.machines), n))
        some = counts > 0
        for k in range(len(self.machines)):
            if len(features):
                sums = np.add.reduceat(self.weights[k][features].astype(np.float64), np.minimum(starts, len(features) - 1))
                scores[k] = np.where(some, sums / np.maximum(norms, 1e-12), 0.0) + self.biases[k]
        where = {m: k for k, m in enumerate(self.machines)}
        langs, sure = [], []
        for i in range(n):
            if not letters[i] or not self.families:
                langs.append(UNKNOWN)
                sure.append(0.0)
                continue
            if len(self.families) > 1:
                margins = [scores[where[f, ""], i] for f in self.families]
                family = self.families[int(np.argmax(margins))]
                certain = _squash(max(margins))
            else:
                family, certain = self.families[0], 1.0
            votes = dict.fromkeys(self.members[family], 0.0)
            for a, b in combinations(self.members[family], 2):
                p = _squash(scores[where[a, b], i])
                votes[a] += p
                votes[b] += 1 - p
            best = max(votes, key=lambda v: (votes[v], v))
            langs.append(best)
            sure.append(certain * (votes[best] / max(1, len(votes) - 1) if len(votes) > 1 else 1.0))
        return langs, sure


def _squash(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-4.0 * np.clip(margin, -100, 100))))


def _norms(features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Root of the sum of squared counts of each text; texts come one after another."""
    out = np.zeros(n)
    if len(owner):
        for i, part in enumerate(np.split(features, np.searchsorted(owner, np.arange(1, n)))):
            c = np.bincount(part) if len(part) > 2048 else np.unique(part, return_counts=True)[1]
            out[i] = np.sqrt(float((c.astype(np.float64) ** 2).sum()))
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for langs, texts in blocks(batch):
            features, owner, _ = grams(texts)
            index, value, kept = [], [], []
            for i, lang in enumerate(langs):
                f, c = np.unique(features[owner == i], return_counts=True)
                if len(f):
                    kept.append(lang)
                    index.append(f.astype("<i4").tobytes())
                    value.append((c / np.sqrt((c.astype(float) ** 2).sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(kept, pa.string()), "index": pa.array(index, pa.binary()), "value": pa.array(value, pa.binary())})


def fit(df: DataFrame, *, text: str = "text", lang: str = "lang", most: int = 3_000, families: dict = FAMILIES) -> Model:
    """Fit on at most about ``most`` labelled rows, an equal share of each language, chosen by a hash of the text.

    The chosen rows become n-gram counts on the executors; the driver gets those and runs the few machines. Rows without a
    language or a letter are left out; without any row the model knows nothing and predicts ``und``."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"),
                     F.pmod(F.xxhash64(*spread(df)), F.lit(1_000_000)).alias("part")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    each = max(20, most // len(counts))
    share = F.lit(0)
    for name, c in counts.items():
        share = F.when(F.col("lang") == name, F.lit(int(min(1.0, each / c) * 1_000_000))).otherwise(share)
    chosen = rows.where(F.col("part") < share).select("lang", "text").mapInArrow(_vectors, "lang string, index binary, value binary")
    got = chosen.limit(2 * max(most, 20 * len(counts))).collect()  # the limit only holds if very many rows are equal
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["index"])))
    vectors = [(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["value"], "<f4").astype(float)) for r in got]
    langs = [r["lang"] for r in got]
    of = {code: f for f, codes in families.items() for code in codes}
    members: dict[str, list[str]] = {}
    for name in sorted(set(langs)):
        members.setdefault(of.get(name, name), []).append(name)
    names = sorted(members)
    machines = ([(f, "") for f in names] if len(names) > 1 else []) + [p for f in names for p in combinations(members[f], 2)]
    weights, biases = [], []
    for a, b in machines:
        if b:
            rows_at = [i for i, v in enumerate(langs) if v in (a, b)]
            signs = np.asarray([1 if langs[i] == a else -1 for i in rows_at])
        else:
            rows_at = list(range(len(langs)))
            signs = np.asarray([1 if of.get(v, v) == a else -1 for v in langs])
        w, bias = _svm([vectors[i] for i in rows_at], signs)
        weights.append(w.astype(np.float32))
        biases.append(bias)
    return Model(names, members, machines, np.asarray(weights, np.float32).reshape(-1, DIMENSIONS), np.asarray(biases))


def _predict(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, texts in blocks(batch, 500_000):
            langs, sure = model.value.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], schema=schema)


def predict(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, lang_pred and score from 0 to 1, from the whole text alone.

    A null text or one without a letter is ``und`` with score 0. Repeated rows and null keys are kept; other columns are
    not read. The model, a few weight vectors for each language pair, is sent to the executors once."""
    small_batches(df.sparkSession)
    rows = keyed_text(df, key, text)
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = pa.schema([("key", to_arrow_schema(rows.schema).field(0).type), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_predict, model=sent, schema=schema),
                           f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def known(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``df``, with their columns, whose text has a language; rows without a letter go."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def has_language(texts: pd.Series) -> pd.Series:
        values = [t or "" for t in texts.where(texts.notna(), "")]
        out: list[bool] = []
        for _, some in _cut(values):
            out += [lang != UNKNOWN for lang in sent.value.predict(some)[0]]
        return pd.Series(out, dtype=bool)

    return df.where(has_language(F.col(f"`{text}`").cast("string")))


def _cut(texts: list[str]):
    return blocks(pa.RecordBatch.from_pydict({"key": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())}), 500_000)


def held_out(key: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 3 == 1, F.lit(False))
