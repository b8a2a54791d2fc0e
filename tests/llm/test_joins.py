"""Hard negatives, spelling variants and the n-gram join against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import common, hard_negatives, ngram_join, spelling, tiles
from tests.llm.conftest import EDGE, prose
from tests.llm.test_matching import edited, groups


# ---- hard negatives

def test_shifted_look_ups_equal_inner_products():
    rng = np.random.default_rng(1)
    for width, most, kind in ((1, 3, np.int32), (8, 200, np.int32), (64, 256, np.int32), (13, 10 ** 6, np.int64)):
        rows, anchors = rng.integers(-most, most, (50, width)), rng.integers(-most, most, (20, width))
        digits = int(most).bit_length() + 1
        got = hard_negatives.scores(hard_negatives.tables(anchors, kind), hard_negatives.pack(rows, digits), digits)
        assert (got == rows @ anchors.T).all()


def mined(rows, every):
    """rows: (id, vector, label) that take part."""
    ints = [np.floor(256 * np.asarray(v, dtype=float)).astype(np.int64) for _, v, _ in rows]
    late = [(i is None, i or 0) for i, _, _ in rows]
    out = []
    for a, (i, _, label) in enumerate(rows):
        if i is None or i % every:
            continue
        s = [int(ints[a] @ v) for v in ints]
        first = sorted((-s[r], late[r], r) for r in range(len(rows)) if r != a and rows[r][2] == label)[:5]
        for negative, _, p in first:
            fits = sorted((-s[r], late[r], r) for r in range(len(rows)) if rows[r][2] != label and -50 * negative <= 100 * s[r] <= -95 * negative)[:3]
            out += [(i, rows[p][0], k + 1, rows[r][0], s[p], s[r]) for k, (_, _, r) in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [(hard_negatives.TILE_ROWS, hard_negatives.TILE_ANCHORS), (37, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile[0])
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", tile[1])
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=11) + (i % 3)], i % 4) for i in range(240)]
    rows += [(1_000 + i, rows[7][1], 1) for i in range(90)] + [rows[10], rows[10], (None, rows[20][1], 2), (None, rows[21][1], 0)]  # a hot vector, repeats, no id
    bad = [(2_000, None, 1), (2_010, rows[0][1], None), (2_020, [float("nan")] + rows[0][1][1:], 1), (2_030, [float("inf")] + rows[0][1][1:], 1), (2_040, [None] + rows[0][1][1:], 1)]
    schema = "vec_id bigint, embedding array<double>, label int, id string, seq string, planes string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows + bad], schema).repartition(5)
    got = sorted((tuple(r) for r in hard_negatives.mine(df, F.col("id") % 10 == 0).collect()), key=str)
    assert got == mined(rows, 10) and len(got) > 100


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("id") % 2 == 0).collect() == []
    short = [(0, [1.0, 2.0], 0), (1, [1.0], 0), (2, [], 1), (3, [0.5, 0.5], 1)]
    got = hard_negatives.mine(spark.createDataFrame(short, schema), F.col("id") == 0).collect()
    assert [tuple(r) for r in got] == mined([(i, v + [0.0] * (2 - len(v)), x) for i, v, x in short], 100)
    with pytest.raises(ArithmeticError):
        hard_negatives.mine(spark.createDataFrame([(0, [1e12], 0), (1, [1e12], 0)], schema), F.col("id") == 0).collect()


# ---- spelling variants

def spelled(rows, every=31):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    out = {}
    for w, n in words.items():
        around = [u for u in words if abs(len(u) - len(w)) < 2 and u != w and near(w, u)]
        form = min(around, key=lambda u: (-words[u], u), default=None)
        out[w] = (n, len(around), form if form is not None and words[form] >= 10 * n else None)

    def root(w):
        return w if out[w][2] is None else root(out[w][2])
    return {(w, n, k, form, words.get(form), root(w)) for w, (n, k, form) in out.items()}


def test_spelling_variants_equal_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choices("abAé", k=r.randint(6, 12))) for _ in range(60)] + ["common" + x for x in ("ly", "lie", "ness", "less")]
    rows = []
    for i in range(400):
        words = r.choices(base[:5], k=20) + r.choices(base, k=6)
        k = r.randrange(len(words))
        words[k] = words[k][:3] + r.choice("abÿ×") + words[k][4:]
        rows.append((None if i % 97 == 0 else i, " ".join(words) + r.choice([".", "-x", "3"])))
    rows += [(900, "x" * 24 + " " + "x" * 24 + " " + "x" * 25), (901, "x" * 24 + " " + "x" * 23 + "y"), (902, "x" * 25 + " " + "x" * 23 + "y"), (902, rows[5][1]), (903, None), (904, "")]
    rows += [(1_000 + i, "chainbb " * 40 + "chainab " * (i % 10 < 7) + "chainaa" * (i == 4)) for i in range(40)] + [(2_000, "chainaa")]
    df = spark.createDataFrame([(*x, "w") for x in rows], "doc_id bigint, text string, word string").repartition(4)
    got = {(x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in spelling.group(spelling.word_counts(df)).collect()}
    want = spelled(rows)
    assert got == want and sum(1 for x in want if x[3]) > 20 and any(x[5] not in (x[0], x[3]) for x in want)


def test_spelling_of_edge_rows(spark, edge, empty):
    got = {(x.word, x.n, x.n_near, x.form, x.form_n, x.root) for x in spelling.group(spelling.word_counts(edge)).collect()}
    assert got == spelled(EDGE)
    assert spelling.group(spelling.word_counts(empty)).collect() == []


# ---- n-gram join

def whole(texts):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return sets


def alike(a, b):
    both = len(a & b)
    return a and b and 100 * both >= 80 * (len(a) + len(b) - both)


def joined(rows):
    sets = whole([t for _, t in rows])
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    least = {}
    for (key, _), r in zip(rows, root):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return sorted(((key, len(s), least.get(r) if s else key) for (key, _), s, r in zip(rows, sets, root)), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_components_of_the_join_equal_brute_force(spark, monkeypatch, small):
    """Copies, near copies around the threshold, a template that many share, a cluster of near copies, and short texts."""
    if small:  # every way is taken: blocks of large buckets, batches within a tile, hot elements
        monkeypatch.setattr(tiles, "BLOCK", 5)
        monkeypatch.setattr(tiles, "ROWS_HELD", 40)
        monkeypatch.setattr(ngram_join, "HOT", 60)
    texts = [prose(i, 20 + 7 * (i % 40)) for i in range(120)]
    texts += [edited(texts[i % 40], 0.005 * (1 + i % 9), i) for i in range(200)]
    template = prose(700, 150)
    texts += [template + " " + prose(800 + i, 26 + i % 5) for i in range(60)]
    texts += [" ".join(t.split()[:-9] + prose(1_000 + i, 9).split()) for i, t in enumerate(texts[320:350])]
    texts += [edited(texts[3] * 4, 0.012, 2_000 + i) for i in range(60)] + texts[:25] + [texts[2]] * 40
    texts += ["one two", "ONE\ttwo", "one two three", "a b c d e", "A b\x0bc d\x0ce", "é É", "É É", None, "", " \n"]
    rows = [((i * 7919) % 10_007 if i % 50 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id bigint, text string, node string, id string").repartition(6)
    got = sorted((tuple(r) for r in ngram_join.classes(df).collect()), key=str)
    want = joined(rows)
    assert got == want
    sizes = Counter(c for _, _, c in want)
    assert sizes.most_common(1)[0][1] >= 40 and sum(1 for n in sizes.values() if n == 1) >= 50


def test_join_of_edge_rows(spark, edge, empty):
    got = sorted((tuple(r) for r in ngram_join.classes(edge).collect()), key=str)
    assert got == joined(EDGE)
    assert ngram_join.classes(empty).collect() == []


def test_bitmaps_never_differ_in_more_bits_than_sets_do():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 3, 40, 130, 1_000, 1_200):
        s = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [s, np.concatenate([s[n // 9:], rng.integers(0, 1 << 63, n // 7, dtype=np.uint64)])]
    bits = tiles.Bitmaps([tiles.bitmap(s, len(s)) for s in sets])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    differ = bits.differing(i, j)
    for a, b, d in zip(i, j, differ):
        assert d <= len(set(sets[a].tolist()) ^ set(sets[b].tolist()))
    assert differ[(i == 10) & (j == 8)][0] > 800  # sets without a common element are told apart


def test_word_hashes_tell_words_apart():
    texts = ["a a\x00 a\x00\x00 abcdefg abcdefgh abcdefghi", "", " \t", "x" * 50 + " " + "x" * 51 + "\vÉ é É\x85y A", "ABCDEFGHI abcdefghabcdefgh"] + [prose(i, 300) for i in range(20)]
    h, counts = ngram_join.word_hashes(texts)
    words = [t.encode().lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for some in words for w in some]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


@pytest.mark.parametrize("sent", [400_000, 0])
def test_rows_are_sifted_by_values_of_any_number(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "SENT_ROWS", sent)
    rows = spark.range(20_000).select(F.col("id").alias("value_"), F.md5(F.col("id").cast("string")).alias("id")).repartition(4)
    values = common.stored(rows.where("value_ % 50 = 0 OR value_ < 5").select(F.col("id").alias("v")).unionAll(rows.limit(9).select("id")), "values")
    got = common.among(rows, "id", values)
    assert got.columns == rows.columns
    wanted = {r.v for r in values.collect()}
    found = [r.id for r in got.collect()]
    assert wanted <= set(found) and len(found) == len(set(found)) <= len(wanted) + 20
    assert common.among(rows, "id", common.stored(values.where("false"), "none")).collect() == []


def test_only_texts_of_likely_pairs_and_one_of_equal_buckets_go_on(spark, monkeypatch):
    """Texts share a passage that gives them many equal buckets, and few are alike: their texts are not joined, and tiles get a bucket once."""
    texts = [prose(5, 12) + " " + prose(100 + i, 40 + i % 3) for i in range(90)]
    texts += [edited(texts[i], 0.01, i) for i in range(4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    given, opened, check, plain = [], [], ngram_join.check, tiles._tiled
    monkeypatch.setattr(ngram_join, "check", lambda pairs, texts, *a, **k: given.append((pairs.count(), texts.count())) or check(pairs, texts, *a, **k))
    monkeypatch.setattr(tiles, "_tiled", lambda rows, *a: opened.append(rows) or plain(rows, *a))
    got = sorted((tuple(r) for r in ngram_join.classes(df).collect()), key=str)
    assert got == joined(list(enumerate(texts)))
    assert given and all(n <= 2 * pairs and n < 45 for pairs, n in given)
    for rows in opened:
        held = [tuple(sorted(r.ids)) for r in rows.groupBy("bucket").agg(F.collect_list(F.struct("id", "short")).alias("ids")).collect()]
        assert len(held) == len(set(held))
