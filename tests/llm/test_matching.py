"""Near-duplicates, components, decontamination and the pipeline against brute force."""

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline
from tabulith.llm import decontaminate, near_duplicates, tiles
from tabulith.llm.components import components
from tests.llm.conftest import EDGE, prose


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.randint(0, 10 ** 6)}" if r.random() < share else w for w in text.split())


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_equal_union_find(spark):
    r = random.Random(1)
    n = 400
    links = [(r.randrange(n), r.randrange(n)) for _ in range(230)] + [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)]
    want = groups(n, links)
    for one_task in (10 ** 6, 0):
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), one_task=one_task).collect()}
        assert all(got.get(i, i) == want[i] for i in range(n))


def test_samples_estimate_the_weighted_similarity():
    idf = np.where(np.arange(1 << near_duplicates.DF_BITS) % 3 == 0, 0.4, 1.0)
    base = prose(11, 400)
    for share in (0.01, 0.05, 0.1):
        sets = near_duplicates.shingles([base + " " + base[:300], edited(base, share, 5)])
        want = near_duplicates.similarity(sets[0], sets[1], idf)
        rows = near_duplicates.bands([sets[0], sets[1]] , idf)
        assert rows.shape == (2, near_duplicates.BANDS)
        near = (rows[0] == rows[1]).mean()
        assert abs(near - want ** near_duplicates.ROWS) < 0.45


def test_classes_equal_brute_force(spark):
    texts = [prose(100 + i, 60 + i % 90) for i in range(150)]
    texts += [edited(texts[i % 20], 0.01 + 0.01 * (i % 5), i) for i in range(150)] + texts[:30] + ["one two", "one two", None, ""]
    df = spark.createDataFrame([(i * 3, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, node string")
    got = {r.doc_id // 3: r for r in near_duplicates.classes(df).collect()}
    sets = near_duplicates.shingles([t or "" for t in texts])
    ones = np.ones(1 << near_duplicates.DF_BITS)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near_duplicates.similarity(sets[i], sets[j], ones) >= 0.8]
    want = groups(len(texts), links)
    # shingles of large groups weigh a little less, so pairs near the threshold may differ
    sure = [(i, j) for i, j in links if near_duplicates.similarity(sets[i], sets[j], ones) >= 0.9]
    assert all(got[i].class_id == got[j].class_id for i, j in sure)
    assert sum(got[i].class_id // 3 != want[i] for i in range(len(texts))) <= 0.02 * len(texts)
    assert all(r.kept == (r.class_id == r.doc_id) for r in got.values())
    sizes = defaultdict(int)
    for r in got.values():
        sizes[r.class_id] += 1
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


def test_classes_of_edge_rows(spark, edge, empty):
    got = near_duplicates.classes(edge).collect()
    assert len(got) == len(EDGE)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[5] == by[6] == by[7] == {5} and by[8] == by[9] == {8} and by[1] == {1} and by[2] == {2} and by[None] == {None}
    kept = near_duplicates.drop(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in (None, 1, 2, 3, 4, 5, 8, 10, 11, 12))
    assert near_duplicates.classes(empty).collect() == [] and near_duplicates.drop(empty).collect() == []


def test_common_subsequence_equals_the_table():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        assert decontaminate.common_subsequence(a, b) == row[-1]


def test_leaks_copied_edited_and_none(spark):
    items = [(i, prose(500 + i, 12 + 3 * i)) for i in range(20)] + [(90, None), (91, ""), (92, "tiny item here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs, want = [], set()
    for i, (_, text) in enumerate(items[:20]):
        docs.append((i, prose(700 + i, 40 + 17 * i) + " " + text + " " + prose(800 + i, 30)))
        want.add((i, i))
        docs.append((100 + i, prose(900 + i, 60) + " " + edited(text, 0.08, i) + " " + prose(950 + i, 200)))
        docs.append((200 + i, prose(1_000 + i, 150)))
    docs += [(300, "before it a tiny item here and after"), (301, "tiny here item"), (None, items[5][1]), (302, None), (302, "")]
    want |= {(300, 92), (None, 5)}
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id bigint, text string, key string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert want <= got
    assert not any(d is not None and (200 <= d < 300 or d > 300) for d, _ in got)
    edited_found = {d for d, i in got if d is not None and 100 <= d < 200 and i == d - 100}
    assert len(edited_found) >= 16
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.clean(df, bench).columns == df.columns
    assert decontaminate.leaks(df, bench.limit(0)).collect() == [] and decontaminate.leaks(df.limit(0), bench).collect() == []


def test_leaks_of_edge_rows(spark, edge):
    bench = spark.createDataFrame([(1, prose(3, 120)), (1, prose(2, 30_000)[40_000:40_400])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(edge, bench).collect()}
    assert {(5, 1), (6, 1), (7, 1), (4, 1)} <= got and all(d in (4, 5, 6, 7) for d, _ in got)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    """Each stage's decisions, told by plain Python, on a small corpus with one case of each kind."""
    clean = [(i, prose(2_000 + i, 120), "en", "s", 1) for i in range(40)]
    item = prose(3_000, 30)
    cases = [(100, None, "en", "s", 0), (101, "12 34", "en", "s", 5), (102, clean[3][1], "en", "s", 1), (103, prose(50, 60) + " " + item + " " + prose(51, 60), "en", "s", 1),
             (104, prose(52, 60) + " password=hunter2hunter2 " + prose(53, 20), "en", "s", 1)]
    spark.createDataFrame(clean + cases, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
    rows = {r.doc_id: r for r in df.collect()}
    assert set(rows) == set(range(40)) | {104}
    assert "hunter2" not in rows[104].text and "[assign]" in rows[104].text and rows[104].n_chars == len(rows[104].text)
    assert all(rows[i].text == clean[i][1] for i in range(40))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_leaks_do_not_depend_on_the_size_of_the_benchmark(spark):
    """1,200 items over one small vocabulary, each verbatim in a longer document, and some with every eighth word replaced."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3_000)]
    share = [1.0 / (i + 20) for i in range(len(words))]
    docs = [r.choices(words, share, k=150) for _ in range(1_200)]
    items = [(i, " ".join(d[i % 80:i % 80 + 8 + i % 50])) for i, d in enumerate(docs)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rows += [(5_000 + i, " ".join(r.choices(words, share, k=60) + [w if j % 8 else "other" for j, w in enumerate(items[i][1].split())] + r.choices(words, share, k=60)))
             for i in range(300) if i % 50 >= 8]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(df, bench).collect()}
    assert all(got.get((i, i)) == 1.0 for i, _ in items)
    assert all((d, d - 5_000) in got for d, _ in rows if d >= 5_000)
    of = dict(rows)
    assert all(decontaminate.common_subsequence(items[k][1].split(), of[d].split()) >= 0.6 * len(items[k][1].split()) for d, k in got)


def test_items_of_one_and_two_words_and_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WEIGHTS", 1)
    bench = spark.createDataFrame([(1, "zebra"), (2, "two words"), (3, prose(77, 100)), (4, prose(78, 9))], "item_id bigint, text string")
    rows = [(1, "a zebra here"), (2, "words two"), (3, "in two words"), (4, prose(1, 90) + " " + prose(77, 100)), (5, prose(78, 9))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (5, 4)}


def test_singular_vectors_of_a_low_rank_matrix():
    r = np.random.default_rng(3)
    a = r.normal(size=(400, 6)) @ (r.normal(size=(6, 90)) * np.array([9, 7, 5, 3, 2, 1])[:, None]) + r.normal(size=(400, 90)) * 1e-3
    test = r.normal(size=(90, 20))
    v, s = decontaminate.singular_vectors(a.T @ (a @ test), test, 6)
    _, want, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s, want[:6], rtol=1e-3)
    assert np.allclose(np.abs(np.sum(v * vt[:6].T, axis=0)), 1, atol=1e-3)


def test_recall_of_paraphrases(spark):
    """Items with up to two fifths of their words replaced by others: at least nine tenths of those that the checks call leaks are found."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(4_000)]
    share = [1.0 / (i + 30) for i in range(len(words))]
    items = [(i, " ".join(r.choices(words, share, k=20 + i % 60))) for i in range(300)]
    rows, planted = [], []
    for i, text in items:
        own = text.split()
        kept = len(own) - max(3, len(own) // 4)  # the answer stays
        for j in range(kept):
            if r.random() < 0.1 + 0.4 * (i % 10) / 10:
                own[j] = r.choices(words, share)[0]
        rows.append((i, " ".join(r.choices(words, share, k=r.randint(0, 90)) + own + r.choices(words, share, k=r.randint(0, 200)))))
    rows += [(1_000 + i, " ".join(r.choices(words, share, k=r.randint(60, 300)))) for i in range(900)]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(df, bench).collect()}
    read, place = decontaminate._benchmark(bench, "item_id", "text")
    of = {i.key: i for i in read}
    ids = {d: [place.get(w, -1) for w in decontaminate.tokens(t)] for d, t in rows}
    for i, _ in items:
        n, all_ids = len(of[i].words), ids[i]
        if any(decontaminate.judged(of[i], all_ids[at:at + 2 * n + 64]) for at in range(0, len(all_ids), 32)):
            planted.append(i)
    exact = {p for p in planted if decontaminate.judged(of[p], ids[p]) >= 0.999}
    assert len(planted) >= 200 and len(planted) - len(exact) >= 150
    found = sum((i, i) in got for i in planted)
    assert found >= 0.9 * len(planted), (found, len(planted))
    assert sum(d >= 1_000 for d, _ in got) == 0


def test_pairs_inside_a_hot_template_equal_brute_force(spark):
    """300 documents share a long passage and are too unlike for a link; 60 of them have a near copy."""
    template = prose(9_000, 260)
    texts = [template + " " + prose(9_100 + i, 45) for i in range(300)]
    for i in range(60):
        own = texts[i].split()
        texts.append(" ".join(own[:-27] + prose(9_500 + i, 27).split()))
    texts += [prose(20_000 + i, 12) for i in range(3_400)]  # the template stays in under a tenth of the texts
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    found = near_duplicates.classes(df).collect()
    sets = near_duplicates.shingles(texts)
    idf = near_duplicates.idf_table(df.selectExpr("unhex(md5(text)) AS node", "text"))
    t = near_duplicates.THRESHOLD
    links = [(i, j) for i in range(360) for j in range(i) if near_duplicates.similarity(sets[i], sets[j], idf) >= t]
    want = groups(360, links)
    got = {r.doc_id: r.class_id for r in found}
    assert 40 <= len(links) and len(set(want)) >= 200
    assert [got[i] for i in range(360)] == want


def test_copies_do_not_change_which_near_copies_are_linked(spark):
    """Near copies at 0.82 to 0.88 of a text that a third of the rows hold."""
    base = prose(9_900, 300).split()
    near = []
    for i, n in enumerate((15, 18, 21, 24)):
        own = list(base)
        own[100:100 + n] = prose(9_910 + i, n).split()
        near.append(" ".join(own))
    others = [prose(9_950 + i, 80) for i in range(120)]
    sets = near_duplicates.shingles([" ".join(base), *near])
    ones = np.ones(1 << near_duplicates.DF_BITS)
    assert all(0.81 <= near_duplicates.similarity(sets[0], x, ones) <= 0.89 for x in sets[1:])
    answers = []
    for copies in (1, 65):
        rows = [(i, " ".join(base)) for i in range(copies)] + [(1_000 + i, x) for i, x in enumerate(near)] + [(2_000 + i, x) for i, x in enumerate(others)]
        got = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        answers.append([got[1_000 + i] for i in range(len(near))])
    assert answers == [[0] * len(near)] * 2


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, a column more and one less; and an empty table."""
    item = prose(3_100, 30)
    rows = [(i, prose(3_200 + i, 90), "en", "x") for i in range(12)]
    rows += [rows[3], rows[3], (None, prose(3_300, 80), None, None), (None, None, "en", "x"), (50, "", "en", "x"), (51, prose(3_301, 50) + " " + item, "en", "x"), (52, rows[4][1], "en", "x")]
    spark.createDataFrame([(1, item), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, node string").write.parquet(f"{tmp_path}/a/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, f"{tmp_path}/a")
        assert out.dtypes == df.dtypes, name
        out.write.parquet(f"{tmp_path}/a/{k}")
        df = spark.read.parquet(f"{tmp_path}/a/{k}")
    assert sorted(str(r.doc_id) for r in df.collect()) == sorted([*map(str, range(12)), "None"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()} == {*range(12), None}
    spark.createDataFrame([], "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_rows_made_by_tiles_grow_with_texts_not_with_pairs(spark, monkeypatch):
    """240 texts share a passage: too unlike for a link, and 40 of them have a near copy; bitmaps rule few pairs out."""
    texts = [" ".join((prose(9_000, 260) + " " + prose(8_100 + i, 30 if i % 2 else 42)).split()) for i in range(240)]
    texts += [" ".join(t.split()[:-20] + prose(8_500 + i, 20).split()) for i, t in enumerate(texts[:40])]
    texts += [prose(30_000 + i, 12) for i in range(2_700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    made, old = {}, tiles.stored

    def counted(rows, label):
        out = old(rows, label)
        made[label] = max(out.count(), made.get(label, 0))
        return out
    monkeypatch.setattr(tiles, "stored", counted)
    for few, block, weight in ((tiles.FEW, tiles.BLOCK, tiles.WEIGHT), (0, 64, 20_000)):  # the second leaves all to the tiles with whole sets
        monkeypatch.setattr(tiles, "FEW", few)
        monkeypatch.setattr(tiles, "BLOCK", block)
        monkeypatch.setattr(tiles, "WEIGHT", weight)
        made.clear()
        got = {r.doc_id: r.class_id for r in near_duplicates.classes(df).collect()}
        assert made["near"] <= (2 * few + 1) * made["open"] and made["joining"] <= made["ids"]
        sets = near_duplicates.shingles(texts[:280])
        idf = near_duplicates.idf_table(df.selectExpr("unhex(md5(text)) AS node", "text"))
        links = [(i, j) for i in range(280) for j in range(i) if near_duplicates.similarity(sets[i], sets[j], idf) >= near_duplicates.THRESHOLD]
        assert len(links) > 100 and [got[i] for i in range(280)] == groups(280, links)


def test_search_of_passages_takes_them_together(monkeypatch):
    """Steps of the search grow with blocks of passages, not with passages; sums of groups and words equal the plain way."""
    r = np.random.default_rng(6)
    table, rows = r.integers(-9, 9, (50, 7)).astype(np.float32), r.integers(0, 50, 9_000)
    for most in (3, 700, 2_048):
        monkeypatch.setattr(decontaminate, "GATHERED", most)
        for starts in (np.array([0]), np.unique(np.append(0, r.integers(0, 9_000, 40))), np.arange(9_000)):
            want = [table[rows[a:b]].sum(axis=0) for a, b in zip(starts, [*starts[1:], 9_000])]
            assert (decontaminate._sums(table, rows, starts) == want).all()
    for text in ("It's a_b 9x-Z\x1c\x00y\n(ok).", "Élan a_b İx ß2", "", "___"):
        assert decontaminate.tokens(text) == decontaminate._TOKEN.findall(text.lower())
    words = [list(map(int, r.integers(0, 40, 30))) for _ in range(20)]
    items = [decontaminate.Item(i, w, w[-8:]) for i, w in enumerate(words)]
    vectors = r.normal(size=(40, 4)).astype(np.float32)
    latent = np.asarray([vectors[w].sum(axis=0) for w in words])
    latent /= np.sqrt((latent ** 2).sum(axis=1, keepdims=True))
    space = decontaminate.Space(np.ones(41), items, np.ones(20, np.int64), [np.asarray(w) for w in words], np.full(20, 32), np.full(20, 18 - 1e-9),
                                vectors, np.arange(20), np.ascontiguousarray(latent.T.astype(np.float32)), [])
    counts = np.asarray([0, 10, 40, 3_000, 64, 5_000])
    ids = r.integers(-30, 40, counts.sum()).clip(-1)
    half, first = decontaminate._halves(counts)
    owner, calls, plain = np.repeat(np.arange(len(counts)), np.diff(first)), [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or plain(*a, **k))
    met = {}
    decontaminate._near(space, ids, counts, half, owner, first, met)
    monkeypatch.undo()
    want = {}
    starts = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        own = ids[starts[t]:starts[t] + n]
        for at in range(int(first[t + 1] - first[t])):
            window = own[at * 32:at * 32 + 64]
            v = vectors[window[window >= 0]].sum(axis=0) if (window >= 0).any() else np.zeros(4)
            if not v.any():
                continue
            near = np.flatnonzero(latent @ v / np.sqrt((v ** 2).sum()) >= decontaminate.COSINE)
            region = set(own[max(0, at * 32 - 32):at * 32 + 96].tolist()) - {-1}
            for k in near.tolist():
                if sum(w in region for w in words[k]) >= 18:
                    want.setdefault((t, k), set()).add(at)
    assert met == want and len(met) > 20 and len(calls) <= 5
