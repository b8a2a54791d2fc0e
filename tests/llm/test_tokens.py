"""Token shards, prefix counts and packing against the tokenizer library and brute force."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabulith.llm import packing, perfect_hash, prefix_counts, token_files
from tabulith.llm.queries import vocabulary
from tabulith.llm.tokens import PieceTokenizer
from tabulith.session import scratch_path
from tests.llm.conftest import EDGE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def odd_texts(n=1500):
    r = random.Random(4)
    parts = ["a", "b", " ", " ", "\n", "'", "s", "!", "é", "1", "\t", "re", " ", "<|endoftext|>", "\r", "\x1d", "日", "\x00", ".", "word"]
    return ["", " ", "\n", "it's 's 're", "a   b\n\n c ", "-" * 300, "a" * 400, " " * 90 + "x"] + ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(n)]


def test_pieces_give_the_librarys_ids(library):
    tok = PieceTokenizer(vocabulary(), limit=200)  # forgets often
    texts = odd_texts() + [t or "" for _, t in EDGE]
    got = [np.frombuffer(b, "<u2").tolist() for i in range(0, len(texts), 100) for b in tok.packed(texts[i:i + 100])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_has_the_librarys_count(library):
    counter = prefix_counts.PrefixCounter(vocabulary(), limit=300)
    for text in odd_texts(400):
        want = [len(e.ids) for e in library.encode_batch_fast([text[:i + 1] for i in range(len(text))], add_special_tokens=False)]
        table = counter.table(text)
        assert prefix_counts.unpack(table).tolist() == want, text
        for budget in (0, 1, 5):
            assert prefix_counts.longest_within(table, budget) == max([0, *(i + 1 for i, c in enumerate(want) if c <= budget)])
        assert prefix_counts.tokens_before(table, 0) == 0 and prefix_counts.tokens_before(table, 10 ** 6) == (want or [0])[-1]


def test_prefix_tables_of_edge_rows(spark, edge, empty, library):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in prefix_counts.budgets(prefix_counts.prefix_tables(edge, vocabulary()), 512).collect())
    count = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in EDGE}
    assert got == sorted((-1 if i is None else i, len((t or "").encode()), count[t], count[t] > 512) for i, t in EDGE)
    assert prefix_counts.budgets(prefix_counts.prefix_tables(empty, vocabulary()), 512).collect() == []


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = np.random.default_rng(0).choice(1 << 60, 20_000, replace=False).astype(np.int64) - (1 << 59)
    mph = perfect_hash.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    index = perfect_hash.Index(perfect_hash.dump(keys, {"v": keys * 2}))
    there, values = index.find(keys[::-1])
    assert there.all() and (values["v"] == keys[::-1] * 2).all()
    strange, _ = index.find(np.arange(5_000, dtype=np.int64) * 3 + (1 << 61))
    assert strange.sum() <= 1
    assert perfect_hash.PerfectHash.build(np.zeros(0, np.int64)).slots(np.arange(3)).tolist() == [-1] * 3


def test_shards_come_back_whole(spark, edge, library):
    path = scratch_path(spark, "tokens")
    token_files.write(edge, path, vocabulary())
    reader = token_files.Reader(spark, path)
    got = reader.fetch(edge).collect()
    assert len(got) == len(EDGE)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted((i for i, _ in EDGE), key=lambda i: (i is not None, i))
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == r.n_tokens and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in EDGE)
    assert sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), "<u2").tolist()) for r in got) == want
    assert reader.ids(12).tolist() == library.encode("one two three.", add_special_tokens=False).ids + [2]
    assert reader.ids(999) is None


def test_shards_of_an_empty_table(spark, empty):
    path = scratch_path(spark, "tokens")
    token_files.write(empty, path, vocabulary())
    reader = token_files.Reader(spark, path)
    assert reader.fetch(empty).collect() == [] and reader.ids(1) is None


def best_padding(lengths, counts, k):
    best = {0: 0.0}
    for _ in range(k):
        new = dict(best)
        for i, b in best.items():
            for j in range(i + 1, len(lengths) + 1):
                c = b + sum(counts[x] * (lengths[j - 1] - lengths[x]) for x in range(i, j))
                new[j] = min(new.get(j, 1e18), c)
        best = new
    return best[len(lengths)]


def test_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 12)))
        counts = [r.randint(1, 9) for _ in lengths]
        k = r.randint(1, 5)
        ends = packing.boundaries(np.asarray(lengths), np.asarray(counts), k)
        padding = sum(c * (min(e for e in ends if e >= v) - v) for v, c in zip(lengths, counts))
        assert len(ends) <= k and ends[-1] == lengths[-1] and padding == best_padding(lengths, counts, k)


def test_batches_keep_every_token_and_the_budget(spark):
    rows = [(i, (i * 37) % 300 + (3_000 if i % 50 == 0 else 0), "x", "y") for i in range(4_000)] + [(None, None, "x", "y"), (9_001, 0, "x", "y"), (7, 5, "x", "y"), (7, 5, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, piece string, slice string")
    got = packing.pack(df, buckets=6, sequence=1_024, budget=8_192).collect()
    placed = [r for r in got if r.batch is not None]
    assert {r.doc_id for r in got if r.batch is None} >= {None, 9_001}
    total = {}
    for r in placed:
        assert r.n_tokens <= r.bucket_len and r.slot < 8_192 // r.bucket_len
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {i: n for i, n in ((r[0], r[1]) for r in rows[:4_000]) if n} | {7: total[7]} and total[7] == (7 * 37) % 300 + 10
    assert len({(r.batch, r.slot) for r in placed}) == len(placed)
    per = {}
    for r in placed:
        per.setdefault(r.batch, []).append(r)
    lens = {b: v[0].bucket_len for b, v in per.items()}
    assert sorted(per) == list(range(len(per))) and all(len({r.bucket_len for r in v}) == 1 for v in per.values())
    short = [b for b, v in per.items() if len(v) < 8_192 // lens[b]]
    assert len(short) <= len(set(lens.values()))
    assert packing.pack(df.limit(0)).collect() == []


def test_lengths_of_edge_rows(spark, edge, library):
    got = sorted((str(r.doc_id), r.n_tokens) for r in packing.token_lengths(edge, vocabulary()).collect())
    assert got == sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in EDGE)


def test_a_piece_is_looked_up_once_for_all_texts_of_a_call(library):
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    tok = PieceTokenizer(vocabulary())
    tok.known = Counted()
    texts = ["some words, and others. " * k + "é 日本 x" for k in range(1, 60)] + ["", "\n", "a  b", "\x00", "<|endoftext|> it"]
    for some in (texts, texts[:59]):
        Counted.asked = 0
        got = [np.frombuffer(b, "<u2").tolist() for b in tok.packed(some)]
        assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert Counted.asked < 40


def test_batches_are_encoded_together():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"key": [1, None], "text": ["a" * 1_500_000, None]})
    got = list(token_files._gathered(iter([batch] * 4 + [batch.slice(0, 0)])))
    assert [k for keys, _ in got for k in keys] == [1, None] * 4
    assert [len(t) for _, texts in got for t in texts] == [1_500_000, 0] * 4 and len(got) == 2
