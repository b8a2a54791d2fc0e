"""Spelling variants of the words of a corpus, by a frontier of states that walks a trie kept as a table of edges.

A state is a word, the text it would become by its edits so far, a node of the trie and the number of edits. At each level the
states join the edges below their nodes: a state without an edit goes on along its word, and at each edge where another
character stands it branches into an insertion or a replacement; a state with one edit only goes on along its text. States
that reach the end of a word with one edit are neighbours. Nearness has no direction: a deletion is found as the insertion
that leads back, and of two words with different characters at one place the one with the lesser looks for the other.

Two words one edit apart share the first half of the one or its last half. So states start half-way down, and the words are
in the trie twice, forwards and backwards: near the root, where a node has very many words, no state branches."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, keyed_text, small_batches, stored

RUN = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: of two near words the form occurs this many times as often
RATIO = 10
#: stands behind the last character of a word; no word holds it
END = "\n"
#: different words a task counts before it hands the counts on
WORDS_HELD = 500_000


def _counts(batches: Iterator[pa.RecordBatch], every: int, least: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{RUN}]{{{least},}}".replace("A-Z", ""))
    held: Counter = Counter()

    def out():
        words = list(held)
        for i in range(0, len(words), 50_000):
            part = words[i:i + 50_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "n": pa.array([held[w] for w in part], pa.int64())})
        held.clear()

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            words = runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes: only A-Z change
            if key is not None and every:
                start = zlib.crc32(f"{key}:".encode())
                for i, w in enumerate(words):
                    h = zlib.crc32(w.encode(), start)
                    if h % every == 0:
                        k = h % len(w)
                        words[i] = w[:k] + w[k + 1:]
            held.update(words)
            if len(held) > WORDS_HELD:
                yield from out()
    yield from out()


def word_counts(df: DataFrame, *, key: str = "doc_id", text: str = "text", every: int = 31, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: the runs of letters of all texts, A-Z lower-cased, with at least ``least_length`` characters and ``least_count`` occurrences.

    With ``every``, a run loses the character ``h % length`` where ``h``, the crc32 of ``key:run``, is divisible by it (0: never;
    a null key: never). Null and empty texts hold no word; repeated rows count as often as they stand."""
    small_batches(df.sparkSession)
    got = keyed_text(df, key, text).mapInArrow(partial(_counts, every=every, least=least_length), "word string, n bigint")
    return got.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _bit(text: Column, other: int) -> Column:
    """One of 64 bits for a text."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(text, F.lit(other)), F.lit(64)).cast("int"))


def _at(text: Column, depth: Column, n: int = 1 << 30) -> Column:
    """``n`` characters (all, without n) of ``text`` behind the first ``depth``."""
    return text.substr(depth + 1, F.lit(n))


def _node(text: Column, depth: Column) -> Column:
    return F.xxhash64("back", text.substr(F.lit(1), depth))


def edges(words: DataFrame) -> DataFrame:
    """The trie of ``words`` (back, text), from half-way down each word: depth, node, ch, child, n (words below the child), tail (a hash
    of what follows, for n = 1), and three sets of 64 bits below the child: of the next character, the next two, and all that follows.

    Nodes are hashes of prefixes. A clash would only send states to edges that their own text does not have. Edges of nodes
    with one word are left out: no other word's state needs them, and the edge above tells the rest."""
    length, text, own = F.length("text"), F.col("text"), F.col("depth")
    depths = words.select("back", "text", F.explode(F.sequence(F.floor((length - 2) / 2).cast("int"), length - 1)).alias("depth"))
    rest = _at(text, own + 1)
    rows = depths.select("depth", _node(text, own).alias("node"), _at(text, own, 1).alias("ch"), _node(text, own + 1).alias("child"), F.xxhash64(rest).alias("tail"), *_sets(rest))
    found = rows.groupBy("depth", "node", "ch", "child").agg(F.count("*").alias("n"), F.min("tail").alias("tail"), *[F.bit_or(c).alias(c) for c in SETS])
    # a node has as many edges as there are characters
    return found.withColumn("under", F.sum("n").over(Window.partitionBy("node"))).where("under > 1").drop("under")


SETS = ("next1", "next2", "all")


def _sets(rest: Column) -> list[Column]:
    return [_bit(rest.substr(1, 1), 1).alias("next1"), _bit(rest.substr(1, 2), 2).alias("next2"), _bit(rest, 3).alias("all")]


def _fits(rest: Column) -> Column:
    """Whether a text that goes on with ``rest`` behind an edge may be below it; for n = 1, whether it is."""
    may = [F.col(c).bitwiseAND(bit) != 0 for c, bit in zip(SETS, _sets(rest))]
    return F.when(F.col("n") == 1, F.xxhash64(rest) == F.col("tail")).otherwise(may[0] & may[1] & may[2])


def _step(states: DataFrame, below: DataFrame) -> DataFrame:
    """States (word, back, text, depth, node, edits) of one depth joined with the edges there; the next states, and hits (edits = 2).

    The depth is a column, not a constant, so that all levels run the same compiled code. Behind an edge the text goes on at
    its place after an insertion, and one character on after a replacement or the same character."""
    text, depth, ch = F.col("text"), F.col("depth"), F.col("ch")
    here, rest = _at(text, depth, 1), _at(text, depth + 1)
    walking = states.where("edits = 1").withColumn("child", _node(text, depth + 1)).join(below.drop("node"), "child")
    walking = walking.where((ch == END) | _fits(rest)).withColumn("skip", F.lit(1))
    other = (here != ch) & (ch != END)
    open_ = states.where("edits = 0").join(below, "node").select(
        "*", ((here == ch) & (ch != END) & (F.col("n") > 1)).alias("same"), (other & _fits(_at(text, depth))).alias("put"), (other & (here != END) & (here < ch) & _fits(rest)).alias("swap"))
    open_ = open_.where("same OR put OR swap")
    # whole literal arrays, so that this stays compiled
    ways = F.when(F.col("put") & F.col("swap"), F.array(F.lit(0), F.lit(1))).when(F.col("put"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    open_ = open_.withColumn("skip", F.explode(ways)).withColumn("edits", (~F.col("same")).cast("int"))
    both = walking.drop("node").unionByName(open_.drop("node", "same", "put", "swap"))
    ended = (F.col("edits") == 1) & ((ch == END) | (F.col("n") == 1))
    return both.select("word", "back", F.concat(text.substr(F.lit(1), depth), ch, _at(text, depth + F.col("skip"))).alias("text"), (depth + 1).alias("depth"),
                       F.col("child").alias("node"), F.when(ended, 2).otherwise(F.col("edits")).alias("edits"))


def neighbours(words: DataFrame) -> DataFrame:
    """word and other for all ordered pairs of ``words`` (a column of different words) one insertion, deletion or replacement apart.

    The levels are as many as the longest beginning or end that two words share; each is written to the shared folder."""
    both = words.select("word", F.lit(False).alias("back"), F.concat("word", F.lit(END)).alias("text")).unionAll(
        words.select("word", F.lit(True).alias("back"), F.concat(F.reverse("word"), F.lit(END)).alias("text")))
    trie = stored(edges(both).repartition("depth", "node").sortWithinPartitions("depth"), "trie")
    start = F.floor((F.length("text") - 1) / 2).cast("int")
    starts = both.withColumn("depth", start).select("word", "back", "text", "depth", _node(F.col("text"), F.col("depth")).alias("node"), F.lit(0).alias("edits"))
    depths = sorted(r.depth for r in trie.select("depth").distinct().collect())
    frontier, levels = None, []
    for depth in depths:
        new = starts.where(F.col("depth") == depth)
        states = new if frontier is None else new.unionByName(frontier.where("edits < 2"))
        frontier = stored(_step(states, trie.where(F.col("depth") == depth).drop("depth")), "frontier")
        levels.append(frontier)
    if not levels:
        return words.select("word", F.col("word").alias("other")).limit(0)
    hits = levels[0].where("edits = 2")
    for level in levels[1:]:
        hits = hits.unionByName(level.where("edits = 2"))
    found = F.col("text").substr(F.lit(1), F.length("text") - 1)
    pairs = hits.select("word", F.when(F.col("back"), F.reverse(found)).otherwise(found).alias("other"))
    way = F.explode(F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))).alias("p")
    return pairs.select(way).select("p.*").distinct()


def group(counts: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root for each row of ``counts`` (word, n; each word once).

    form is the near word of largest n (ties: least by code points), if that is ``ratio`` times the word's n; root is where
    forms lead to. n grows along forms by ``ratio`` each, so their chains are short."""
    counts = stored(counts.select("word", "n"), "words")
    near = neighbours(counts.select("word"))
    best = F.min(F.struct((-F.col("m")).alias("less"), "other"))
    # the join also settles that each neighbour is a word
    per = near.join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = counts.join(per, "word", "left").withColumn("found", -F.col("best.less") >= ratio * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("found"), F.col("best.other")).alias("form"), F.when(F.col("found"), -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "forms")
    hops = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that are followed
        hops = stored(hops, "hops")
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not hops.join(further, "root", "left_semi").head(1):
            break
        hops = hops.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return rows.join(hops, "word", "left").withColumn("root", F.coalesce("root", "word"))
