"""Connected components of a link table: in one bounded task, or by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours to the least node it knows: the greater neighbours (large star) or the others (small star)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    seen = both.join(least, "a")
    moved = seen.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else seen.select(
        F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


#: a counted table of at most so many links (some 20 MB) is joined by one task on an executor
ONE_TASK = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if kind is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, kind), "root": pa.array([find(x) for x in nodes], kind)})


def components(links: DataFrame, most_rounds: int = 50, one_task: int = ONE_TASK) -> DataFrame:
    """node and root (the least node of its component) for every node of ``links`` (columns a and b).

    Up to ``one_task`` links, by count, go to one task that joins sets; the answer is the same beyond. There both stars use a partial minimum and a join that can be split, so a node with very many links is no hot group. Each
    round is written to the shared folder. Rounds grow with the logarithm of the links; the end is a table of stars that a
    round leaves as it is."""
    links = stored(links.select("a", "b").where("a != b"), "links")
    if links.count() <= one_task:
        kind = links.schema["a"].dataType.simpleString()
        return links.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}")
    links = stored(links.distinct(), "links")
    before = None
    for _ in range(most_rounds):
        links = stored(_star(_star(links, True), False), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
