"""Fitted tree ensembles as arrays, evaluated in NumPy inside Arrow batches.

Explanations ask for very many predictions around each row.  With the splits
held as arrays a task makes them in memory, and no row is copied by Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..session import scratch_path

#: rows that are predicted at a time
ROWS_AT_ONCE = 200_000


@dataclass
class Forest:
    """Nodes of all trees one after another; a leaf has feature -1 and its children are itself."""

    roots: np.ndarray
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # nodes x classes (shares of the classes), or nodes x 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        """rows x classes chances, or rows x 1 predictions: the mean over the trees."""
        x = np.ascontiguousarray(x, dtype=np.float64)
        out = np.empty((len(x), self.value.shape[1]))
        for at in range(0, len(x), ROWS_AT_ONCE):
            part = x[at:at + ROWS_AT_ONCE]
            rows, total = np.arange(len(part)), np.zeros((len(part), self.value.shape[1]))
            for root in self.roots:
                node = np.full(len(part), root)
                for _ in range(self.depth):
                    f = self.feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = part[rows, np.maximum(f, 0)] <= self.threshold[node]
                    node = np.where(goes_left, self.left[node], self.right[node])
                total += self.value[node]
            out[at:at + ROWS_AT_ONCE] = total / len(self.roots)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of the second class, or the prediction."""
        got = self.predict(x)
        return got[:, 1] if got.shape[1] > 1 else got[:, 0]


def forest(spark, model, classes: int) -> Forest:
    """The arrays of a fitted forest, from its stored form: a row for each node, as many as the trees have."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").orderBy("treeID", "nodeData.id").select("treeID", "nodeData.*").collect()
    first: dict[int, int] = {}
    for i, r in enumerate(nodes):
        first.setdefault(r["treeID"], i)
    n = len(nodes)
    feature, threshold, left, right = np.full(n, -1), np.zeros(n), np.arange(n), np.arange(n)
    value = np.zeros((n, classes or 1))
    depth = np.zeros(n, np.int64)
    for i, r in enumerate(nodes):
        if classes:
            stats = np.asarray(r["impurityStats"], float)
            value[i] = stats / (stats.sum() or 1.0)
        else:
            value[i] = r["prediction"]
        if r["leftChild"] >= 0:
            feature[i], threshold[i] = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
            left[i], right[i] = first[r["treeID"]] + r["leftChild"], first[r["treeID"]] + r["rightChild"]
            depth[left[i]] = depth[right[i]] = depth[i] + 1  # children come after their parent
    return Forest(np.asarray(sorted(first.values())), int(depth.max(initial=0)), feature, threshold, left, right, value)
