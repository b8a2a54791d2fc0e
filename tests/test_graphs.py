"""Random graphs of the fluctuation detector: drawn in tasks, equal to Spark's hashes, nothing sent whole to the driver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulith.functions.folds import hashed
from tabulith.operators import outliers


def test_hash_equals_that_of_spark(spark):
    got = np.array(spark.range(-50, 50).select(F.xxhash64("id", F.lit(3), F.lit(-7))).collect())[:, 0]
    assert (hashed(-7, hashed(3, hashed(np.arange(-50, 50), wide=True))).view(np.int64) == got).all()


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_scores_equal_a_plain_loop(spark, monkeypatch, n):
    monkeypatch.setattr(outliers, "GRAPH_ROWS", 100)  # several passes over blocks
    x = np.round(np.random.default_rng(n).gamma(2.0, 50.0, n), 2)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n) * 3, "x": x})).repartition(3)
    out = outliers.fluctuation_flags(df, ["x"], ["id"], drop=5)
    assert out.columns == ["id", "x", "score", "is_outlier"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert n == 1 or plan.count("BroadcastExchange") <= 1 and "SortMergeJoin" in plan  # the twenty flagged rows only
    got = out.toPandas().sort_values("id")
    k = min(10, n - 1)
    if k < 1:
        assert got["score"].isna().all() and not got["is_outlier"].any()
        return
    draws = [F.pmod(F.xxhash64(F.col("id"), F.lit(g), F.lit(j), F.lit(42)), F.lit(n - 1)) + 1 for g in (0, 1) for j in range(3 * k)]
    offs = np.array(spark.range(n).orderBy("id").select(*draws).collect()).reshape(n, 2, 3 * k)
    near = [[[(i + o) % n for o in list(dict.fromkeys(offs[i, g].tolist()))[:k]] for g in (0, 1)] for i in range(n)]
    c = np.array([sum(x[i] / (x[i] + x[near[i][g]].sum() + 1e-10) for g in (0, 1)) for i in range(n)])
    want = np.array([np.abs(c[i] - c[near[i][1]]).sum() for i in range(n)])
    assert np.allclose(got["score"], want, rtol=1e-9)
    assert set(np.flatnonzero(got["is_outlier"])) == set(sorted(range(n), key=lambda i: (-want[i], i))[:5])
