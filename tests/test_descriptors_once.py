"""Generated features are computed once a row, however they are nested."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tabulith.functions.folds import mod_fold
from tabulith.operators import descriptors as D


def _rows(spark):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, float(a), float(b), float(a * b)) for i, (a, b) in enumerate(rng.normal(0, 2, (40, 2)))] +
                                 [(40, None, 1.0, 2.0), (41, float("nan"), 1.0, 2.0), (42, 1.0, 2.0, None)], "id long, a double, b double, y double")


def test_operands_are_not_computed_again(spark):
    df = _rows(spark)
    space = D.generate(df, ["a", "b"], ["sqrt"], ["mul", "add"])
    rows, made = D.placed(df, space, list(space.features))
    plan = rows.select(*made.values())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("sqrt(") == 2


def test_placed_features_equal_the_written_out_ones(spark):
    df = _rows(spark)
    space = D.generate(df, ["a", "b"], list(D.UNARY), list(D.BINARY), binary_cap=5)
    rows, made = D.placed(df, space, list(space.features))
    got = rows.orderBy("id").select(*[c.alias(f"g{i}") for i, c in enumerate(made.values())]).collect()
    want = df.orderBy("id").select(*[c.alias(f"g{i}") for i, c in enumerate(space.features.values())]).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_narrow_space_has_no_filter_over_the_features(spark):
    df = _rows(spark)
    space = D.generate(df, ["a", "b"], ["sq"], ["mul"], binary_cap=3)
    folds, names = D.fold_grams(df, "y", space, by=mod_fold("id", 3))
    pdf = df.where("y is not null and a is not null and not isnan(a)").toPandas()
    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    x = {"a": a, "b": b, "sq(a)": a * a, "sq(b)": b * b}
    x |= {f"{m} mul {n}": x[m] * x[n] for m, n in combinations(["a", "b", "sq(a)"], 2)}
    whole = D.total(folds).centred()
    want = np.column_stack([x[n] for n in names])
    assert sum(f.n for f in folds.values()) == len(pdf) == 40
    np.testing.assert_allclose(whole[:-1, :-1] / 40, np.corrcoef(want.T), atol=1e-9)
