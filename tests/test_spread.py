"""Fits and explanations are dealt over tasks, whatever files the rows came in."""

from __future__ import annotations

import numpy as np
import pytest

from tabulith import session
from tabulith.operators import models as M
from tabulith.operators import ranking as K


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(i, float(a), float(b), float(a + b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))],
                                 "id long, a double, b double, y double").coalesce(1)


def test_spread_keeps_all_rows_and_few_rows_stay(rows):
    assert session.spread(rows, 3000) is rows
    dealt = session.spread(rows, 3000, 500)
    assert dealt.rdd.getNumPartitions() == 6 and sorted(dealt.collect()) == sorted(rows.collect())
    assert max(dealt.rdd.glom().map(len).collect()) < 700


def test_a_fit_reads_many_tasks(rows, monkeypatch):
    monkeypatch.setattr(session, "FIT_ROWS", 500)
    p = M.prepare(rows, ["a", "b"], "y", ["id"])
    assert p.train.rdd.getNumPartitions() >= 4 and p.train.count() + p.test.count() == 3000
    p.release()


def test_shap_is_dealt_by_its_work_and_stays_equal(rows, monkeypatch):
    t = K.task(rows.limit(300).coalesce(1), "y", ["id"])
    one = K.shap(t, n_trees=3, max_depth=3, n_bg=5)
    monkeypatch.setattr(K, "EXPLAINED_ROWS", 100)
    many = K.shap(t, n_trees=3, max_depth=3, n_bg=5)
    assert many.rdd.getNumPartitions() == 3
    a, b = (sorted((r["k0"], r["feature"], r["phi"]) for r in d.collect()) for d in (one, many))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])
