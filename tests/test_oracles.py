"""Registered queries beside their SQL at the smallest scale.

A spread of queries runs by default; TABULITH_ALL=1 runs every one.  The full
comparison at any scale is ``python tests/oracle_check.py --sf 0.01``."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]
CHOSEN = NAMES if os.environ.get("TABULITH_ALL") else NAMES[::6]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, con, name):
    err = compare(spark, con, name, SF)
    # a small table may leave nothing to compare
    assert err in (None, "both empty"), err


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 11
