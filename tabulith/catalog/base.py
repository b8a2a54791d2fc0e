"""Registry of the queries the repository answers, each with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import q
from ..sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rd(c: Column | str, digits: int = 6) -> Column:
    """Rounded value with a single zero, to compare across engines."""
    r = F.round(q(c) if isinstance(c, str) else c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def R(expr: str, digits: int = 6) -> str:  # noqa: N802 - mirrors ``rd`` in SQL text
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0::DOUBLE ELSE round({expr}, {digits}) END"


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """``rd`` of each column; a projection of its own rounds each value once."""
    df = df.withColumns({c: F.round(q(c), digits) for c in cols})
    return df.withColumns({c: F.when(q(c) == 0, F.lit(0.0)).otherwise(q(c)) for c in cols})


def union_sql(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)
