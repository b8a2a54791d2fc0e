"""Column management and row selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rows_frame, agg_dict, drop_missing, missing, numeric_columns, q


def manage_columns(df: DataFrame, keep: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Keep, reorder and rename; resulting names must be unique and non-empty."""
    rename = rename or {}
    names = [rename.get(c, c) for c in keep]
    if any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise ValueError("column names must be non-empty and unique")
    return df.select(*[q(c).alias(n) for c, n in zip(keep, names)])


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[q(c) for c in numeric_columns(df)])


def any_missing(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, [missing(df, c) for c in (cols or df.columns)])


def rows_with_missing(df: DataFrame, limit: int | None = None) -> DataFrame:
    out = df.filter(any_missing(df))
    return out.limit(limit) if limit is not None else out


def columns_with_missing(df: DataFrame) -> DataFrame:
    """``column, n_missing`` for columns with any, most first; one aggregate."""
    got = agg_dict(df, {c: F.count_if(missing(df, c)) for c in df.columns})
    rows = sorted(((c, n) for c, n in got.items() if n), key=lambda t: (-t[1], t[0]))
    return rows_frame(df.sparkSession, rows, "column string, n_missing bigint")


def drop_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return drop_missing(df, subset)


def derive(df: DataFrame, name: str, expression: str | Column) -> DataFrame:
    """A new column from a SQL expression or Column; existing names are refused."""
    if name in df.columns:
        raise ValueError(f"column exists: {name}")
    if isinstance(expression, str) and not expression.strip():
        raise ValueError("empty expression")
    return df.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)


def restore(kept: DataFrame, original: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Put the rows named by ``keys`` back (rows already kept stay single)."""
    back = original.join(keys.select(key).distinct(), key, "left_semi")
    return kept.unionByName(back.join(kept.select(key), key, "left_anti"))


def nearest_to_median(df: DataFrame, column: str, n: int, median: float, key: str) -> DataFrame:
    """The n rows closest to a fitted median (ties by key)."""
    return df.orderBy(F.abs(q(column) - F.lit(median)), q(key)).limit(n)


def keys_only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti").orderBy(key)
