"""Column kinds, the missing rule and small aggregate helpers.

Missing means NULL, or NaN for a float column; ``nan_to_null`` folds the two
into NULL so that Spark aggregates skip both."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Expressions per aggregate; keeps generated code below the JVM method limit.
AGG_CHUNK = 240


def q(name: str) -> Column:
    """Column by exact name (names may hold dots, blanks, hyphens)."""
    return F.col("`" + name.replace("`", "``") + "`")


def _of(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _of(df, (T.NumericType,))


def integer_columns(df: DataFrame) -> list[str]:
    return _of(df, (T.IntegralType,))


def string_columns(df: DataFrame) -> list[str]:
    return _of(df, (T.StringType,))


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def primitive_columns(df: DataFrame) -> list[str]:
    """Columns operators may group on; nested values pass through untouched."""
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def missing(df: DataFrame, name: str) -> Column:
    c = q(name)
    return c.isNull() | F.isnan(c) if is_float(df, name) else c.isNull()


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL."""
    c = q(name)
    return F.when(~F.isnan(c), c) if is_float(df, name) else c


def nan_to_null(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    floats = [c for c in (names or df.columns) if is_float(df, c)]
    return df.withColumns({c: value(df, c) for c in floats}) if floats else df


def drop_missing(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Rows complete in the named columns (all when none are named)."""
    return nan_to_null(df).na.drop(subset=list(names) if names is not None else None)


def agg_dict(df: DataFrame, exprs: Mapping[object, Column]) -> dict:
    """One row of named aggregates as a dict keyed like ``exprs``.

    Wide sets are split into several scans of bounded width."""
    items = list(exprs.items())
    out: dict = {}
    for at in range(0, len(items), AGG_CHUNK):
        part = items[at:at + AGG_CHUNK]
        row = df.agg(*[e.alias(f"v{i}") for i, (_, e) in enumerate(part)]).first()
        out.update({key: row[i] for i, (key, _) in enumerate(part)})
    return out


def safe_div(num: Column, den: Column) -> Column:
    """Division giving NULL on a zero denominator (ANSI mode raises)."""
    return F.try_divide(num, den)


def rows_frame(spark, rows: Sequence, schema: str) -> DataFrame:
    """A small result (per-column summary) as a local relation: no tasks to read it."""
    fields = T.StructType.fromDDL(schema)
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in fields])
    rows = list(rows)
    cols = [[r[i] for r in rows] for i in range(len(arrow))]
    data = pa.table([pa.array([_plain(v) for v in c], type=t.type) for c, t in zip(cols, arrow)], schema=arrow)
    return spark.createDataFrame(data, fields)


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
            "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}[t.simpleString()]


def fin(x):
    """Python float with NaN read as None, for summary rows."""
    if x is None:
        return None
    x = float(x)
    return None if x != x else x
