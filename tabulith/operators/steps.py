"""Remaining replayable steps; importing this module registers all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ledger import operation
from . import conditioning, impute, normalize, outliers, tidy, transform  # noqa: F401 - register on import


@operation("manage_columns")
def manage_columns(df: DataFrame, params: dict) -> DataFrame:
    keep = [c for c in params["columns_final"] if c in df.columns]
    return tidy.manage_columns(df, keep, params.get("rename_map"))


@operation("create_derived_column")
def create_derived_column(df: DataFrame, params: dict) -> DataFrame:
    return tidy.derive(df, params["name"], params["expression"])


@operation("filter_rows")
def filter_rows(df: DataFrame, params: dict) -> DataFrame:
    return df.filter(F.expr(params["where"]))


@operation("moment_fence")
def moment_fence(df: DataFrame, params: dict) -> DataFrame:
    """Keeps rows inside the fitted bounds; missing rows stay."""
    v = F.col(f"`{params['column']}`")
    return df.filter(v.isNull() | v.between(params["lo"], params["hi"]))
