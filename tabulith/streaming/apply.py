"""Fitted steps on a stream.

Steps whose parameters are already fitted are projections or filters, so they
accept a streaming DataFrame unchanged: contract splits, scaling, transforms,
clamps and column outlier rules.  Steps that must order or rank rows refuse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import contracts as C
from ..operators import outliers
from ..operators import steps  # noqa: F401 - registers the steps
from ..plans.ledger import OPERATIONS
from ..session import scratch_path

STATELESS = {"normalize_scale", "transform_columns", "conditioning", "remove_outliers", "create_derived_column",
             "manage_columns", "filter_rows", "handle_missing_values", "moment_fence"}
_ORDERED = {"ffill", "bfill", "linear", "pchip", "akima", "spline", "rank", "pct_rank", "ema"}


def apply_steps(stream: DataFrame, steps_: Sequence[tuple[str, dict]]) -> DataFrame:
    """Apply fitted ``(operation, params)`` steps in order."""
    for name, params in steps_:
        if name not in STATELESS or params.get("method") in _ORDERED or params.get("transform_type") in _ORDERED:
            raise ValueError(f"{name} is not a stateless step")
        stream = OPERATIONS[name](stream, params)
    return stream


def tag_violations(stream: DataFrame, contracts: Sequence[C.Contract]) -> DataFrame:
    return stream.withColumn("violations", C.row_violations(stream, contracts))


def flag_outliers(stream: DataFrame, params: dict) -> DataFrame:
    return outliers.flag(stream, params)


def write(stream: DataFrame, path: str, checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Append to parquet; ``once`` takes what is there and stops."""
    w = stream.writeStream.format("parquet").option("path", path).outputMode("append") \
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "stream-ckpt"))
    return (w.trigger(availableNow=True) if once else w).start()
