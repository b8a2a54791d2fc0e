"""Sinks: the table with its ledger, reports, records and reviewed rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rows_frame, is_float, q

LEDGER_SCHEMA = ("step int, operation string, applied_utc timestamp, rows bigint, cols int, "
                 "params string, parent_id string, parent_fp string")


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, as JSON has no such numbers."""
    inf = float("inf")
    return df.withColumns({c: F.when(~F.isnan(q(c)) & (F.abs(q(c)) != inf), q(c))
                           for c in df.columns if is_float(df, c)})


def dumps(obj) -> str:
    """The same rule for small driver-side values; what JSON lacks becomes text, sets become lists."""
    text = json.dumps(obj, default=lambda v: list(v) if isinstance(v, (set, frozenset)) else str(v))
    return json.dumps(json.loads(text, parse_constant=lambda _: None), sort_keys=True)


def write_report(df: DataFrame, path: str) -> None:
    finite_or_null(df).write.mode("overwrite").json(path)


def save_bundle(df: DataFrame, ledger: list[dict], path: str) -> None:
    """Table as parquet beside its ledger rows."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    rows_frame(df.sparkSession, [tuple(s[k] for k in ("step", "operation", "applied_utc", "rows", "cols", "params", "parent_id", "parent_fp"))
         for s in ledger], LEDGER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger")


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict]]:
    """Re-open a bundle; an older one without a ledger gives an empty history."""
    table = spark.read.parquet(f"{path}/table")
    try:
        rows = spark.read.parquet(f"{path}/ledger").orderBy("step").collect()
    except Exception as err:  # noqa: BLE001 - only a missing path means "older bundle"
        if "PATH_NOT_FOUND" not in str(err):
            raise
        rows = []
    return table, [r.asDict() for r in rows]


def split_flagged(df: DataFrame, flag: str = "is_outlier") -> tuple[DataFrame, DataFrame]:
    """(kept, flagged) rows, without the flag column."""
    f = F.coalesce(q(flag), F.lit(False))
    return df.filter(~f).drop(flag), df.filter(f).drop(flag)


def write_split(df: DataFrame, path: str, flag: str = "is_outlier") -> None:
    kept, flagged = split_flagged(df, flag)
    kept.write.mode("overwrite").parquet(f"{path}/kept")
    flagged.write.mode("overwrite").parquet(f"{path}/flagged")


def append_record(scores: DataFrame, path: str, *, variant_id: int, fingerprint: str, contracts=None,
                  config=None, model_hash: str | None = None, label: str | None = None) -> DataFrame:
    """Append a citable record: the scores with everything needed to redo them."""
    rec = (scores.withColumns({
        "variant_id": F.lit(variant_id), "fingerprint": F.lit(fingerprint),
        "contract_context": F.lit(dumps(contracts or [])), "method_config": F.lit(dumps(config or {})),
        "model_state_hash": F.lit(model_hash).cast("string"), "stability_label": F.lit(label).cast("string"),
        "recorded_utc": F.current_timestamp()}))
    rec.write.mode("append").parquet(path)
    return rec


def write_sidecar(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The numbers behind a figure as text."""
    out = finite_or_null(df).coalesce(1)
    (out.write.mode("overwrite").csv(path, header=True) if fmt == "csv"
     else out.write.mode("overwrite").json(path))
