"""A table handle with its history, and replay of that history.

Every step stores its machine name and *fitted* parameters, so replay needs no
new fit and gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rows_frame

from ..operators.profile import fingerprint
from ..sources.writers import LEDGER_SCHEMA, dumps

OPERATIONS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def register_operation(name: str, fn: Callable[[DataFrame, dict], DataFrame]) -> None:
    """Make ``fn(df, params) -> df`` replayable under ``name``."""
    OPERATIONS[name] = fn


def operation(name: str):
    def add(fn):
        register_operation(name, fn)
        return fn
    return add


@dataclass(frozen=True)
class Asset:
    """Lazy table plus ledger rows; no profile is computed unless asked for."""
    df: DataFrame
    ledger: list[dict] = field(default_factory=list)
    asset_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def start(cls, df: DataFrame, name: str = "load_dataset", params: dict | None = None) -> "Asset":
        return cls(df, []).derive(name, df, params or {})

    def derive(self, name: str, df: DataFrame, params: dict) -> "Asset":
        """Append a step; counts and the content hash come from one scan."""
        got = fingerprint(df).first()
        parent = self.ledger[-1] if self.ledger else None
        step = {"step": len(self.ledger), "operation": name,
                "applied_utc": datetime.now(timezone.utc).replace(tzinfo=None),
                "rows": got["rows"], "cols": len(df.columns), "params": dumps({**params, "fp": got["fingerprint"]}),
                "parent_id": self.asset_id if parent else None,
                "parent_fp": json.loads(parent["params"])["fp"] if parent else None}
        return Asset(df, [*self.ledger, step])

    def apply(self, name: str, params: dict) -> "Asset":
        """Run a registered operation and record it."""
        return self.derive(name, OPERATIONS[name](self.df, params), params)

    def frame(self) -> DataFrame:
        return ledger_frame(self.df.sparkSession, self.ledger)


def ledger_frame(spark, ledger: Sequence[dict]) -> DataFrame:
    names = [p.split()[0] for p in LEDGER_SCHEMA.split(", ")]
    return rows_frame(spark, [tuple(s[n] for n in names) for s in ledger], LEDGER_SCHEMA)


def replay(source: DataFrame, ledger: Sequence[dict], on_error: str = "raise") -> DataFrame:
    """Apply the recorded steps to a source table.

    ``on_error="skip"`` passes over steps that are unknown or fail to plan."""
    df = source
    for step in ledger:
        name = step["operation"]
        if name == "load_dataset":
            continue
        try:
            if name not in OPERATIONS:
                raise KeyError(f"unknown operation: {name}")
            df = OPERATIONS[name](df, json.loads(step["params"]))
        except Exception:
            if on_error != "skip":
                raise
    return df


def steps_by_operation(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("operation").agg(F.count("*").alias("n_steps"))


def last_steps(ledger: DataFrame, n: int = 8) -> DataFrame:
    return ledger.orderBy(F.desc("step")).limit(n)


def derived_names(ledger: DataFrame) -> DataFrame:
    return (ledger.filter("operation = 'create_derived_column'")
            .select("step", F.get_json_object("params", "$.name").alias("name")))


def rows_removed(ledger: DataFrame) -> DataFrame:
    """Rows lost at each step, against the step before."""
    prev = ledger.select((F.col("step") + 1).alias("step"), F.col("rows").alias("before"))
    return ledger.join(prev, "step").select("step", "operation", (F.col("before") - F.col("rows")).alias("removed"))
