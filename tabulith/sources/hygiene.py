"""Header and cell hygiene applied after a read."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import agg_dict, q, string_columns

#: Share of all rows that must parse before a text column changes type.
COERCE_SHARE = 0.80


def clean_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Collapse blanks in column names; returns the mapping of changed names."""
    new = [re.sub(r"\s+", " ", c).strip() for c in df.columns]
    return df.toDF(*new), {a: b for a, b in zip(df.columns, new) if a != b}


def dedupe_names(names: Sequence[str]) -> list[str]:
    """``x, x, x`` becomes ``x, x_1, x_2`` (never hitting a name in use)."""
    taken, seen, out = set(names), {}, []
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        while True:
            seen[n] += 1
            cand = f"{n}_{seen[n]}"
            if cand not in taken:
                break
        taken.add(cand)
        out.append(cand)
    return out


def with_unique_names(df: DataFrame) -> DataFrame:
    return df.toDF(*dedupe_names(df.columns))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_strings(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return df.withColumns({c: strip(q(c)) for c in (cols or string_columns(df))})


def tokens_to_null(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    cols = string_columns(df)
    return df.withColumns({c: F.when(~strip(q(c)).isin(list(tokens)), q(c)) for c in cols}) if cols else df


def parse_rates(df: DataFrame, parsed: Mapping[str, Column]) -> dict[str, float]:
    """Share of all rows each expression parses, from one aggregate."""
    got = agg_dict(df, {"__rows": F.count("*"), **{c: F.count(e) for c, e in parsed.items()}})
    rows = max(got.pop("__rows"), 1)
    return {c: n / rows for c, n in got.items()}


def _coerce(df: DataFrame, cols, threshold: float, parse) -> DataFrame:
    cols = list(cols) if cols is not None else string_columns(df)
    parsed = {c: parse(strip(q(c))) for c in cols}
    rates = parse_rates(df, parsed) if cols else {}
    chosen = {c: parsed[c] for c in cols if rates[c] >= threshold}
    return df.withColumns(chosen) if chosen else df


def coerce_numeric(df: DataFrame, threshold: float = COERCE_SHARE, cols=None) -> DataFrame:
    return _coerce(df, cols, threshold, lambda c: c.try_cast("double"))


def coerce_dates(df: DataFrame, threshold: float = COERCE_SHARE, cols=None) -> DataFrame:
    return _coerce(df, cols, threshold, lambda c: F.try_to_timestamp(c))
