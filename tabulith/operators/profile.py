"""Table profiling and integrity: few wide aggregates, small long reports."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (rows_frame, agg_dict, fin, integer_columns, is_float, missing, numeric_columns,
                                 primitive_columns, q, string_columns, value)
from ..functions.quantiles import moments, quantiles

# fixed values: report thresholds and the suspicious-name pattern
HIGH_MISSING, HIGH_DUPLICATE, KEY_SHARE = 0.05, 0.01, 0.90
TOP_CATEGORIES, IQR_FACTOR, MIN_SHAPE_ROWS, MIN_FENCE_VALUES = 20, 1.5, 8, 4
DESCRIBE_PROBS = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
SUSPECT_NAME = (r"(target|label|y$|voltage|capacity|energy|formation|hull|stability|bandgap|"
                r"e[_ ]?above[_ ]?hull)")


def value_counts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """``column, v, cnt`` for several columns from one scan and one shuffle.

    Values are compared as text, missing as NULL; counts combine map-side, so a
    hot value costs one row per task."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), value(df, c).cast("string").alias("v")) for c in cols])
    return df.select(F.inline(items)).groupBy("column", "v").agg(F.count("*").alias("cnt"))


def _typed(df: DataFrame, name: str) -> Column:
    """The value in a slot of its own kind, so counting needs no text form."""
    t, v = df.schema[name].dataType, value(df, name)
    as_long = as_double = as_text = None
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        as_long = v.cast("long")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        as_long = F.unix_micros(v.cast("timestamp"))
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        as_double = v.cast("double")
    else:
        as_text = v.cast("string")
    slots = (("l", "long", as_long), ("d", "double", as_double), ("s", "string", as_text))
    return F.struct(F.lit(name).alias("column"), *[(F.lit(None) if e is None else e).cast(k).alias(n) for n, k, e in slots])


def distinct_counts(df: DataFrame, cols: Iterable[str] | None = None, approximate: bool = False) -> dict[str, int]:
    """Distinct non-missing values per column, exact unless asked otherwise."""
    cols = list(cols) if cols is not None else primitive_columns(df)
    if approximate:
        return agg_dict(df, {c: F.approx_count_distinct(value(df, c)) for c in cols})
    rows = df.select(F.inline(F.array(*[_typed(df, c) for c in cols]))).filter("l is not null or d is not null or s is not null")
    got = {r["column"]: r["n"] for r in rows.groupBy("column", "l", "d", "s").agg(F.lit(1).alias("one"))
           .groupBy("column").agg(F.count("*").alias("n")).collect()}
    return {c: got.get(c, 0) for c in cols}


def top_categories(df: DataFrame, cols: Iterable[str] | None = None, k: int = TOP_CATEGORIES) -> DataFrame:
    """The k most frequent values per text column, ties by value."""
    cols = list(cols) if cols is not None else string_columns(df)
    w = Window.partitionBy("column").orderBy(F.desc("cnt"), "v")
    return (value_counts(df, cols).filter("v is not null")
            .withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k))


def schema_profile(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """One row per column: type, counts, distinct values, numeric summary."""
    nums = numeric_columns(df)
    aggs: dict = {"rows": F.count("*")}
    for c in df.columns:
        aggs[(c, "missing")] = F.count_if(missing(df, c))
    for c in nums:
        v = value(df, c).cast("double")
        aggs.update({(c, "min"): F.min(v), (c, "max"): F.max(v), (c, "mean"): F.avg(v), (c, "std"): F.stddev_samp(v)})
    got = agg_dict(df, aggs)
    uniq = distinct_counts(df, approximate=approximate_distinct)
    types = dict(df.dtypes)
    rows = []
    for c in df.columns:
        miss = got[(c, "missing")]
        rows.append((c, types[c], got["rows"] - miss, miss, miss / max(got["rows"], 1), uniq.get(c),
                     *[fin(got.get((c, s))) for s in ("min", "max", "mean", "std")]))
    return rows_frame(df.sparkSession, rows, "column string, dtype string, non_null bigint, missing bigint, missing_fraction double, "
              "distinct bigint, min double, max double, mean double, std double")


def basic_statistics(df: DataFrame, max_columns: int | None = None, qs: dict | None = None) -> DataFrame:
    """Describe table of the numeric columns with seven quantiles."""
    cols = numeric_columns(df)[:max_columns]
    m, qs = moments(df, cols), qs or quantiles(df, cols, DESCRIBE_PROBS)
    out = [(c, m[c]["n"], *[fin(m[c][s]) for s in ("mean", "sd", "min")], *[fin(v) for v in qs[c]], fin(m[c]["max"]))
           for c in cols]
    names = ", ".join(f"q{round(p * 100):02d} double" for p in DESCRIBE_PROBS)
    return rows_frame(df.sparkSession, out, f"column string, n bigint, mean double, std double, min double, {names}, max double")


def table_shape(df: DataFrame) -> DataFrame:
    """Row, column and type counts as ``metric, value`` rows."""
    types = [t for _, t in df.dtypes]
    nums = len(numeric_columns(df))
    rows = [("rows", df.count()), ("columns", len(types)), ("numeric_columns", nums),
            ("non_numeric_columns", len(types) - nums)]
    rows += [(f"dtype:{t}", types.count(t)) for t in sorted(set(types))]
    return rows_frame(df.sparkSession, rows, "metric string, value bigint")


def shape_moments(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sample-corrected skewness and excess kurtosis where 8 values exist."""
    m = moments(df, cols or numeric_columns(df))
    rows = [(c, v["n"], fin(v["skew_sample"]), fin(v["kurt_sample"])) for c, v in m.items() if v["n"] >= MIN_SHAPE_ROWS]
    return rows_frame(df.sparkSession, rows, "column string, n bigint, skewness double, kurtosis double")


def tukey_fences(df: DataFrame, factor: float = IQR_FACTOR, cols: Sequence[str] | None = None,
                 max_columns: int | None = None, quartiles: dict | None = None) -> DataFrame:
    """Counts outside the quartile fences for columns that have any."""
    cols = list(cols or numeric_columns(df))[:max_columns]
    qs = quartiles or quantiles(df, cols, (0.25, 0.75))
    fences = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is not None and q3 > q1:
            fences[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    aggs = {}
    for c, (lo, hi) in fences.items():
        v = value(df, c)
        aggs.update({(c, "n"): F.count(v), (c, "low"): F.count_if(v < lo), (c, "high"): F.count_if(v > hi)})
    got = agg_dict(df, aggs) if aggs else {}
    rows = []
    for c, (lo, hi) in fences.items():
        n, low, high = got[(c, "n")], got[(c, "low")], got[(c, "high")]
        if n >= MIN_FENCE_VALUES and low + high:
            rows.append((c, low, high, low + high, (low + high) / n, lo, hi))
    return rows_frame(df.sparkSession, rows, "column string, low bigint, high bigint, total bigint, fraction double, fence_lo double, fence_hi double")


def mixed_types(df: DataFrame) -> DataFrame:
    """Text columns holding both numeric and other values."""
    cols = string_columns(df)
    got = agg_dict(df, {(c, s): e for c in cols for s, e in (
        ("num", F.count(F.trim(q(c)).try_cast("double"))), ("all", F.count(q(c))))}) if cols else {}
    rows = [(c, got[(c, "num")], got[(c, "all")] - got[(c, "num")]) for c in cols]
    return rows_frame(df.sparkSession, [r for r in rows if r[1] and r[2]],
                                           "column string, n_numeric bigint, n_text bigint")


def missingness(df: DataFrame) -> DataFrame:
    """Cells, share and rows with a missing value, and counts per column."""
    any_miss = F.lit(False)
    for c in df.columns:
        any_miss = any_miss | missing(df, c)
    got = agg_dict(df, {"n": F.count("*"), "rows": F.count_if(any_miss),
                        **{("c", c): F.count_if(missing(df, c)) for c in df.columns}})
    cells = sum(got[("c", c)] for c in df.columns)
    rows = [("missing_cells", None, float(cells)), ("rows_with_missing", None, float(got["rows"])),
            ("missing_fraction", None, cells / (max(got["n"], 1) * max(len(df.columns), 1)))]
    per = sorted(((c, got[("c", c)]) for c in df.columns if got[("c", c)]), key=lambda t: (-t[1], t[0]))
    rows += [("missing", c, float(k)) for c, k in per]
    return rows_frame(df.sparkSession, rows, "metric string, column string, value double")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows (missing equals missing)."""
    keys = [value(df, c).alias(f"k{i}") for i, c in enumerate(primitive_columns(df))]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).count()
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")) \
        .withColumn("duplicate_fraction", F.col("duplicate_rows") / F.greatest("rows", F.lit(1)))


def duplicate_names(names: Sequence[str]) -> list[str]:
    return sorted({n for n in names if list(names).count(n) > 1})


def structure(df: DataFrame, key_share: float = KEY_SHARE, max_keys: int | None = None) -> DataFrame:
    """All-null, constant, high-cardinality and candidate-key columns in one table."""
    got = agg_dict(df, {"rows": F.count("*"), **{c: F.count_if(missing(df, c)) for c in primitive_columns(df)}})
    uniq = distinct_counts(df)
    rows_n, texts, ints = got["rows"], set(string_columns(df)), set(integer_columns(df))
    out, keys = [], 0
    for c in primitive_columns(df):
        non_null = rows_n - got[c]
        with_null = uniq[c] + (1 if got[c] else 0)
        key = (c in texts or c in ints) and non_null > 0 and uniq[c] / non_null >= key_share
        keys += key
        looked_at = key and (max_keys is None or keys <= max_keys)
        out.append((c, non_null, uniq[c], non_null == 0, with_null <= 1,
                    c in texts and uniq[c] > key_share * rows_n, bool(key),
                    non_null - uniq[c] if looked_at else None, (non_null - uniq[c]) / non_null if looked_at else None))
    return rows_frame(df.sparkSession, out, "column string, non_null bigint, distinct bigint, all_null boolean, constant boolean, "
             "high_cardinality boolean, candidate_key boolean, collisions bigint, collision_rate double")


def special_values(df: DataFrame) -> DataFrame:
    """Infinite numbers and blank strings per column."""
    inf = float("inf")
    aggs = {("infinite", c): F.count_if(F.abs(value(df, c)) == inf) for c in numeric_columns(df) if is_float(df, c)}
    aggs.update({("blank", c): F.count_if(F.trim(q(c)) == "") for c in string_columns(df)})
    got = agg_dict(df, aggs) if aggs else {}
    return rows_frame(df.sparkSession, [(c, k, n) for (k, c), n in got.items()],
                                           "column string, kind string, n bigint")


def leakage_suspects(df: DataFrame, pattern: str = SUSPECT_NAME) -> DataFrame:
    found = sorted(c for c in df.columns if re.search(pattern, c, re.I))
    return rows_frame(df.sparkSession, [(c,) for c in found], "column string")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: one scan, no sort, same on any partitioning."""
    cols = primitive_columns(df)
    h = F.xxhash64(*[value(df, c) for c in cols])
    got = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    text = F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"),
                       F.lit(",".join(df.columns)))
    return got.select(F.col("n").alias("rows"), F.sha2(text, 256).alias("fingerprint"))


def fingerprint_text(df: DataFrame) -> str:
    return fingerprint(df).first()["fingerprint"]


def file_hashes(spark, path: str) -> DataFrame:
    """SHA-256 and size per file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def report_messages(df: DataFrame, parts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Warnings and notes the thresholds raise."""
    p = parts or report_parts(df)
    miss = {r["metric"]: r["value"] for r in p["missingness"].filter("column is null").collect()}
    dup = p["duplicates"].first()
    st = p["structure"].collect()
    blanks = [r for r in p["special_values"].collect() if r["kind"] == "blank" and r["n"]]
    mixed = [r["column"] for r in p["mixed_types"].collect()]
    fences, suspects = p["tukey_fences"].count(), p["leakage_suspects"].count()
    out = []
    if miss["missing_fraction"] > HIGH_MISSING:
        out.append(("warning", "high_missingness", f"{miss['missing_fraction']:.2%} of cells are missing"))
    if dup["duplicate_fraction"] > HIGH_DUPLICATE:
        out.append(("warning", "duplicate_rows", f"{dup['duplicate_fraction']:.2%} of rows repeat an earlier row"))
    if duplicate_names(df.columns):
        out.append(("warning", "duplicate_columns", "column names repeat"))
    nulls = [r["column"] for r in st if r["all_null"]]
    if nulls:
        out.append(("warning", "all_null", "no values in " + ", ".join(nulls)))
    if blanks:
        out.append(("warning", "blank_strings", f"blank text in {len(blanks)} column(s)"))
    if mixed:
        out.append(("warning", "mixed_types", "numbers and text in " + ", ".join(mixed)))
    if any(r["constant"] for r in st):
        out.append(("note", "constant", "constant columns present"))
    if any(r["candidate_key"] for r in st):
        out.append(("note", "candidate_keys", "near-unique columns present"))
    if fences:
        out.append(("note", "fence_outliers", f"values outside the fences in {fences} column(s)"))
    if suspects:
        out.append(("note", "leakage_suspects", f"{suspects} suspicious column name(s)"))
    return rows_frame(df.sparkSession, out, "level string, rule string, message string")


def report_parts(df: DataFrame) -> dict[str, DataFrame]:
    return {"schema": schema_profile(df), "missingness": missingness(df), "duplicates": duplicates(df),
            "structure": structure(df), "tukey_fences": tukey_fences(df), "mixed_types": mixed_types(df),
            "special_values": special_values(df), "leakage_suspects": leakage_suspects(df)}


def integrity_report(df: DataFrame) -> DataFrame:
    """All parts as long ``section, column, metric, value`` rows."""
    parts = report_parts(df)
    parts["messages"] = report_messages(df, parts)
    out = None
    for section, part in parts.items():
        label = q("column") if "column" in part.columns else F.lit(None).cast("string")
        metrics = [c for c in part.columns if c != "column"]
        items = F.array(*([F.struct(F.lit(c).alias("metric"), q(c).cast("string").alias("value")) for c in metrics]
                          or [F.struct(F.lit("listed").alias("metric"), F.lit("true").alias("value"))]))
        rows = part.select(F.lit(section).alias("section"), label.alias("column"), F.inline(items))
        out = rows if out is None else out.unionByName(rows)
    return out


def profile_and_fences(df: DataFrame) -> DataFrame:
    """Profile, describe and fence counts joined on the column name; quantiles are found once."""
    qs = quantiles(df, numeric_columns(df), DESCRIBE_PROBS)
    lo, hi = DESCRIBE_PROBS.index(0.25), DESCRIBE_PROBS.index(0.75)
    quartiles = {c: (v[lo], v[hi]) for c, v in qs.items()}
    return (schema_profile(df).join(basic_statistics(df, qs=qs).drop("n", "mean", "std", "min", "max"), "column", "left")
            .join(tukey_fences(df, quartiles=quartiles).select("column", "low", "high", "fence_lo", "fence_hi"), "column", "left"))


def outlier_summary(df: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, deviation and missing count per numeric column."""
    cols = numeric_columns(df)
    m = moments(df, cols)
    total = df.count()
    rows = [(c, *[fin(m[c][s]) for s in ("min", "max", "mean", "sd")], total - m[c]["n"]) for c in cols]
    return rows_frame(df.sparkSession, rows, "column string, min double, max double, mean double, std double, na bigint")


