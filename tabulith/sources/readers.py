"""Reading tables: one entry point dispatching on the file extension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import rows_frame, agg_dict, nan_to_null, q
from . import hygiene

# fixed values: text tokens read as missing, and the separators tried
NA_TOKENS = ("", "NA", "N/A", "nan", "NaN", "null", "None", "-")
SEPARATORS = (",", ";", "\t", "|")
FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet",
           ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}


@dataclass
class ReadOptions:
    sep: str | None = None
    encoding: str = "UTF-8"
    header: bool = True
    na_tokens: Sequence[str] = NA_TOKENS
    numeric_share: float = hygiene.COERCE_SHARE
    date_share: float = hygiene.COERCE_SHARE
    coerce: bool = True
    max_bytes: int | None = None
    schema: T.StructType | None = None
    extra: Mapping[str, str] = field(default_factory=dict)


def sniff_separator(spark: SparkSession, path: str, candidates: Sequence[str] = SEPARATORS) -> str:
    """The candidate occurring most often in the header line (earlier wins ties)."""
    line = spark.read.text(path).limit(1).first()
    text = line[0] if line else ""
    return max(candidates, key=lambda s: (text.count(s), -candidates.index(s)))


def format_of(path: str) -> str:
    name = path.rstrip("/").lower()
    for ext, fmt in FORMATS.items():
        if name.endswith(ext):
            return fmt
    raise ValueError(f"unsupported file type: {path}")


def path_bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def read_raw(spark: SparkSession, path: str, fmt: str | None = None, options: ReadOptions | None = None) -> DataFrame:
    """The table as stored, no hygiene."""
    o = options or ReadOptions()
    fmt = fmt or format_of(path)
    if o.max_bytes is not None and path_bytes(spark, path) > o.max_bytes:
        raise ValueError(f"input larger than {o.max_bytes} bytes: {path}")
    reader = spark.read.options(**dict(o.extra))
    if o.schema is not None:
        reader = reader.schema(o.schema)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "csv":
        sep = o.sep or sniff_separator(spark, path)
        return reader.csv(path, sep=sep, header=o.header, encoding=o.encoding)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "json":
        # an array or one object spanning lines; otherwise one object per line
        first = spark.read.text(path).filter("trim(value) <> ''").limit(1).first()
        lines = bool(first) and first[0].strip().startswith("{") and first[0].strip().endswith("}")
        return reader.json(path) if lines else reader.option("multiLine", True).json(path)
    raise ValueError(f"unknown format: {fmt}")


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               options: ReadOptions | None = None) -> DataFrame:
    """Read and tidy: names, blanks, NA tokens, numeric and date text, NaN to NULL.

    Typed sources (parquet) pay no coercion pass and keep plain columns, so that
    filters still reach the scan; operators read NaN as missing themselves."""
    o = options or ReadOptions()
    fmt = fmt or format_of(path)
    df = read_raw(spark, path, fmt, o)
    df, _ = hygiene.clean_names(df)
    df = hygiene.with_unique_names(df)
    if fmt != "parquet":
        df = hygiene.tokens_to_null(hygiene.strip_strings(df), o.na_tokens) if o.schema is None else df
        if o.coerce and o.schema is None:
            df = hygiene.coerce_numeric(df, o.numeric_share)
            df = hygiene.coerce_dates(df, o.date_share)
        df = nan_to_null(df)
    return df


@dataclass
class Assembly:
    """How two sources make one canonical table."""
    key: str
    rename: Mapping[str, str]
    drop: Sequence[str]
    take: Sequence[str]
    order: Sequence[str]
    compare: Mapping[str, float] = field(default_factory=dict)


def assemble(raw: DataFrame, cleaned: DataFrame, plan: Assembly) -> tuple[DataFrame, DataFrame]:
    """Rename, drop and inner-join two sources; returns (table, load report).

    ``compare`` maps a column held by both to a tolerance; rows differing by
    more count as corrupted in the cleaned source and keep the raw value."""
    left = raw.drop(*plan.drop).withColumnsRenamed(dict(plan.rename))
    checks = list(plan.compare)
    right = cleaned.select(q(plan.key), *[q(c) for c in plan.take],
                           *[q(c).alias(f"__chk_{c}") for c in checks])
    joined = left.join(right, plan.key, "inner")
    bad = {c: F.abs(q(c) - q(f"__chk_{c}")) > tol for c, tol in plan.compare.items()}
    stats = agg_dict(joined, {"rows": F.count("*"), **{("bad", c): F.count_if(e) for c, e in bad.items()}})
    lost = left.join(right, plan.key, "left_anti").select(plan.key)
    spark = raw.sparkSession
    report = [("rows_joined", None, stats["rows"]), ("keys_only_in_raw", None, lost.count())]
    report += [("corrupted", c, stats[("bad", c)]) for c in checks]
    table = joined.select(*[q(c) for c in plan.order if c in joined.columns])
    return table, rows_frame(spark, report, "metric string, column string, value bigint")
