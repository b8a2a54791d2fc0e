"""The training-data pipeline: documents in, packed batches out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import decontaminate, language, near_duplicates, packing, secret_scan
from tabulith.llm.common import stored
from tabulith.llm.queries import vocabulary
from tabulith.session import scratch_path


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language is found; those without a letter go."""
    return language.known(docs, language.fit(docs.where(~language.held_out())))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near-duplicates."""
    return near_duplicates.drop(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind of secret, and n_chars, if there, counted anew."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    counted = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return clean.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in batches of length buckets."""
    return packing.pack(stored(packing.token_lengths(docs, vocabulary()), "lengths"))


STAGES = [
    ("language", with_language),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL cannot express the fitted and sampled stages; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, df, sf_dir).write.parquet(path)
        df = spark.read.parquet(path)
    return STAGES[-1][1](spark, df, sf_dir)
