"""Registered queries of this package and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontaminate, hard_negatives, html_text, language, line_rules, near_duplicates, ngram_join, packing, prefix_counts, quality, secret_scan, spelling, token_files
from .common import documents, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The tokenizer file; a folder in TOKENIZER_DIR is looked at first."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode documents, write shards and index, then read every document back through the index."""
    docs = documents(spark, sf_dir)
    path = scratch_path(spark, "tokens")
    token_files.write(docs, path, vocabulary())
    return token_files.Reader(spark, path).fetch(docs, with_ids=False)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches over all documents."""
    lengths = stored(packing.token_lengths(documents(spark, sf_dir), vocabulary()), "lengths")
    return packing.pack(lengths)


@query
def op10_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the prefix table of every document, then answer the budget of 512 tokens from the tables."""
    tables = stored(prefix_counts.prefix_tables(documents(spark, sf_dir), vocabulary()), "prefixes")
    return prefix_counts.budgets(tables, 512)


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with weights from pages that mark their content up."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.main_text(pages, html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where("doc_id IS NOT NULL").where(~language.held_out()))
    return language.predict(docs, model).withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", F.col("score"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through the trigram index."""
    return secret_scan.summary(secret_scan.scan(documents(spark, sf_dir)))


ORACLES["op6_secret_scan"] = secret_scan.ORACLE


@query
def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and line-first cleaning of every document."""
    return line_rules.clean(documents(spark, sf_dir)).drop("clean_text")


ORACLES["op9_line_rules"] = line_rules.ORACLE


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document by weighted Jaccard similarity of TF-IDF shingles."""
    return near_duplicates.classes(documents(spark, sf_dir)).drop("node")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, a row for each document and item."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a scorer that weak labels trained."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, against all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives.mine(rows, F.col("id") % 50 == 0, label=hard_negatives.shifted_label())


ORACLES["op11_hard_negatives"] = hard_negatives.ORACLE


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.group(spelling.word_counts(documents(spark, sf_dir)))


@query
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of shingle similarity."""
    return ngram_join.classes(documents(spark, sf_dir))


ORACLES["op13_ngram_join"] = ngram_join.ORACLE
