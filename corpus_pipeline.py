"""A pipeline over documents: quality, near copies, repeated passages, benchmark, tokens.

Each stage works on all that its predecessor kept and is written as Parquet in
the shared folder. All stages but the last return the columns of documents.
Rows with a null id are scored, cleaned and encoded, but are never copies of
others. Different texts under one id are judged one by one. Empty tables pass through every stage; without labels nothing is
rejected, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, decontam, neardup, quality, repeats
from foldwise.llm.common import broadcast_if_small, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold learned from ``labels``."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("__score") >= 0.5).drop("__score")


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    # Of rows that share an id all or none are kept.
    copies = stored(neardup.grouped(docs).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return _columns_of(docs, docs.join(broadcast_if_small(copies, copies.count()), "doc_id", "left_anti"))


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one holds; n_chars follows the text."""
    out = repeats.without_repeats(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return _columns_of(docs, out)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    found = decontam.judged(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = stored(found.select("doc_id", "h").distinct(), "dropped").alias("f")
    # By id and text, so that a clean text under the same id, or none, is no other's.
    same = docs["doc_id"].eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(docs["text"]) == F.col("f.h"))
    return _columns_of(docs, docs.join(broadcast_if_small(found, found.count()), same, "left_anti"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens and tokens (little-endian unsigned 32-bit ids)."""
    out = bpe.encoded(docs)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns],
                      bpe.n_tokens(F.col("__tokens")).alias("n_tokens"),
                      F.col("__tokens").alias("tokens"))


def _columns_of(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


STAGES: list[tuple[str, Stage]] = [
    ("quality", good), ("near_copies", first_copies), ("passages", first_passages),
    ("benchmark", clean), ("tokens", tokenized)]

# Scores, sketches and merges can't be said in SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
