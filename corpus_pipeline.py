"""Corpus preparation: quality rules, near-duplicates, benchmark passages, secrets and packing, one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import decontaminate, near_dedup, packing, quality_rules, secret_scan
from marketlake.llm.encode import default_path
from marketlake.llm.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a certified rule go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.deduplicate(docs, shingle=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows."""
    masked = secret_scan.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of 1024 tokens, with their token ids."""
    return packing.pack(docs, default_path("byte_bpe_50k.json"), split="spaces")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: Stages such as tokenising cannot be said in SQL; the tests hold the result of a small corpus against what is known of it, and each
#: operator against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of what the stages leave of ``documents``.

    Null texts and texts without words fail the quality rules and go; of equal rows one stays. Rows without an id are judged like
    others, but are no one's duplicates. More columns, whatever their names, are carried to the packing stage, which ends
    them. Empty tables give an empty result, or no labels and no benchmark. Each stage's result is a table of its own, so a
    lost executor costs work of one stage only.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
