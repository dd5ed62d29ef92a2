"""Corpus cleaning pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage reads what the one before it kept, as a table with the columns of ``documents``, and
returns such a table; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import written
from gridloom.llm.decontaminate import decontaminate
from gridloom.llm.language_id import keep_languages
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.packing import best_fit_packing
from gridloom.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go; a missing lang is filled in."""
    return keep_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; documents that had nothing else go."""
    out = dedup_lines(docs)
    kept = out.filter((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in the sequences."""
    return best_fit_packing(docs, added=True).drop("ids")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fingerprints, code lengths and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
