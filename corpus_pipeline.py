"""The corpus pipeline: quality, fuzzy lines, near-duplicates, decontamination, packing; each stage writes Parquet for the next."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from certalog.llm import decontaminate, lines, packing, quality, simhash
from certalog.llm.common import remove, scratch, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled documents among docs.

    Null texts are scored as empty ones, repeated rows alike; a null doc_id has no label.
    """
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines one stays; n_chars follows the text. A document may be left without text.

    Null texts stay null, with n_chars null; equal rows lose the same lines.
    """
    out = lines.dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity of 0.8 or more) stays: that with the smallest doc_id.

    Null and blank texts are copies of each other; of equal rows one stays; texts that repeat a doc_id are judged each by itself.
    """
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none, repeated rows go or stay together."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence; a text without words (null, blank) keeps one row, of no sequence."""
    return packing.pack(packing.token_counts(docs))


STAGES = [
    ("quality", quality_filter),
    ("lines", line_dedup),
    ("near_duplicates", near_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: Training, MinHash, fingerprints and edit distances are beyond SQL: tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder and read again as the next one's docs.

    What a stage wrote for itself goes with the stage, and its documents go once the next one has written its own.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
