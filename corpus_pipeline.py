"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet below the shared folder and reads
them again for the next, so that a stage can be resumed from what the one before it wrote.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, packing, quality, secrets, simhash
from threadloom.llm.common import fresh, shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    (score,) = fresh(docs, "score")
    scored = quality.fit_and_score(docs, table(spark, sf_dir, "labels"), docs.columns, score)
    return scored.where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar to 0.8 or more: the one with the smallest doc_id.

    Rows without a doc_id that share no group with one that has it stay; repeated rows are one row.
    """
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    (matches,) = fresh(docs, "matches")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), name=matches)
    return marked.where(F.size(matches) == 0).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; n_chars follows the text."""
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


# A trained classifier, fingerprints and a tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
