"""A corpus from quality filter to packed sequences, as stages that each read what the one before wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import catalog, decontamination, exact, packing, quality, simhash
from ledgerloom.llm.shared import checksum_class, table
from ledgerloom.plans.workspace import run_folder


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = table(spark, sf_dir, "labels").where(checksum_class("doc_id", 4) != 2)
    machine = quality.fit(docs, labels)
    scored = quality.with_score(docs, machine, "__score")
    return scored.where(F.col("__score") >= quality.ACCEPTED).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.deduplicate(docs)


def distinct_prints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near fingerprints."""
    return simhash.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their tokens."""
    return packing.pack(docs, catalog.vocabulary_path(), with_ids=True)


STAGES = [
    ("quality classifier", accepted),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", distinct_prints),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]

# Models, fingerprints and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage is written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
