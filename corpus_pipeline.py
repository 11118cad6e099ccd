"""The corpus pipeline: stages that each read all documents the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.llm.mixing import label_domains, without_domain
from assay.llm.packing import pack_documents
from assay.llm.quality import without_rejected
from assay.llm.simhash import without_near_copies
from assay.llm.suffix_dedup import without_repeats
from assay.session import scratch_path

# Bytes of a repeated passage; fifty words have more.
PASSAGE_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the outlier test rejects go."""
    return without_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that documents share are cut from all texts."""
    return without_repeats(docs, PASSAGE_BYTES)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are mixed so that no tokens of toxic ones remain and those of all others do."""
    return without_domain(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules), ("near dedup", near_dedup), ("suffix dedup", suffix_dedup), ("mixing", mixing), ("packing", packing),
]

# Outlier estimates, components, a fitted classifier and a tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
