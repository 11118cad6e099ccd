"""The operators as queries over the given tables, with the digest columns of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a function under its own name."""
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.token_orc import token_directory, write_tokens

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path)
    return token_directory(spark, path)


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"))


@query
def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.fingerprints import compare_with_edits

    return compare_with_edits(table(spark, folder, "documents"))


# (verdict, host, path) of the rules that the pages are judged by.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.url_rules import judge, rule_table

    return judge(table(spark, folder, "pages"), rule_table(spark, URL_RULES))


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.warc import read_bundles, records, write_bundles

    path = scratch_path(spark, "bundles")
    index = write_bundles(records(table(spark, folder, "pages")), path)
    return read_bundles(spark, path, index).drop("url")


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.quality import judged

    return judged(table(spark, folder, "documents"), carry=["doc_id"])


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.simhash import linked_components

    return linked_components(table(spark, folder, "documents"), distance=4, shingle_words=4)


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.suffix_dedup import removal_digests

    return removal_digests(table(spark, folder, "documents"))


@query
def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.ctw import score_documents

    return score_documents(table(spark, folder, "documents"))


# Shares of all tokens that the mixed corpus should have.  No rates reach a share of zero, as all probabilities are above it:
# the least squares then rest on a handful of documents.
DOMAIN_WEIGHTS = {"good": 0.8, "poor": 0.18, "toxic": 0.02}


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.mixing import label_domains, mixing_rates

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return mixing_rates(docs, label_domains(labels), DOMAIN_WEIGHTS, carry=["doc_id"])


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.merkle import verify

    return verify(table(spark, folder, "documents"))


@query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.centroids import cluster

    return cluster(table(spark, folder, "embeddings"))


@query
def op13_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from assay.llm.pieces import round_trip

    return round_trip(table(spark, folder, "documents"))
