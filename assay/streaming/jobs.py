"""Streaming jobs.  Each one gives the rows of its batch counterpart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assay.functions.uncertainty import with_budget
from assay.lexicons import HEDGE_WORDS, VAGUE_WORDS
from assay.operators.evidence import is_filled
from assay.operators.retrieval import retrieve
from assay.session import cut
from assay.sources.results import has_table

CLAIM_SCHEMA = "claim_id long, claim string"


def read_claims(spark: SparkSession, folder: str, schema: str = CLAIM_SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """New claim files of a folder as a stream; ``files_per_batch`` bounds one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(
    claims: DataFrame, hedge: Sequence[str] = HEDGE_WORDS, vague: Sequence[str] = VAGUE_WORDS, **budget
) -> DataFrame:
    """Uncertainty and budget of each arriving claim; stateless."""
    return with_budget(claims, hedge, vague, **budget)


def build_evidence_stream(
    claims: DataFrame, pages: DataFrame, index: DataFrame, out: str, checkpoint: str, **retrieval
) -> StreamingQuery:
    """Retrieve evidence for arriving claims and add it under ``out`` exactly once.

    Every batch owns the folder ``batch=<id>`` and overwrites it, so a batch that is
    replayed after a failure leaves one copy.  Claims done by other batches are
    skipped.  Runs through the waiting files and stops; start it again for new ones.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Of several texts with one id the smallest counts, in a replay too.
        todo = batch.groupBy("claim_id").agg(F.min("claim").alias("claim"))
        if has_table(spark, out):
            done = spark.read.parquet(out).where(F.col("batch") != batch_id).select("claim_id")
            todo = todo.join(done, "claim_id", "left_anti")
        todo = cut(todo)
        found = retrieve(todo, pages, index, **retrieval)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        claims.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fill_rate_stream(
    evidence: DataFrame, time: str = "ingested_at", width: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Fill rate per time window of arriving evidence rows.

    The watermark bounds the state to the open windows.
    """
    filled = F.when(is_filled(F.col("passages")), 1).otherwise(0)
    return (
        evidence.withWatermark(time, lateness)
        .groupBy(F.window(time, width).alias("w"))
        .agg(
            F.count("*").alias("n_claims"),
            F.sum(filled).cast("long").alias("n_filled"),
            F.avg(filled).alias("fill_rate"),
        )
        .select(F.col("w.start").alias("window_start"), "n_claims", "n_filled", "fill_rate")
    )
