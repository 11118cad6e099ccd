"""Token-id tables in ORC: documents in id order, one row each, with start offsets over the whole corpus.

ORC stores the ids as integer runs, cuts a file into stripes that are read in parallel, and keeps minima, maxima and a
Bloom filter of the document ids per row group, so that a lookup by id skips what it doesn't need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.llm.common import key_and_text, slices
from assay.llm.tokens import default_vocabulary, document_ids
from assay.session import cut, width

# Row groups of the index, and bytes of a stripe.
INDEX_STRIDE, STRIPE_BYTES = 1000, 16 << 20

FILE_SCHEMA = "doc_id long, row int, ids array<int>"


def token_rows(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, row, ids) with one range of document ids to a partition, in ascending order within it.

    ``row`` counts the rows of the partition.  A null text has the end id only; null ids come first; equal ids are put in
    order of their texts.
    """
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for part in slices(batches):
            ids = document_ids(path, part.column("text").to_pylist(), end_id)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i4")
            flat = pa.array(np.concatenate(ids).astype("<i4"))
            rows = pa.array(np.arange(row, row + len(ids), dtype="<i4"))
            row += len(ids)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), rows, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "row", "ids"]
            )

    texts = key_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    ranged = texts.repartitionByRange(width(docs.sparkSession), F.asc_nulls_first("doc_id"))
    return ranged.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text").mapInArrow(encode, FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1) -> None:
    """Write the token table of ``docs`` below ``path``; the file of a lower part number holds lower ids."""
    rows = token_rows(docs, vocabulary, end_id)
    (
        rows.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.compress", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, ids, part): the stored rows and the number of the file they are in."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.schema(FILE_SCHEMA).orc(path).select("doc_id", "row", "ids", part.alias("part"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents; the id filter reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "ids")


def token_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, read from the files.

    ``start`` counts the ids of all documents before it: a running sum within each file, and the totals of the earlier
    files.  An empty table has no rows.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(np.diff(ids.offsets.to_numpy()))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), batch.column("part"), pa.array((ends - starts).astype("<i8")), pa.array(crc, pa.int64())],
                ["doc_id", "row", "part", "n_tokens", "ids_crc32"],
            )

    measured = cut(read_tokens(spark, path).mapInArrow(measure, "doc_id long, row int, part int, n_tokens long, ids_crc32 long"))
    # One row per file: the number of files is the number of partitions of the write.
    totals = measured.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before")
    )
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return (
        measured.withColumn("inside", running).join(before, "part")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
