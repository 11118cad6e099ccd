"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.session import width

# The six white-space characters of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of text that a task turns over at once.
BATCH_BYTES = 4 << 20


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def key_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names: other columns can't clash with its own."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly over the session's shuffle partitions, whatever its keys."""
    return df.repartition(width(df.sparkSession))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``text``, so that long texts don't add up in a worker."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.column(text).nbytes)
        step = max(1, int(batch.num_rows * limit / size))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
