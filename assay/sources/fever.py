"""Claims with key-based evidence and the page dump that holds the sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.text import strip

NOT_ENOUGH = "NOT ENOUGH INFO"
SUPPORTED = "SUPPORTS"
_CLAIM_LINE = "claim string, label string, evidence array<array<array<string>>>"
_PAGE_LINE = "id string, lines string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with ``line_key``, which orders them by file path, then position.

    Rows of one file block lie in one partition in file order, so block start and
    the running id inside it give the order without a shuffle or a global count.
    """
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_key"),
    )


def scan_claims(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """``(claim, label_str, evidence, line_key)`` of a JSON-lines file.

    ``max_lines`` counts input lines before any filter.  Evidence tuples mix
    numbers, text and nulls and are read as text.
    """
    lines = _lines(spark, path)
    if max_lines is not None:
        lines = lines.orderBy("line_key").limit(max_lines)
    row = lines.select("line_key", F.from_json("value", _CLAIM_LINE).alias("c"))
    return row.select("c.claim", F.col("c.label").alias("label_str"), "c.evidence", "line_key")


def verdict_class(label_str: Column) -> Column:
    """1 for supported claims, 0 for all other verdicts."""
    return F.when(label_str == SUPPORTED, 1).otherwise(0)


def keep_verdicts(claims: DataFrame) -> DataFrame:
    """Drop claims without enough information and add the binary ``label``."""
    return claims.where(F.col("label_str") != NOT_ENOUGH).withColumn("label", verdict_class(F.col("label_str")))


def load_claims(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Scan, then filter and binarise."""
    return keep_verdicts(scan_claims(spark, path, max_lines))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(title, lines, line_key)`` of a folder of JSON-lines page files."""
    row = _lines(spark, path).select("line_key", F.from_json("value", _PAGE_LINE).alias("p"))
    return row.select(F.col("p.id").alias("title"), "p.lines", "line_key")


def sentence_table(pages: DataFrame, order: str = "line_key") -> DataFrame:
    """``(title, sent_id, text)`` from page rows ``(title, lines, <order>)``.

    A title that occurs again replaces the earlier page as a whole; inside a page
    the last line of a sentence id wins.  Lines without a whole-number id or
    without text are dropped.
    """
    last = pages.groupBy("title").agg(F.max_by(F.coalesce("lines", F.lit("")), F.col(order)).alias("lines"))
    numbered = last.select("title", F.posexplode(F.split("lines", "\n")).alias("pos", "line"))
    fields = F.split("line", "\t")
    parsed = numbered.where(F.size(fields) >= 2).select(
        "title", "pos", strip(fields[0]).try_cast("int").alias("sent_id"), strip(fields[1]).alias("text")
    )
    usable = parsed.where(F.col("sent_id").isNotNull() & (F.col("text") != ""))
    return usable.groupBy("title", "sent_id").agg(F.max_by("text", "pos").alias("text"))


def write_sentences(sentences: DataFrame, path: str, table: str, buckets: int) -> DataFrame:
    """Store the sentence table as ``table`` below ``path``, in ``buckets`` by title and sentence, each sorted, and read it back.

    A join on (title, sent_id) takes the stored buckets as they are: however many claims and runs
    ask for sentences, only the citations move.  A title of any length is spread over buckets.
    """
    spark, keys = sentences.sparkSession, ("title", "sent_id")
    writer = sentences.repartition(buckets, *keys).write.format("parquet").mode("overwrite")
    writer.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)
