"""Labelled claims: raw TSV scan, cleaning, splits, processed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.text import strip
from assay.lexicons import LABEL_CLASS

# The fourteen columns of a raw claims file, in file order.
RAW_STRINGS_FIRST = ("id", "label_str", "claim", "subject", "speaker", "speaker_job", "state", "party")
RAW_COUNTS = (
    "barely_true_counts", "false_counts", "half_true_counts", "mostly_true_counts", "pants_fire_counts",
)
RAW_LAST = ("context",)
# File name of each split.
SPLIT_FILES = {"train": "train.tsv", "validation": "valid.tsv", "test": "test.tsv"}

RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in RAW_STRINGS_FIRST]
    + [T.StructField(c, T.IntegerType()) for c in RAW_COUNTS]
    + [T.StructField(c, T.StringType()) for c in RAW_LAST]
)
# Columns of a cleaned claim.
CLAIM_COLUMNS = ("claim", "speaker", "subject", "label", "label_str")


def scan_tsv(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """Read a headerless claims file.  Short rows are padded with nulls; rows with
    too many fields are dropped.  ``quote`` is off by default, so that a stray
    quotation mark cannot swallow lines.

    The sentinel column catches the first surplus field of an over-long row.
    """
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField("_surplus", T.StringType())])
    raw = spark.read.csv(
        path, schema=schema, sep="\t", header=False, encoding="UTF-8", mode="PERMISSIVE",
        quote=quote, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return raw.where(F.col("_surplus").isNull()).drop("_surplus")


def label_class(label_str: Column) -> Column:
    """1 for the true side of the scale, 0 for the false side, null for anything else."""
    real = [name for name, value in LABEL_CLASS.items() if value == 1]
    fake = [name for name, value in LABEL_CLASS.items() if value == 0]
    return F.when(label_str.isin(*real), 1).when(label_str.isin(*fake), 0)


def clean(raw: DataFrame) -> DataFrame:
    """Keep labelled rows with a claim, trim text, fill missing speaker and subject."""
    return (
        raw.withColumn("label", label_class(F.col("label_str")))
        .where(F.col("label").isNotNull() & F.col("claim").isNotNull())
        .withColumns(
            {
                "claim": strip(F.col("claim")),
                "speaker": strip(F.coalesce("speaker", F.lit(""))),
                "subject": strip(F.coalesce("subject", F.lit(""))),
            }
        )
    )


def load_split(spark: SparkSession, folder: str, split: str, quote: str = "") -> DataFrame:
    """One cleaned split with its name in ``split``."""
    if split not in SPLIT_FILES:
        raise ValueError(f"unknown split {split!r}; expected one of {list(SPLIT_FILES)}")
    rows = clean(scan_tsv(spark, f"{folder.rstrip('/')}/{SPLIT_FILES[split]}", quote))
    return rows.select(F.lit(split).alias("split"), *CLAIM_COLUMNS)


def scan_splits(spark: SparkSession, folder: str, quote: str = "") -> DataFrame:
    """All rows of all split files as they are."""
    scans = [scan_tsv(spark, f"{folder.rstrip('/')}/{name}", quote) for name in SPLIT_FILES.values()]
    return reduce(DataFrame.unionByName, scans)


def load_splits(spark: SparkSession, folder: str, quote: str = "") -> DataFrame:
    """All splits in one table."""
    train, *others = [load_split(spark, folder, s, quote) for s in SPLIT_FILES]
    for other in others:
        train = train.unionByName(other)
    return train


def write_processed(claims: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write processed claims, one folder per split."""
    writer = claims.write.mode(mode).partitionBy("split")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.parquet(path)


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read processed claims back."""
    if fmt == "csv":
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        names = schema or "claim string, speaker string, subject string, label int, label_str string, split string"
        return reader.schema(names).csv(path).fillna("", ["speaker", "subject"])
    return spark.read.parquet(path)


def head(claims: DataFrame, n: int, key: str = "claim_id") -> DataFrame:
    """The first ``n`` rows in key order."""
    return claims.orderBy(key).limit(n)


def split_stats(claims: DataFrame) -> DataFrame:
    """Rows, real and fake rows and the share of real rows per split."""
    return claims.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("n_real"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("n_fake"),
        F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("real_share"),
    )


def label_histogram(claims: DataFrame) -> DataFrame:
    """Rows per split and truth label."""
    return claims.groupBy("split", "label_str").agg(F.count("*").alias("n_rows"))


def speaker_history(raw: DataFrame) -> DataFrame:
    """Shares of each past truth verdict of the row's speaker, and their total."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in RAW_COUNTS[1:]), F.coalesce(F.col(RAW_COUNTS[0]), F.lit(0)))
    with_total = raw.withColumn("history_total", total.cast("long"))
    shares = {
        c.replace("_counts", "_share"): F.when(
            F.col("history_total") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("history_total")
        ).otherwise(F.lit(0.0))
        for c in RAW_COUNTS
    }
    return with_total.withColumns(shares)
