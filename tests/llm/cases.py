"""Documents with the odd cases that every operator must stand."""

import random

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, fp long, kept string"


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and long texts, copies, equal ids, repeated rows and clashing column names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = " ".join(word() for _ in range(120))
    texts = [
        None, "", " \t\n", "Word", "two words", base, base, base + " more", base.upper(), " ".join(word() for _ in range(30_000)),
        "É" * 500, "a" * 1200, "x " * 300, "naïve café 日本語 " * 40, "<|endoftext|> it's\n\nline\nline\nline", base[:400] + " " + base[:430],
    ]
    texts += [" ".join(word() for _ in range(rng.randint(5, 200))) for _ in range(24)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None, i, "k", 1, "no") for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[5], rows[5], (7, "other text", "en", "s0", 3, 1, "", 0, "")]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


def rows_of(df: DataFrame) -> list[tuple[int | None, str]]:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
