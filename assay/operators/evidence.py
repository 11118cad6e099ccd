"""Evidence tables: lookup, resume, key-based resolution and fill-rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import SPACE, strip

SEPARATOR = " [SEP] "
SENTENCES_PER_CLAIM = 3
_NO_TEXT = "array<string>"


def parse_evidence(joined: Column, separator: str = SEPARATOR) -> Column:
    """Joined evidence text to a list; null, blank text and blank pieces give nothing."""
    quoted = separator.replace("[", r"\[").replace("]", r"\]")
    pieces = F.filter(F.split(joined, quoted), lambda p: strip(p) != "")
    return F.coalesce(pieces, F.array().cast(_NO_TEXT))


def join_evidence(passages: Column, separator: str = SEPARATOR) -> Column:
    """A list of passages to joined evidence text, for CSV export."""
    return F.array_join(passages, separator)


def is_filled(passages: Column) -> Column:
    """Whether a claim has any non-blank passage."""
    return F.exists(passages, lambda p: p.rlike(f"(?U)[^{SPACE[1:]}"))


def lookup(claims: DataFrame, cache: DataFrame, order: str = "row_no") -> DataFrame:
    """Left join of claims with an evidence cache by claim text.

    ``cache(claim, passages, <order>)``: of several rows for one text the last in
    ``order`` wins.  The aggregate combines on the map side, so a text that
    makes up a large share of the cache shrinks before the shuffle.  Misses
    get an empty list.
    """
    last = cache.groupBy("claim").agg(F.max_by("passages", order).alias("passages"))
    return claims.join(last, "claim", "left").withColumn(
        "passages", F.coalesce("passages", F.array().cast(_NO_TEXT))
    )


def align(claims: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """Attach precomputed evidence by ``claim_id``; without a table every claim gets
    an empty list.  ``evidence_mode`` says which case applied."""
    empty = F.array().cast(_NO_TEXT)
    if evidence is None:
        return claims.withColumn("passages", empty).withColumn("evidence_mode", F.lit("none"))
    return (
        claims.join(evidence.select("claim_id", "passages"), "claim_id", "left")
        .withColumn("passages", F.coalesce("passages", empty))
        .withColumn("evidence_mode", F.lit("table"))
    )


def pending(claims: DataFrame, done: DataFrame, max_claims: int | None = None) -> DataFrame:
    """Claims that have no evidence row yet, at most ``max_claims`` in id order.

    Only ids are sorted for the cut; the claims follow by a semi-join.
    """
    new = claims.join(done.select("claim_id"), "claim_id", "left_anti")
    if max_claims is None:
        return new
    first = new.select("claim_id").orderBy("claim_id").limit(max_claims)
    return new.join(first, "claim_id", "left_semi")


def reused(claims: DataFrame, done: DataFrame) -> DataFrame:
    """Evidence rows of claims that were finished in an earlier run."""
    return done.join(claims.select("claim_id"), "claim_id", "left_semi")


def evidence_keys(evidence: Column) -> Column:
    """Distinct ``struct<page, sent_id>`` keys of nested evidence, in encounter order.

    ``evidence`` is a list of groups of tuples (annotation, evidence id, page,
    sentence).  Tuples shorter than four or without page or sentence are skipped.
    """
    cited = F.filter(
        F.flatten(evidence),
        lambda e: (F.size(e) >= 4) & (F.coalesce(F.get(e, F.lit(2)), F.lit("")) != "") & F.get(e, F.lit(3)).isNotNull(),
    )
    return F.array_distinct(
        F.transform(
            cited,
            lambda e: F.struct(F.get(e, F.lit(2)).alias("title"), F.get(e, F.lit(3)).try_cast("int").alias("sent_id")),
        )
    )


def resolve(claims: DataFrame, sentences: DataFrame, limit: int = SENTENCES_PER_CLAIM) -> DataFrame:
    """Add ``evidence_text``: the first ``limit`` cited sentences that exist, space-joined.

    ``claims(claim_id, evidence, ...)``; ``sentences(title, sent_id, text)``.  Repeated
    citations are dropped inside the row, so the only shuffle is the equi-join on
    (title, sentence); adaptive execution splits a title that many claims cite.
    """
    cited = claims.select(
        "claim_id", F.posexplode(evidence_keys(F.col("evidence"))).alias("pos", "key")
    ).select("claim_id", "pos", "key.title", "key.sent_id")
    found = cited.join(sentences.where(F.col("text") != ""), ["title", "sent_id"])
    texts = found.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("found"))
    texts = texts.select(
        "claim_id",
        F.array_join(F.transform(F.slice("found", 1, limit), lambda f: f["text"]), " ").alias("evidence_text"),
    )
    return claims.join(texts, "claim_id", "left").withColumn("evidence_text", F.coalesce("evidence_text", F.lit("")))


def fill_rate(evidence: DataFrame, *by: str) -> DataFrame:
    """Rows, rows with evidence and their share, per group if ``by`` is given."""
    filled = F.when(is_filled(F.col("passages")), 1).otherwise(0)
    return evidence.groupBy(*by).agg(
        F.count("*").alias("n_claims"),
        F.sum(filled).cast("long").alias("n_filled"),
        F.avg(filled).alias("fill_rate"),
    )


def k_distribution(evidence: DataFrame, k: str = "k") -> DataFrame:
    """Claims per evidence budget, their share and the number of distinct budgets.

    The second step runs over at most one row per budget.
    """
    counts = evidence.groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n_claims"))
    totals = counts.agg(F.collect_list(F.struct("k", "n_claims")).alias("rows"), F.sum("n_claims").alias("total"))
    return totals.select(F.explode("rows").alias("r"), "total", F.size("rows").alias("distinct_k")).select(
        "r.k", "r.n_claims", (F.col("r.n_claims") / F.col("total")).alias("share"), "distinct_k"
    )
