"""The roles the given tables play in this domain.

``documents`` are long claims and corpus pages, ``conversations`` short claims,
``benchmark`` probe claims with known sources, ``labels`` the truth class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.hashing import uniform
from assay.lexicons import synonym_lexicon

# Fixture lexicons: words that do occur in the invented texts.
HEDGE = ("on", "the")
VAGUE = ("of", "and")
# Fixture stop list for keyword queries.
STOPWORDS = ("the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "at", "by", "an", "be", "are", "was", "this")
SEEDS = (42, 123, 456, 789, 2025)
# Fixture thesaurus: (word, part of speech, synonym).
SYNONYMS = (
    ("the", "noun", "yonder"), ("the", "noun", "this_one"), ("the", "noun", "such"),
    ("and", "noun", "plus"), ("and", "noun", "and"), ("and", "verb", "adds"),
    ("of", "adj", "from"), ("of", "adj", "hell"), ("is", "verb", "seems"), ("is", "verb", "stays"),
    ("on", "adv", "upon"), ("de", "noun", "du"), ("de", "noun", "des"), ("la", "noun", "cette"),
    ("und", "noun", "sowie"), ("die", "noun", "jene"), ("que", "noun", "cual"), ("el", "noun", "ese"),
)
TAGGED = (
    ("the", "NN"), ("and", "NNS"), ("of", "JJ"), ("is", "VBZ"), ("on", "RB"), ("de", "NN"), ("la", "NNP"),
    ("und", "NN"), ("die", "NN"), ("que", "NN"), ("el", "DT"),
)
# Fixture models: name, four flags, base, gain and noise of the probability of REAL.
VARIANTS = (
    ("full", "synonym", True, True, True, 0.25, 0.30, 0.50),
    ("no_retrieve", "synonym", False, True, True, 0.28, 0.28, 0.50),
    ("no_speaker", "synonym", True, False, True, 0.30, 0.26, 0.50),
    ("no_ensemble", "synonym", True, True, False, 0.33, 0.22, 0.60),
    ("no_augmentation", "none", True, True, True, 0.26, 0.29, 0.50),
    ("tfidf_lr", "baseline", False, False, False, 0.31, 0.24, 0.55),
    ("vectors_mlp", "baseline", False, False, False, 0.34, 0.20, 0.55),
)
# Fixture attacks: name and loss of signal.
ATTACK_LOSS = (("clean", 0.0), ("synonym_p15", 0.04), ("synonym_p30", 0.08), ("synonym_p50", 0.12))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, claim, speaker, subject, label, split)``; the label may be null."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    u = uniform(F.lit("fixture_split"), F.col("claim_id"))
    return (
        docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"), F.col("source").alias("speaker"),
            F.col("lang").alias("subject"), F.col("quality").alias("label"),
        )
        .withColumn("split", F.when(u < 0.8, "train").when(u < 0.9, "validation").otherwise("test"))
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).where(F.col("label").isNotNull())


def short_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, claim, speaker, subject)`` from conversation turns."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.col("text").alias("claim"),
        F.col("role").alias("speaker"), F.lit(None).cast("string").alias("subject"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, claim)`` from the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, extract)`` from the documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("extract"))


def lexicon(spark: SparkSession) -> DataFrame:
    synonyms = spark.createDataFrame(list(SYNONYMS), "word string, pos string, synonym string")
    tagged = spark.createDataFrame(list(TAGGED), "word string, tag string")
    return synonym_lexicon(synonyms, tagged)


def _structs(rows, names) -> F.Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def variant_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the fixture models for each labelled claim and seed."""
    names = ("model", "augmentation", "retrieve", "use_speaker", "use_ensemble", "base", "gain", "noise")
    rows = labelled(spark, sf_dir).select("claim_id", "label")
    rows = rows.withColumn("v", F.explode(_structs(VARIANTS, names)))
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    u = uniform(F.col("v.model"), F.col("seed"), F.col("claim_id"))
    p = F.col("v.base") + F.col("v.gain") * F.col("label") + F.col("v.noise") * (u - 0.5)
    rows = rows.select("claim_id", "label", "seed", *[f"v.{n}" for n in names[:5]], p.alias("p_real"))
    return rows.withColumn("p_fake", 1.0 - F.col("p_real")).withColumn(
        "pred", F.when(F.col("p_real") > F.col("p_fake"), 1).otherwise(0)
    )


def attack_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of one fixture model for clean and attacked claims, per seed."""
    rows = labelled(spark, sf_dir).select("claim_id", "label", "claim")
    rows = rows.withColumn("a", F.explode(_structs(ATTACK_LOSS, ("attack", "loss"))))
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    u = uniform(F.col("a.attack"), F.col("seed"), F.col("claim_id"))
    p = 0.25 + (0.30 - F.col("a.loss")) * F.col("label") + 0.50 * (u - 0.5)
    return rows.select("claim_id", "claim", "label", "seed", "a.attack", F.when(p > 0.5, 1).otherwise(0).alias("pred"))


def own_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(claim_id, passages)``: all passages of every document itself."""
    from assay.functions.text import chunks

    return claims(spark, sf_dir).select("claim_id", chunks(F.col("claim")).alias("passages"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of the fixture models: one per model and seed."""
    from assay.operators.metrics import evaluate

    flags = ("model", "augmentation", "retrieve", "use_speaker", "use_ensemble", "seed")
    graded = evaluate(variant_predictions(spark, sf_dir), *flags)
    return graded.select(
        *flags, F.col("accuracy").alias("test_acc"), F.col("f1_macro").alias("test_f1_macro"),
        F.col("f1_fake").alias("test_f1_fake"), F.col("f1_real").alias("test_f1_real"),
    )
