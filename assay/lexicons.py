"""Word lists and their Spark tables.  Every operator takes them as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Hedging words of the uncertainty score.
HEDGE_WORDS = (
    "allegedly", "apparently", "claims", "reportedly", "possibly",
    "perhaps", "maybe", "might", "could", "suggest", "suggests",
    "suggested", "seem", "seems", "likely", "unlikely", "rumored",
    "purportedly", "supposedly", "some", "say", "says",
)

# Vague quantifiers of the uncertainty score.
VAGUE_WORDS = (
    "many", "several", "few", "some", "various", "numerous",
    "most", "often", "sometimes", "frequently", "rarely",
    "occasionally", "generally", "largely", "broadly",
)

# Words that random deletion always keeps.
KEPT_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on",
    "with", "at", "by", "from", "and", "or", "but", "if", "as", "not", "that",
    "this",
)

# Coarse part of speech of each Penn Treebank content tag.
POS_OF_TAG = {
    "NN": "noun", "NNS": "noun", "NNP": "noun", "NNPS": "noun",
    "VB": "verb", "VBD": "verb", "VBG": "verb", "VBN": "verb", "VBP": "verb", "VBZ": "verb",
    "JJ": "adj", "JJR": "adj", "JJS": "adj",
    "RB": "adv", "RBR": "adv", "RBS": "adv",
}

# Substitutes that are never offered.
BLOCKED_SYNONYMS = (
    "fuck", "shit", "ass", "bastard", "crap", "damn", "hell",
    "piss", "whore", "bitch", "cock", "dick", "pussy", "cunt",
    "homo", "retard", "moron", "idiot",
    "ampere", "neb", "pecker", "billhook",
)

# The six truth labels and their class (1 real, 0 fake).
LABEL_CLASS = {
    "true": 1, "mostly-true": 1, "half-true": 1,
    "barely-true": 0, "false": 0, "pants-fire": 0,
}


def english_stopwords(spark: SparkSession) -> list[str]:
    """Spark's own English stop list, the default for keyword queries."""
    from pyspark.ml.feature import StopWordsRemover

    spark.sparkContext  # the list is read through the running JVM
    return StopWordsRemover.loadDefaultStopWords("english")


def tag_table(spark: SparkSession) -> DataFrame:
    """``(tag, pos)`` rows of the part-of-speech map."""
    return spark.createDataFrame(sorted(POS_OF_TAG.items()), "tag string, pos string")


def synonym_lexicon(
    synonyms: DataFrame,
    tagged_words: DataFrame,
    tags: DataFrame | None = None,
    blocked: tuple[str, ...] = BLOCKED_SYNONYMS,
) -> DataFrame:
    """Usable substitutes per word: ``(word, candidates)``.

    ``synonyms(word, pos, synonym)`` is a thesaurus in long form and
    ``tagged_words(word, tag)`` gives each word its part-of-speech tag.  A
    substitute must share the part of speech, differ from the word, be a single
    word and not be blocked.  Words without a substitute are absent.
    """
    tags = tags if tags is not None else tag_table(synonyms.sparkSession)
    tagged = tagged_words.join(tags, "tag").select(F.lower("word").alias("word"), "pos")
    lowered = F.lower("synonym")
    usable = (
        synonyms.select(F.lower("word").alias("word"), "pos", "synonym")
        .where((lowered != F.col("word")) & ~lowered.isin(*blocked))
        .where(~F.col("synonym").contains("_") & ~F.col("synonym").contains(" "))
    )
    return (
        usable.join(tagged, ["word", "pos"], "left_semi")
        .groupBy("word")
        .agg(F.sort_array(F.collect_set("synonym")).alias("candidates"))
    )
