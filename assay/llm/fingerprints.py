"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range.  Sketches of any two documents therefore keep
the same hashes of what they share, whatever their lengths: the sketch of a union is the union of the sketches, and the
share of one sketch that lies in another estimates the share of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.text import let
from assay.llm.common import key_and_text, words
from assay.session import width

# Words of a shingle, and one in how many hashes is kept.
SHINGLE_WORDS, SCALE = 5, 8

# Where fewer hashes of a sketch can be compared, the whole shingle sets are compared if both texts are at hand.
LEAST_COMPARED = 64


def shingles(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all ``shingle_words``-word shingles of a text, in order and with repeats (array of long, none negative).

    A text with fewer words has one shingle, all its words; a null text and one without words have none.
    """

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle_words - 1), F.lit(1)))
        # Hash the words in turn, each seeded with the hash before it; the sign bit is dropped.
        shingle = lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(shingle_words)]).bitwiseAND(F.lit(2**63 - 1))
        return F.when(F.size(w) > 0, F.transform(at, shingle)).otherwise(F.array().cast("array<long>"))

    return let(words(text), hashes)


def low(hashes: Column, scale: int = SCALE) -> Column:
    """The sketch of shingle hashes: those below 2^63 / ``scale``, sorted and distinct.  The bound is the same for every text."""
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(2**63 // scale))))


def sketch(text: Column, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below 2^63 / ``scale`` of all ``shingle_words``-word shingles (array of long).

    Short texts may have an empty sketch, and texts without words do.
    """
    return low(shingles(text, shingle_words), scale)


def merged(a: Column, b: Column) -> Column:
    """Sketch of two documents together; the shingles across the joint are not in it."""
    return F.sort_array(F.array_union(a, b))


def compared(a: Column, b: Column) -> Column:
    """Number of hashes that :func:`likeness` rests on: those of the smaller sketch."""
    return F.least(F.size(a), F.size(b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the shorter document's shingles that the other has, from 0 to 1; null if a sketch is empty,
    as nothing can be said then.

    Both sketches keep all hashes below the same bound, so the estimate holds for any two lengths.
    """
    least = compared(a, b)
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def containment(a: Column, b: Column) -> Column:
    """The same share from whole shingle hashes.  Two texts without words are alike (1); one without and one with words are not (0)."""

    def share(pair: Column) -> Column:
        least = compared(pair.a, pair.b)
        both = F.size(F.array_intersect(pair.a, pair.b)) / least
        return F.when(least > 0, both).otherwise((F.size(pair.a) == F.size(pair.b)).cast("double"))

    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), share)


def near(a: Column, b: Column, a_low: Column, b_low: Column) -> Column:
    """:func:`likeness` of the sketches ``a_low`` and ``b_low``; where these compare fewer than ``LEAST_COMPARED`` hashes,
    :func:`containment` of all shingle hashes ``a`` and ``b``, which it estimates."""
    return F.when(compared(a_low, b_low) < LEAST_COMPARED, containment(a, b)).otherwise(likeness(a_low, b_low))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 lower-case hex digits per hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next) of every document; ``next`` is the text of the document after it.

    The order is descending ``doc_id``, null ids last, equal ids by their texts; after the last comes the first, and a
    single document is next to itself.  A null text counts as empty.  The ids are cut into ranges of about equal count, each
    sorted on its own; only the first row of each range is handed to the range before it.
    """
    ranges = 4 * width(docs.sparkSession)
    texts = key_and_text(docs).withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    quantiles = texts.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 10000)).first()[0] or []
    bounds = F.array(*[F.lit(b).cast("long") for b in sorted(set(quantiles))]) if quantiles else F.array().cast("array<long>")
    ranged = texts.withColumn("range", F.size(F.filter(bounds, lambda b: b < F.col("at"))))

    firsts = ranged.groupBy("range").agg(F.max("at").alias("at"))  # as many rows as ranges
    heads = (
        ranged.join(F.broadcast(firsts), ["range", "at"]).groupBy("range").agg(F.min("text").alias("text"))
        .withColumn("before", F.coalesce(F.lag("range").over(Window.orderBy(F.desc("range"))), F.min("range").over(Window.partitionBy())))
        .select(F.col("before").alias("range"), F.col("text").alias("handed"))
    )
    inner = ranged.withColumn("next", F.lead("text").over(Window.partitionBy("range").orderBy(F.desc("at"), "text")))
    return inner.join(heads, "range").select("doc_id", "text", F.coalesce("next", "handed").alias("next"))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` whose last third (rounded down, code points) is replaced by as many code points of ``following``'s start."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def compare_with_edits(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next document's are.

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts count as
    empty; a text without words has an empty fingerprint, as short ones may have.  Very long texts are taken whole: a row holds
    three arrays of eight bytes a word.
    """
    made = lambda text: shingles(F.col(text), shingle_words)
    texts = beside_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next")))
    hashed = texts.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        made("text").alias("own"), made("edited").alias("edit"), made("next").alias("next"),
    )
    sketched = hashed.select("*", *[low(F.col(c), scale).alias(f"{c}_low") for c in ("own", "edit", "next")])
    own, edit, following = [(F.col(c), F.col(f"{c}_low")) for c in ("own", "edit", "next")]
    return sketched.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own[1]).alias("fingerprint"), fingerprint(edit[1]).alias("edited_fingerprint"),
        near(own[0], edit[0], own[1], edit[1]).alias("near_edited"), near(own[0], following[0], own[1], following[1]).alias("near_next"),
    )
