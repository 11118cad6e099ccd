"""Model inputs: context text, n-gram TF-IDF and dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import text as tx
from assay.functions import vectors as vx
from assay.operators.evidence import SEPARATOR

PASSAGES_PER_TEXT = 3
MAX_TERMS = 15_000
VECTOR_WIDTH = 384


def context_text(
    claim: Column, speaker: Column | None, subject: Column | None, blank_as: str | None = "unknown"
) -> Column:
    """``[speaker] [subject] claim``; just the claim if either column is absent.

    Blank values become ``blank_as``; with ``None`` they are put in as they are.
    """
    if speaker is None or subject is None:
        return claim

    def shown(value: Column) -> Column:
        if blank_as is None:
            return F.coalesce(value, F.lit(""))
        trimmed = tx.strip(F.coalesce(value, F.lit("")))
        return F.when(trimmed == "", F.lit(blank_as)).otherwise(trimmed)

    return F.concat(F.lit("["), shown(speaker), F.lit("] ["), shown(subject), F.lit("] "), claim)


def model_text(context: Column, passages: Column, limit: int = PASSAGES_PER_TEXT) -> Column:
    """Context, separator and the first ``limit`` passages; the context alone without evidence."""
    joined = tx.strip(F.array_join(F.slice(passages, 1, limit), " "))
    return F.when(F.coalesce(joined, F.lit("")) == "", context).otherwise(
        F.concat(context, F.lit(SEPARATOR), joined)
    )


def model_text_joined(context: Column, evidence: Column) -> Column:
    """The same for evidence that is one text already."""
    return F.when(F.coalesce(evidence, F.lit("")) == "", context).otherwise(
        F.concat(context, F.lit(SEPARATOR), evidence)
    )


# --- TF-IDF in long form -----------------------------------------------------------------------


def gram_counts(texts: DataFrame, key: str = "claim_id", text: str = "text", ngram: tuple[int, int] = (1, 3)) -> DataFrame:
    """``(<key>, term, tf)`` for all n-grams, counted inside each row."""
    counts = tx.counted(tx.ngrams(tx.terms(F.col(text)), *ngram))
    return texts.select(key, F.explode(counts).alias("c")).select(
        key, F.col("c.term").alias("term"), F.col("c.n").cast("long").alias("tf")
    )


def vocabulary(counts: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """The ``max_terms`` most frequent terms: ``(term, total, df)``, ties in term order.

    Sums combine on the map side and the final sort keeps ``max_terms`` rows per
    partition, so the size of the result is fixed by the parameter.
    """
    totals = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    return totals.orderBy(F.desc("total"), "term").limit(max_terms)


def idf(df: Column, n: Column) -> Column:
    """Smoothed inverse document frequency ln((1 + n) / (1 + df)) + 1."""
    return F.log((n + 1) / (df + 1)) + 1.0


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: Column, key: str = "claim_id", sublinear: bool = False) -> DataFrame:
    """``(<key>, term, weight)`` with unit length per row of the input.

    The vocabulary is fixed in size (see :func:`vocabulary`); the norm needs one
    shuffle by ``key``, and a key brings together only the terms of its own text.
    """
    tf = 1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")
    known = vocab.select("term", idf(F.col("df"), n_docs).alias("idf"))
    raw = counts.join(F.broadcast(known), "term").select(key, "term", (tf * F.col("idf")).alias("raw"))
    rows = raw.groupBy(key).agg(
        F.collect_list(F.struct("term", "raw")).alias("terms"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")
    )
    return rows.select(key, "norm", F.explode("terms").alias("t")).select(
        key, F.col("t.term").alias("term"), (F.col("t.raw") / F.col("norm")).alias("weight")
    )


# --- TF-IDF as ML stages -----------------------------------------------------------------------


@dataclass(frozen=True)
class TfidfOptions:
    max_terms: int = MAX_TERMS
    ngram: tuple[int, int] = (1, 3)
    sublinear: bool = False


def tfidf_stages(texts: DataFrame, options: TfidfOptions = TfidfOptions(), text: str = "text", output: str = "tfidf"):
    """Fit the vocabulary on ``texts`` and return the ML stages that apply it.

    The vocabulary comes from the long form above, so ties are settled by term and
    the fit does not depend on the layout.  At most ``max_terms`` rows reach the
    driver.  Vectors stay sparse and are made in the JVM.  Damped counts
    (``sublinear``) exist in the long form only and are refused here.
    """
    if options.sublinear:
        raise ValueError("the ML stages have plain counts; use tfidf(..., sublinear=True)")
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
    from pyspark.ml.linalg import Vectors

    counts = gram_counts(texts, text=text, ngram=options.ngram)
    n_docs = texts.agg(F.count("*").alias("n")).scalar()
    known = (
        vocabulary(counts, options.max_terms)
        .select("term", idf(F.col("df"), n_docs).alias("idf"))
        .orderBy("term")
        .collect()
    )
    if not known:
        raise ValueError("no terms to fit a vocabulary on")
    split = SQLTransformer(statement=f"SELECT *, {_grams_sql(text, options.ngram)} AS _grams FROM __THIS__")
    count = CountVectorizerModel.from_vocabulary([r["term"] for r in known], "_grams", "_counts")
    scale = ElementwiseProduct(
        inputCol="_counts", outputCol="_scaled", scalingVec=Vectors.dense([r["idf"] for r in known])
    )
    norm = Normalizer(inputCol="_scaled", outputCol=output, p=2.0)
    return [split, count, scale, norm]


def _grams_sql(text: str, ngram: tuple[int, int]) -> str:
    """The n-gram array of ``text`` in SQL, for the SQL stage of a saved ML pipeline."""
    parts = ["toks"]
    for n in range(2, ngram[1] + 1):
        more = ", ".join(f"' ', get(toks, i + {j})" for j in range(1, n))
        parts.append(f"array_compact(transform(toks, (t, i) -> concat(t, {more})))")
    parts = parts[ngram[0] - 1:]
    grams = f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
    tokens = f"regexp_extract_all(lower({text}), r'{tx.TERM}', 0)"
    return f"transform(array({tokens}), toks -> {grams})[0]"


# --- Dense vectors -----------------------------------------------------------------------------


def hashed_vectors(texts: DataFrame, width: int = VECTOR_WIDTH, text: str = "text", output: str = "vector") -> DataFrame:
    """Default text encoder: hashed counts of terms and term pairs, unit length, as ``array<double>``.

    A fixed transformation without training: terms are hashed to ``width`` slots.
    """
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    grams = texts.withColumn("_grams", tx.ngrams(tx.terms(F.col(text)), 1, 2))
    hashed = HashingTF(numFeatures=width, inputCol="_grams", outputCol="_tf").transform(grams)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(hashed)
    return unit.withColumn(output, vector_to_array("_unit")).drop("_grams", "_tf", "_unit")


def supplied_vectors(texts: DataFrame, table: DataFrame, key: str = "claim_id", output: str = "vector") -> DataFrame:
    """Join vectors made elsewhere: ``table(<key>, vector)``."""
    return texts.join(table.select(key, F.col("vector").alias(output)), key)


def encoded_vectors(
    texts: DataFrame, load: Callable[[], Callable[[list[str]], Sequence]], text: str = "text", output: str = "vector",
    batch: int = 64,
) -> DataFrame:
    """Vectors from a model that is plugged in: ``load`` returns the encoding function.

    It is called once per partition, and the model sees ``batch`` texts at a time.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*texts.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator) -> Iterator:
        encode = load()
        for frame in frames:
            values = frame[text].tolist()
            rows = [list(map(float, v)) for at in range(0, len(values), batch) for v in encode(values[at : at + batch])]
            yield frame.assign(**{output: rows})

    return texts.mapInPandas(run, schema)


def mean_pool(vectors: DataFrame, key: str = "claim_id", vector: str = "vector", output: str = "vector") -> DataFrame:
    """Mean vector per key.

    One row per dimension is averaged with a map-side combine, so a key with very
    many vectors is never gathered in one place; only the ``width`` means are.
    """
    dims = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    means = dims.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(key).agg(F.transform(packed, lambda d: d["x"]).alias(output))


def claim_evidence_vectors(
    claims: DataFrame, passage_vectors: DataFrame, claim_weight: float = 0.7, output: str = "vector"
) -> DataFrame:
    """Blend each claim's ``vector`` with the mean of all its passage vectors.

    ``passage_vectors(claim_id, vector)``; claims without passages keep their own vector.
    """
    pooled = mean_pool(passage_vectors, output="_evidence")
    return claims.join(pooled, "claim_id", "left").withColumn(
        output, vx.blend(F.col("vector"), F.col("_evidence"), claim_weight)
    ).drop("_evidence")


def input_vectors(
    claims: DataFrame,
    use_speaker: bool = True,
    evidence_fusion: str = "text",
    encode: Callable[[DataFrame], DataFrame] = hashed_vectors,
) -> DataFrame:
    """Dense ``vector`` per claim from ``(claim_id, claim, speaker, subject, passages)``.

    ``evidence_fusion``: ``text`` puts the first passages into the encoded text,
    ``vector`` encodes claim and passages apart and blends them.  ``use_speaker``
    is a choice of its own.  ``encode`` adds ``vector`` for the column ``text``.
    """
    context = context_text(
        F.col("claim"), F.col("speaker") if use_speaker else None, F.col("subject") if use_speaker else None
    )
    if evidence_fusion == "text":
        return encode(claims.withColumn("text", model_text(context, F.col("passages")))).drop("text")
    if evidence_fusion != "vector":
        raise ValueError(f"unknown evidence fusion {evidence_fusion!r}")
    own = encode(claims.withColumn("text", context)).drop("text")
    pieces = encode(claims.select("claim_id", F.explode("passages").alias("text")))
    return claim_evidence_vectors(own, pieces.select("claim_id", "vector"))
