"""Dense vectors as ``array<float>`` or ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from left to right in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero if either vector is zero."""
    scale = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def blend(claim: Column, evidence: Column, claim_weight: float = 0.7) -> Column:
    """Weighted sum of a claim vector and an evidence vector; the claim alone without evidence."""
    other = round(1.0 - claim_weight, 10)
    mixed = F.zip_with(
        claim,
        evidence,
        lambda x, y: F.lit(claim_weight) * x.cast("double") + F.lit(other) * y.cast("double"),
    )
    return F.coalesce(mixed, F.transform(claim, lambda x: x.cast("double")))


def mean(vectors: Column) -> Column:
    """Mean of an ``array<array<double>>``; null if it is empty.

    Dimension by dimension, so the vectors of one row are pooled in place.
    """
    n = F.size(vectors)
    zero = F.transform(vectors[0], lambda _: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.when(n > 0, F.transform(total, lambda t: t / n))
