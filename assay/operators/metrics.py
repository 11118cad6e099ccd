"""Classification scores as one grouped aggregate of conditional counts.

Every report below reads its predictions once and shuffles only one short row
per group and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blend weights tried on the validation split.
BLEND_WEIGHTS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35)


def ratio(above: Column, below: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(below != 0, above / below).otherwise(F.lit(0.0))


def confusion(label: Column, pred: Column) -> dict[str, Column]:
    """Counts with class 1 (real) as positive."""

    def count(y: int, p: int) -> Column:
        return F.sum(F.when((label == y) & (pred == p), 1).otherwise(0)).cast("long")

    return {"tp": count(1, 1), "fp": count(0, 1), "fn": count(1, 0), "tn": count(0, 0)}


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy and F1 scores from the four counts."""
    real = ratio(2 * tp, 2 * tp + fp + fn)
    fake = ratio(2 * tn, 2 * tn + fn + fp)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "f1_macro": (fake + real) / 2.0,
        "f1_fake": fake,
        "f1_real": real,
    }


COUNTS = ("tp", "fp", "fn", "tn")


def evaluate(predictions: DataFrame, *by: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Confusion counts, accuracy and F1 scores per group of ``by``."""
    counted = predictions.groupBy(*by).agg(
        *[c.alias(n) for n, c in confusion(F.col(label), F.col(pred)).items()]
    )
    return counted.withColumns(scores(*[F.col(c) for c in COUNTS]))


def class_report(predictions: DataFrame, *by: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    counted = predictions.groupBy(*by).agg(
        *[c.alias(n) for n, c in confusion(F.col(label), F.col(pred)).items()]
    )
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    fake = {"precision": ratio(tn, tn + fn), "recall": ratio(tn, tn + fp), "f1": ratio(2 * tn, 2 * tn + fn + fp)}
    real = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    n_fake, n_real = tn + fp, tp + fn

    def row(name: str, values: dict[str, Column], support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), *[v.alias(k) for k, v in values.items()], support.alias("support"))

    macro = {k: (fake[k] + real[k]) / 2.0 for k in fake}
    weighted = {k: ratio(fake[k] * n_fake + real[k] * n_real, n_fake + n_real) for k in fake}
    rows = F.array(
        row("FAKE", fake, n_fake), row("REAL", real, n_real),
        row("macro avg", macro, n_fake + n_real), row("weighted avg", weighted, n_fake + n_real),
    )
    return counted.select(*by, F.inline(rows))


def class_weights(claims: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n_rows, weight)`` with weight n / (2 max(count, 1)), for both classes."""
    counted = claims.agg(
        *[F.sum(F.when(F.col(label) == c, 1).otherwise(0)).cast("long").alias(f"n{c}") for c in (0, 1)]
    )
    total = F.col("n0") + F.col("n1")
    rows = [
        F.struct(
            F.lit(c).alias("label"), F.col(f"n{c}").alias("n_rows"),
            (total / (2.0 * F.greatest(F.col(f"n{c}"), F.lit(1)))).alias("weight"),
        )
        for c in (0, 1)
    ]
    return counted.select(F.inline(F.array(*rows)))


def predicted(p_fake: Column, p_real: Column) -> Column:
    """The likelier class; a tie is class 0."""
    return F.when(p_real > p_fake, 1).otherwise(0)


def blend(first: DataFrame, second: DataFrame, weight: float, key: Sequence[str] = ("claim_id",)) -> DataFrame:
    """``(1 - weight) * first + weight * second`` on the class probabilities of both tables."""
    other = second.select(*key, F.col("p_fake").alias("_q_fake"), F.col("p_real").alias("_q_real"))
    keep = 1.0 - weight
    mixed = first.join(other, list(key)).withColumns(
        {
            "p_fake": keep * F.col("p_fake") + weight * F.col("_q_fake"),
            "p_real": keep * F.col("p_real") + weight * F.col("_q_real"),
        }
    )
    return mixed.drop("_q_fake", "_q_real").withColumn("pred", predicted(F.col("p_fake"), F.col("p_real")))


def weight_scores(
    first: DataFrame, second: DataFrame, label: str = "label", key: Sequence[str] = ("claim_id",),
    weights: Sequence[float] = BLEND_WEIGHTS,
) -> DataFrame:
    """Scores of every blend weight: ``(weight, accuracy, f1_macro, ...)``.

    One join and one aggregate hold the counts of all weights side by side; the
    predictions are never multiplied by the number of weights.
    """
    other = second.select(*key, F.col("p_fake").alias("_q_fake"), F.col("p_real").alias("_q_real"))
    both = first.join(other, list(key))
    aggregates = []
    for i, w in enumerate(weights):
        keep = 1.0 - w
        pred = predicted(
            keep * F.col("p_fake") + w * F.col("_q_fake"), keep * F.col("p_real") + w * F.col("_q_real")
        )
        aggregates += [c.alias(f"{n}_{i}") for n, c in confusion(F.col(label), pred).items()]
    rows = F.array(
        *[
            F.struct(F.lit(float(w)).alias("weight"), *[F.col(f"{c}_{i}").alias(c) for c in COUNTS])
            for i, w in enumerate(weights)
        ]
    )
    table = both.agg(*aggregates).select(F.inline(rows))
    return table.withColumns(scores(*[F.col(c) for c in COUNTS]))


def best_weight(graded: DataFrame) -> DataFrame:
    """The weight with the highest macro F1; of equal ones the smallest."""
    return graded.orderBy(F.desc("f1_macro"), "weight").limit(1)


def paired_outcomes(
    predictions: DataFrame, base: str, by: str = "attack", key: Sequence[str] = ("claim_id",)
) -> DataFrame:
    """Predictions of each variant next to those of ``base`` for the same claims:
    ``(key, <by>, label, base_pred, pred)``."""
    reference = predictions.where(F.col(by) == base).select(*key, F.col("pred").alias("base_pred"))
    return predictions.where(F.col(by) != base).join(reference, list(key)).select(
        *key, by, "label", "base_pred", "pred"
    )


def mcnemar(pairs: DataFrame, by: str = "attack") -> DataFrame:
    """McNemar counts per variant, and the statistic with continuity correction."""
    was, now = F.col("base_pred") == F.col("label"), F.col("pred") == F.col("label")
    counted = pairs.groupBy(by).agg(
        F.sum(F.when(was & now, 1).otherwise(0)).cast("long").alias("both_right"),
        F.sum(F.when(was & ~now, 1).otherwise(0)).cast("long").alias("only_base"),
        F.sum(F.when(~was & now, 1).otherwise(0)).cast("long").alias("only_variant"),
        F.sum(F.when(~was & ~now, 1).otherwise(0)).cast("long").alias("both_wrong"),
    )
    b, c = F.col("only_base"), F.col("only_variant")
    gap = F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double")
    return counted.withColumn("statistic", ratio(gap * gap, (b + c).cast("double")))


def drop_from(graded: DataFrame, base: str, by: str = "attack", metric: str = "accuracy", *within: str) -> DataFrame:
    """Add ``drop``: the metric of the ``base`` row minus that of each row.

    ``within`` names columns, such as the model or seed, that pair the rows.
    """
    reference = graded.where(F.col(by) == base).select(*within, F.col(metric).alias("_base"), F.lit(1).alias("_one"))
    rows = graded.withColumn("_one", F.lit(1))
    joined = rows.join(reference, [*within, "_one"], "left")
    return joined.withColumn("drop", F.col("_base") - F.col(metric)).drop("_base", "_one")


def stratified(predictions: DataFrame, **strata: Column) -> DataFrame:
    """Accuracy per value of each stratum: ``(stratum, value, n_claims, accuracy)``.

    All strata come from one pass; a claim adds one short row per stratum, which
    the map-side aggregate folds at once.
    """
    tags = F.array(
        *[F.struct(F.lit(n).alias("stratum"), c.cast("string").alias("value")) for n, c in strata.items()]
    )
    right = F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)
    return (
        predictions.select(right.alias("right"), F.explode(tags).alias("t"))
        .groupBy("t.stratum", "t.value")
        .agg(F.count("*").alias("n_claims"), F.avg("right").alias("accuracy"))
    )
