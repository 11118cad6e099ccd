"""Student's t and Wilcoxon's signed-rank distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for a whole number of degrees of freedom.

    The distribution has a finite trigonometric sum for whole ``df``: with
    theta = atan(|t| / sqrt(df)), odd ``df`` sums odd powers of the cosine and
    even ``df`` sums even ones; each term follows from the one before it.
    """
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    # Number of terms after the first one.
    turns = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")

    def add(state: Column, j: Column) -> Column:
        factor = F.when(odd, 2.0 * j / (2.0 * j + 1.0)).otherwise((2.0 * j - 1.0) / (2.0 * j))
        term = state["term"] * factor * cos2
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.when(turns >= 1, F.sequence(F.lit(1), F.greatest(turns, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    series = F.aggregate(steps, start, add)["total"]
    inside_odd = F.lit(2.0 / math.pi) * (
        theta + F.when(df == 1, F.lit(0.0)).otherwise(F.sin(theta) * F.cos(theta) * series)
    )
    inside = F.when(odd, inside_odd).otherwise(F.sin(theta) * series)
    return F.greatest(1.0 - inside, F.lit(0.0))


def t_quantile_975(df: Column) -> Column:
    """Upper 2.5 % point of Student's t by bisection on :func:`t_two_sided`."""

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2.0
        above = t_two_sided(middle, df) > 0.05
        return F.struct(
            F.when(above, middle).otherwise(state["low"]).alias("low"),
            F.when(above, state["high"]).otherwise(middle).alias("high"),
        )

    start = F.struct(F.lit(0.0).alias("low"), F.lit(16.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve)
    return (found["low"] + found["high"]) / 2.0


def normal_upper(z: Column) -> Column:
    """Upper tail of the standard normal, by the continued fraction of Mills' ratio
    for large ``z`` and the power series of the error function otherwise."""
    a = F.abs(z)
    density = F.exp(-a * a / 2.0) / F.lit(math.sqrt(2.0 * math.pi))
    fraction = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, j: j / (a + acc)
    )
    far = density / (a + fraction)

    def add(state: Column, j: Column) -> Column:
        term = state["term"] * a * a / (2.0 * j + 1.0)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)), F.struct(a.alias("term"), a.alias("total")), add
    )["total"]
    near = 0.5 - density * series
    upper = F.when(a > 3.0, far).otherwise(near)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def signed_rank_exact(doubled_ranks: Column, doubled_smaller: Column) -> Column:
    """Exact two-sided p-value of the smaller signed-rank sum, ties included.

    ``doubled_ranks`` holds twice the (mean) rank of every difference, so all are whole numbers;
    ``doubled_smaller`` is twice the smaller sum.  The chance of each sum from 0 up to it is built rank by
    rank: with either sign equally likely, half the chance stays and half moves up by the rank.  Chances
    neither overflow nor need a bound on the number of ranks; the work is ranks times the smaller sum.
    """
    first = F.transform(F.sequence(F.lit(0), doubled_smaller.cast("int")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def with_rank(chances: Column, rank: Column) -> Column:
        return F.transform(
            chances, lambda c, s: (c + F.when(s >= rank, F.get(chances, s - rank)).otherwise(F.lit(0.0))) / 2.0
        )

    chances = F.aggregate(doubled_ranks, first, with_rank)
    return F.least(2.0 * F.aggregate(chances, F.lit(0.0), lambda total, c: total + c), F.lit(1.0))
