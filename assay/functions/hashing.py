"""Random choices as hash values.

A choice depends only on its key, never on the partition, the run or the engine,
so every job that needs randomness can be repeated and retried task by task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions.text import let


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def digest(*key) -> Column:
    """MD5 of the key parts joined with ``|``, as lower-case hex."""
    return F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in key]))


def uniform(*key) -> Column:
    """A number in [0, 1) made from the first 32 bits of the key's digest."""
    bits = F.conv(F.substring(digest(*key), 1, 8), 16, 10).cast("double")
    return bits / F.lit(4294967296.0)


def pick(size: Column, *key) -> Column:
    """A whole number in [0, ``size``)."""
    return F.floor(uniform(*key) * size).cast("int")


def draws(n: Column, *key) -> Column:
    """``n`` random 32-bit numbers as hex text, four from each digest of the key and a block number.

    Hex text of equal length sorts like the numbers, so :func:`under` and :func:`over`
    compare it as it is.
    """

    def block(j: Column) -> Column:
        return let(digest(*key, j), lambda d: F.array(*[F.substring(d, at, 8) for at in (1, 9, 17, 25)]))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / 4).cast("int")), block)
    return F.slice(F.flatten(blocks), F.lit(1), n)


def under(draw: Column, p: Column) -> Column:
    """Whether the draw, as a number in [0, 1), is less than ``p``."""
    return below_bound(draw, bound(p))


def bound(p: Column) -> Column:
    """What draws below ``p`` are less than, as text: made once where many draws meet the same ``p``."""
    return _bound(F.ceil(p * F.lit(4294967296.0)))


def below_bound(draw: Column, limit: Column) -> Column:
    return F.concat(F.lit("0"), draw) < limit


def over(draw: Column, p: Column) -> Column:
    """Whether the draw, as a number in [0, 1), is greater than ``p``."""
    return F.concat(F.lit("0"), draw) >= _bound(F.floor(p * F.lit(4294967296.0)) + 1)


def _bound(steps: Column) -> Column:
    # Nine digits leave room for p = 1.
    return F.lpad(F.lower(F.hex(steps.cast("long"))), 9, "0")
