"""Tokenising, counting and chunking text as array expressions inside one row.

A row's tokens never leave the row, so none of these needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One white-space character in the sense of Python's ``str.split``, for patterns that
# start with the flag ``(?U)``.
SPACE = r"[\s\x1c-\x1f]"
# A run of two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Binding through a lambda keeps the optimizer from copying an expensive
    array expression into every place, or every loop turn, that refers to it.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """White-space separated words, in order."""
    return F.array_remove(F.split(text, f"(?U){SPACE}+"), "")


def terms(text: Column) -> Column:
    """Lower-cased index terms (two word characters or more), in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def counted(tokens: Column) -> Column:
    """``array<struct<term, n>>``: distinct tokens with their counts, sorted by term.

    Sorting puts equal tokens side by side; the starts of the runs then give
    terms and counts in one linear sweep.
    """

    def runs(tok: Column) -> Column:
        starts = F.filter(
            F.transform(tok, lambda t, i: F.when((i == 0) | (t != F.get(tok, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda at, j: F.struct(
                    F.get(tok, at).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(tok)) - at).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, joined with single spaces."""

    def of_size(tok: Column, n: int) -> Column:
        if n == 1:
            return tok
        # Past the last full gram a token is missing, which makes the text null.
        grown = F.transform(
            tok, lambda t, i: F.concat(t, *[x for j in range(1, n) for x in (F.lit(" "), F.get(tok, i + j))])
        )
        return F.array_compact(grown)

    def grams(tok: Column) -> Column:
        return F.concat(*[of_size(tok, n) for n in range(low, high + 1)])

    return let(tokens, grams)


def chunks(text: Column, size: int = 100) -> Column:
    """Consecutive passages of ``size`` words; the last one may be shorter."""

    def cut_words(ws: Column) -> Column:
        return F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size(ws) - 1, F.lit(size)),
                lambda at: F.array_join(F.slice(ws, at + 1, size), " "),
            )
        )

    return let(words(text), cut_words)


def keywords(text: Column, stopwords: list[str] | tuple[str, ...], top: int = 5) -> Column:
    """The keyword query of a claim.

    Up to ``top`` words are used as they are.  Longer claims give their ``top``
    most frequent terms outside ``stopwords`` (ties in alphabetical order) in
    order of first appearance, or their first ``top`` words if none is left.
    """
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")

    def pick(tok: Column) -> Column:
        content = F.filter(counted(tok), lambda c: ~F.array_contains(stop, c["term"]))
        ranked = F.sort_array(F.transform(content, lambda c: F.struct((-c["n"]).alias("m"), c["term"].alias("t"))))
        best = F.transform(
            F.slice(ranked, 1, top), lambda c: F.struct(F.array_position(tok, c["t"]).alias("at"), c["t"].alias("t"))
        )
        return F.array_join(F.transform(F.sort_array(best), lambda b: b["t"]), " ")

    def query(ws: Column) -> Column:
        found = let(terms(text), pick)
        return F.when(F.size(ws) <= top, text).otherwise(
            let(found, lambda q: F.when(q != "", q).otherwise(F.array_join(F.slice(ws, 1, top), " ")))
        )

    return let(words(text), query)
