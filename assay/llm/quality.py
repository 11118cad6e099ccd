"""Quality rules: per-document statistics and robust outliers among the documents of one language and source.

Each group's centre and covariance are minimum-covariance-determinant estimates.  Concentration steps re-estimate both from the
three quarters of the group's documents with the smallest Mahalanobis distances; they start from medians with three
covariances (quartile ranges, spatial signs, damped scores), and of the three ends the one with the least determinant counts.
A group's estimates are then drawn towards those of its language, these towards those of the table, and these towards a broad
spread, with a weight that falls as the number of documents grows.  Only sums and histograms of a narrow table are
shuffled, so the size of a group doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.text import let
from assay.llm.common import SPACES, words
from assay.session import cut

# Transformed statistics and the smallest spread that each is given: differences below it are no sign of bad quality.
FLOORS = {"x_word": 0.15, "x_symbol": 0.5, "x_line": 0.1, "x_repeat": 0.1, "x_caps": 0.5}
STATS = tuple(FLOORS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MADE = {*COUNTS, "base_failed", "distance", "kept"}

# Spread of each statistic that a table is expected to have before any of its documents is seen.
BROAD = {"x_word": 0.5, "x_symbol": 1.5, "x_line": 0.6, "x_repeat": 0.3, "x_caps": 1.2}

# Share of a group that the estimates rest on, number of concentration steps, and how many documents weigh as much as the wider group.
CORE, STEPS, PRIOR_ROWS = 0.75, 6, 200

# Name of the pool of all sources of a language, and of the language of a pool of all languages; others are empty or start with "=".
EVERY = "*"

# Columns that name a group, and a start of its estimates.
GROUP, STARTED = ["lang", "pool"], ["lang", "pool", "start"]

# Squared distances above this are outliers; 1.5e-7 of a normal group of five statistics lies beyond it.
CUTOFF = 40.0

# Median of the chi-square distribution with five degrees of freedom (fixed value).
CHI2_MEDIAN_5 = 4.351460191096

# Bins of a histogram: per unit of a statistic, and per factor e of a squared distance.
STAT_BINS, DISTANCE_BINS = 200, 50


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(found: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more."""

    def flagged(pairs: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return (x.h == F.try_element_at(pairs, i + 2).h) | ((i > 0) & (x.h == F.try_element_at(pairs, F.greatest(i, F.lit(1))).h))

        return F.array_sort(F.transform(F.filter(pairs, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x.i))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.coalesce(F.try_element_at(at, i + 2) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(pairs, flagged), covered))

    windows = F.transform(
        F.sequence(F.lit(1), F.size(found) - 2), lambda i: F.xxhash64(F.get(found, i - 1), F.get(found, i), F.get(found, i + 1))
    )
    return F.when(F.size(found) < 3, F.lit(0).cast("long")).otherwise(let(windows, count))


def text_counts(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_caps of a text; all zero for null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    word_counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return [
        word_counts.alias("word_counts"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _count_chars(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _count_chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ!?").cast("long").alias("n_caps"),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """Every row with its counts, ``base_failed`` and the transformed statistics."""
    with_counts = docs.select("*", *text_counts(F.col("text")))
    n, repeats = F.col("word_counts.n_words"), F.col("word_counts.n_repeat_words")
    some = F.greatest(n, F.lit(1))
    return with_counts.select(
        *[F.col(f"`{c}`") for c in docs.columns], n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"),
        ((n < 50) | (100 * repeats > 50 * n)).alias("base_failed"),
        F.log1p(F.col("word_chars") / some).alias("x_word"),
        F.log1p(100 * F.col("n_symbols") / some).alias("x_symbol"),
        F.log1p(10 * F.col("n_dup_lines") / some).alias("x_line"),
        F.sqrt(repeats / some).alias("x_repeat"),
        F.log1p(100 * F.col("n_caps") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x_caps"),
    )


def _kth_bin(rows: DataFrame, keys: list[str], bin_: str, shares: dict[str, float]) -> DataFrame:
    """Per ``keys``, the bins in which the running count reaches the given shares of all rows."""
    counts = rows.groupBy(*keys, bin_).agg(F.count("*").alias("c"))
    here = Window.partitionBy(*keys)
    running = counts.withColumn("upto", F.sum("c").over(here.orderBy(bin_))).withColumn("all", F.sum("c").over(here))
    return running.groupBy(*keys).agg(
        *[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * share), F.col(bin_))).alias(name) for name, share in shares.items()]
    )


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _medians(stats: DataFrame) -> DataFrame:
    """Medians m<k> and scales s<k> (from quartile ranges, with the floors) of each group's statistics."""
    tall = stats.select(
        *GROUP, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(x) * STAT_BINS).cast("int").alias("bin")) for k, x in enumerate(STATS)])).alias("s"),
    ).select(*GROUP, "s.k", "s.bin")
    parts = _kth_bin(tall, [*GROUP, "k"], "bin", {"low": 0.25, "mid": 0.5, "high": 0.75})
    of = lambda k, x: F.max(F.when(F.col("k") == k, x))
    wide = parts.groupBy(*GROUP).agg(*[of(k, F.col("mid")).alias(f"m{k}") for k in range(len(STATS))], *[of(k, F.col("high") - F.col("low")).alias(f"r{k}") for k in range(len(STATS))])
    return wide.select(
        *GROUP, *[(F.col(f"m{k}") / STAT_BINS).alias(f"m{k}") for k in range(len(STATS))],
        *[F.sqrt(F.pow(F.col(f"r{k}") / STAT_BINS / 1.349, F.lit(2.0)) + floor**2).alias(f"s{k}") for k, floor in enumerate(FLOORS.values())],
    )


def _starts(stats: DataFrame) -> DataFrame:
    """(lang, pool, start, m<k>, c<ij>): three first estimates of every group, all around the medians.

    Start 0 has the scales alone, start 1 the covariance of spatial signs, start 2 that of damped (hyperbolic tangent) scores.
    """
    medians = cut(_medians(stats))
    scored = stats.join(medians, GROUP).select(*GROUP, *[((F.col(x) - F.col(f"m{k}")) / F.col(f"s{k}")).alias(f"z{k}") for k, x in enumerate(STATS)])
    length = F.sqrt(sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(len(STATS))), F.lit(0.0)))
    rows = scored.withColumn("length", length)
    sums = []
    for i, j in _pairs():
        zi, zj = F.col(f"z{i}"), F.col(f"z{j}")
        sign = F.when(F.col("length") > 0, zi * zj / (F.col("length") * F.col("length"))).otherwise(F.lit(0.0))
        sums += [(F.avg(sign) * len(STATS)).alias(f"a{i}{j}"), F.avg(F.tanh(zi) * F.tanh(zj)).alias(f"b{i}{j}")]
    wide = rows.groupBy(*GROUP).agg(*sums).join(medians, GROUP)

    def start(number: int, shape) -> Column:
        entries = [(shape(i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in _pairs()]
        return F.struct(F.lit(number).alias("start"), *entries)

    shapes = [lambda i, j: F.lit(float(i == j)), lambda i, j: F.col(f"a{i}{j}"), lambda i, j: F.col(f"b{i}{j}")]
    every = F.explode(F.array(*[start(n, shape) for n, shape in enumerate(shapes)])).alias("e")
    return wide.select(*GROUP, *[f"m{k}" for k in range(len(STATS))], every).select(*GROUP, "e.start", *[f"m{k}" for k in range(len(STATS))], *[f"e.c{i}{j}" for i, j in _pairs()])


def _cholesky(estimates: DataFrame, keys: list[str], floors: list[float] | None = None) -> DataFrame:
    """Centre and Cholesky factor of each covariance c<ij>, with the squared floors added to its diagonal."""
    out = estimates
    for i, j in _pairs():
        rest = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        if i == j:
            # Exact arithmetic keeps the pivot above the squared floor, here and in sums of such matrices.
            least = list(FLOORS.values())[i] ** 2
            value = F.sqrt(F.greatest(rest + least if floors else rest, F.lit(least)))
        else:
            value = rest / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", value)
    return out.select(*keys, *[f"m{k}" for k in range(len(STATS))], *[f"l{i}{j}" for i, j in _pairs()])


def _distance() -> Column:
    """Squared Mahalanobis distance of a row to the centre joined to it."""
    parts: list[Column] = []
    for i, x in enumerate(STATS):
        rest = F.col(x) - F.col(f"m{i}")
        for j, z in enumerate(parts):
            rest = rest - F.col(f"l{i}{j}") * z
        parts.append(rest / F.col(f"l{i}{i}"))
    return sum((z * z for z in parts[1:]), parts[0] * parts[0])


def _distances(stats: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    # The centre's distances need each part several times: let the optimiser keep them as columns of one step.
    rows = stats.join(_cholesky(estimates, keys, list(FLOORS.values())), GROUP)
    return rows.select(*keys, *STATS, _distance().alias("d2")).withColumn("bin", _bin(F.col("d2")))


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * DISTANCE_BINS).cast("int")


def robust_estimates(stats: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """(lang, pool, n, start, m<k>, v<ij>): number of rows, chosen start, centre and covariance of every group of ``stats``.

    The covariance has the floors in it and is scaled to the median distance of a normal group.  Equal determinants are
    settled by the number of the start.
    """
    estimates = cut(_starts(stats))
    for _ in range(steps):
        rows = _distances(stats, estimates, STARTED)
        # Stored, so that its size is known: few groups are broadcast, and no row is shuffled for the edge of its group.
        edges = cut(_kth_bin(rows, STARTED, "bin", {"edge": core}))
        inner = rows.join(edges, STARTED).where(F.col("bin") <= F.col("edge"))
        estimates = cut(inner.groupBy(*STARTED).agg(
            *[F.avg(x).alias(f"m{k}") for k, x in enumerate(STATS)],
            *[F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i, j in _pairs()],
        ))
    factors = _cholesky(estimates, STARTED, list(FLOORS.values()))
    volume = sum((F.log(F.col(f"l{i}{i}")) for i in range(len(STATS))), F.lit(0.0))
    least = factors.groupBy(*GROUP).agg(F.min_by("start", F.struct(F.round(volume, 9), "start")).alias("start"))
    chosen = cut(estimates.join(least, STARTED))
    # A core's covariance is too small for the whole group: scale it to the median of a normal group's distances.
    rows = _distances(stats, chosen, STARTED)
    sizes = rows.groupBy(*STARTED).agg(F.count("*").alias("n"))
    middle = _kth_bin(rows, STARTED, "bin", {"mid": 0.5}).join(sizes, STARTED)
    scale = middle.select(*STARTED, "n", F.greatest(F.exp((F.col("mid") + 1) / DISTANCE_BINS) / CHI2_MEDIAN_5, F.lit(1.0)).alias("scale"))
    floors = [f**2 for f in FLOORS.values()]
    return cut(chosen.join(scale, STARTED).select(
        *GROUP, "n", "start", *[f"m{k}" for k in range(len(STATS))],
        *[((F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) + (floors[i] if i == j else 0.0)) * F.col("scale")).alias(f"v{i}{j}") for i, j in _pairs()],
    ))


def _drawn(own: str, wider: str, prior: float) -> tuple[list[Column], list[Column]]:
    """Centre and covariance of a group (columns of prefix ``own``, with n) drawn towards those of the wider one, which weighs ``prior`` rows.

    The distance between the centres is no part of the covariance: else few documents that are all bad would excuse one another.
    """
    w = F.col(f"{own}n") / (F.col(f"{own}n") + prior)
    mixed = lambda x: w * F.col(f"{own}{x}") + (1 - w) * F.col(f"{wider}{x}")
    return [mixed(f"m{k}") for k in range(len(STATS))], [mixed(f"v{i}{j}") for i, j in _pairs()]


def shrunk_estimates(estimates: DataFrame, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """(lang, source, m<k>, l<ij>): centre and Cholesky factor to judge each source of each language by.

    ``estimates`` are those of :func:`robust_estimates` for all sources, languages (pool ``*``) and the table (both ``*``).
    """
    names = [*[f"m{k}" for k in range(len(STATS))], *[f"v{i}{j}" for i, j in _pairs()]]
    of = lambda prefix: [F.col(x).alias(prefix + x) for x in ("n", *names)]

    def drawn(rows: DataFrame, own: str, wider: str, out: str) -> DataFrame:
        centre, spread = _drawn(own, wider, prior_rows)
        return rows.select(*rows.columns, *[c.alias(out + x) for c, x in zip([*centre, *spread], names)])

    broad = [F.col(f"t_m{k}").alias(f"b_m{k}") for k in range(len(STATS))]
    broad += [F.lit(list(BROAD.values())[i] ** 2 if i == j else 0.0).alias(f"b_v{i}{j}") for i, j in _pairs()]
    table = drawn(estimates.where(F.col("lang") == EVERY).select(*of("t_")).select("*", *broad), "t_", "b_", "u_")
    whole = table.select(F.struct(*[f"u_{x}" for x in names])).scalar()
    langs = estimates.where((F.col("lang") != EVERY) & (F.col("pool") == EVERY)).select("lang", *of("a_"), whole.alias("whole"))
    langs = drawn(langs.select("lang", *[f"a_{x}" for x in ("n", *names)], "whole.*"), "a_", "u_", "w_").select("lang", *[f"w_{x}" for x in names])
    sources = estimates.where(F.col("pool") != EVERY).select("lang", F.col("pool").alias("source"), *of("g_"))
    sources = drawn(sources.join(langs, "lang"), "g_", "w_", "x_")
    final = sources.select("lang", "source", *[F.col(f"x_m{k}").alias(f"m{k}") for k in range(len(STATS))], *[F.col(f"x_v{i}{j}").alias(f"c{i}{j}") for i, j in _pairs()])
    return _cholesky(final, ["lang", "source"])


def judged(
    docs: DataFrame, carry: list[str] | None = None, cutoff: float = CUTOFF, core: float = CORE, steps: int = STEPS, prior_rows: float = PRIOR_ROWS
) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default), the counts, ``base_failed``, ``distance`` (squared) and ``kept``.

    A document is kept if it passes the base rule and its distance is at most ``cutoff``.  Estimates come from documents
    that pass the base rule.  Null languages and sources count as values of their own.  A source of n such documents is judged
    by its own estimates with weight n / (n + ``prior_rows``) and by its language's with the rest, which are drawn likewise to
    the table's, and those to the spreads of ``BROAD``.  Where no document of a language and source passes the base rule the distance is
    null.  Null text counts as empty.  Repeated rows are judged one by one; a text of any length is counted whole.  Columns
    of ``docs`` that carry a name made here are replaced; an empty table gives no rows.
    """
    own = [c for c in carry or docs.columns if c not in MADE]
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows = cut(measured(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), F.col("text").alias("text"), known("lang").alias("lang"), known("source").alias("source")
    )).drop("text"))
    passed = rows.where(~F.col("base_failed")).select("lang", "source", *STATS)
    # A document counts for its source, its language and the table.
    wanted = [F.struct("lang", F.col("source").alias("pool")), F.struct("lang", F.lit(EVERY).alias("pool")), F.struct(F.lit(EVERY).alias("lang"), F.lit(EVERY).alias("pool"))]
    stats = cut(passed.select(F.explode(F.array(*wanted)).alias("in"), *STATS).select("in.*", *STATS))
    limits = cut(shrunk_estimates(robust_estimates(stats, core, steps), prior_rows))
    out = rows.join(limits, ["lang", "source"], "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select("doc.*", *COUNTS, "base_failed", "distance", kept.alias("kept"))


def without_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "text", "lang", "source")
    return judged(whole, carry=["document"]).where("kept").select("document.*")
