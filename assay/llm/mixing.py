"""Soft-membership mixing: document rates whose expected token totals per domain match targets.

A logistic classifier, fitted on a bounded sample of a labelled table, gives every document a probability for each domain.
Rates r >= 0 then solve a least-squares problem,

    minimise  g' W g,   g_k = (sum over documents of r t p_k - target_k) / total tokens,

with t a document's tokens and W the inverse of the second moments of p.  Projected gradient steps lead there from r = 1: each
lowers a document's rate by p . u, never below zero, with u = M^-1 g and M the second moments of the documents above zero, which
makes a step exact as long as no further rate ends at zero.  Targets within reach take some steps.  Where the squares stop falling
the targets are out of reach.  Of all rates with the least squares those nearest to 1 are then r = max(0, 1 - p . h) for one vector
h of K multipliers, found by Newton steps with a weight on the distance to 1 that falls until the gradient over all documents shows
that nothing is left to gain.  Steps of both kinds need K and K * K sums only, and the rates follow from a document's own
probabilities and those vectors, so nothing but sums leaves a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import lower_ascii, words
from assay.session import cut

# Labelled rows that the classifier is fitted on, about; the choice is by a hash of the id.
FIT_ROWS = 20_000

# Hashed features of a text, and the classifier's lasso penalty, which keeps the telling words only, and iterations.
FEATURES, PENALTY, ITERATIONS = 1 << 15, 0.002, 60

# Largest share of all tokens by which a total may miss its target, or else the part of the least squares by which they may
# be exceeded; both are proven by the gradient.
TOLERANCE, EXCESS = 1e-5, 0.01

# Projected gradient steps; targets within reach take fewer than ten, and rates are expressions that grow with each.
STEPS = 40

# Out of reach: step lengths that one pass tries, and the factor by which the weight on the distance to 1 falls.
LENGTHS, FALL = (1.0, 0.5, 0.2, 0.05), 0.03

# Passes after which the search is given up with an error; it takes some dozens.
PASSES = 400

DOMAINS = ("good", "poor", "toxic")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a label table: toxic, or good or poor by quality; rows without both labels drop out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("doc_id"), domain.alias("domain")).where("domain is not null")


def _features(rows: DataFrame) -> DataFrame:
    found = words(F.translate(lower_ascii(F.col("text")), ".,;:!?\"()", " "))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="found", outputCol="features").transform(rows.withColumn("found", found)).drop("found")


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, fit_rows: int = FIT_ROWS):
    """A classifier from about ``fit_rows`` rows of ``labelled`` (doc_id, domain), or None if they name less than two domains.

    Other domains than those given, null ids and ids without a document are left out.
    """
    usable = labelled.where(F.col("domain").isin(list(domains)) & F.col("doc_id").isNotNull())
    n = usable.count()
    share = min(1.0, fit_rows / max(n, 1))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(sample.select("doc_id", index.cast("double").alias("label"))), "doc_id"
    )
    train = cut(_features(rows).select("features", "label"))
    if train.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(family="multinomial", regParam=PENALTY, elasticNetParam=1.0, maxIter=ITERATIONS).fit(train)


def with_posteriors(docs: DataFrame, model, domains: tuple[str, ...] = DOMAINS, carry: list[str] | None = None) -> DataFrame:
    """(doc, n_tokens, p): the ``carry`` columns of every row as a struct, its words, and its probability of each domain.

    Without a model all domains are equally likely.  A domain that the classifier hasn't seen has probability zero.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    )
    n_tokens = F.size(words(F.col("text"))).cast("long").alias("n_tokens")
    if model is None:
        return rows.select("doc", n_tokens, F.array(*[F.lit(1.0 / len(domains))] * len(domains)).alias("p"))
    scored = model.transform(_features(rows.select("doc", n_tokens, "text")))
    p = vector_to_array("probability")
    return scored.select("doc", "n_tokens", F.array(*[F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k in range(len(domains))]).alias("p"))


def _rate(steps: list[np.ndarray]) -> Column:
    rate = F.lit(1.0)
    for u in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.get("p", F.lit(k)) * float(x) for k, x in enumerate(u)), F.lit(0.0)))
    return rate


def _projected(scored: DataFrame, total: float, target: np.ndarray, second: np.ndarray, tolerance: float, steps: int = STEPS) -> tuple[list[np.ndarray], np.ndarray, bool]:
    """The vectors u of the projected gradient steps, the totals over ``total`` after them, and whether those meet the targets.

    Ends where they do, where the squares no longer fall, which is undone, or after ``steps`` steps.
    """
    weight, k = np.linalg.inv(second), len(target)
    taken: list[np.ndarray] = []
    before, value = target, np.inf
    while True:
        rows = scored.where("n_tokens > 0").select(
            (F.col("n_tokens") / total).alias("t"), *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(k)], _rate(taken).alias("r")
        )
        sums = [F.expr(f"sum(t * r * p{i})").alias(f"s{i}") for i in range(k)]
        sums += [F.expr(f"sum(if(r > 0, t * p{i} * p{j}, 0))").alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]
        now = rows.agg(*sums).first()
        totals = np.array([now[f"s{i}"] for i in range(k)])
        gap = totals - target
        if np.abs(gap).max() <= tolerance:
            return taken, totals, True
        if gap @ weight @ gap >= value:
            return taken[:-1], before, False
        if len(taken) == steps:
            return taken, totals, False
        before, value = totals, gap @ weight @ gap
        moments = np.array([[now[f"m{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
        taken.append(np.linalg.solve(moments + 1e-6 * np.eye(k), gap))


def _multiplied(h: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.get("p", F.lit(k)) * float(x) for k, x in enumerate(h)), F.lit(0.0)))


def _measure(scored: DataFrame, total: float, k: int, tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For the rates of each vector of multipliers: totals and second moments of the rows above zero, over ``total``, and the largest rate."""
    rows = scored.where("n_tokens > 0").select(
        (F.col("n_tokens") / total).alias("t"), *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(k)], *[_multiplied(h).alias(f"r{n}") for n, h in enumerate(tried)]
    )
    sums = []
    for n in range(len(tried)):
        sums += [F.expr(f"sum(t * r{n} * p{i})").alias(f"s{n}_{i}") for i in range(k)] + [F.expr(f"max(r{n})").alias(f"r{n}")]
        sums += [F.expr(f"sum(if(r{n} > 0, t * p{i} * p{j}, 0))").alias(f"m{n}_{i}_{j}") for i in range(k) for j in range(i + 1)]
    now = rows.agg(*sums).first()
    return [
        (np.array([now[f"s{n}_{i}"] for i in range(k)]), np.array([[now[f"m{n}_{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]), now[f"r{n}"])
        for n in range(len(tried))
    ]


def _multipliers(scored: DataFrame, total: float, target: np.ndarray, second: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The vector h of the least-squares rates, and the totals over ``total`` that they lead to.

    For each weight eps the minimum of  g' W g / 2 + eps / 2 (sum of t (r - 1)^2)  has W g = eps h.  By convexity the squares exceed the
    least ones by no more than the gradient allows: with the smallest p . W g of all documents, at least eps (1 - largest rate)
    there, and the tokens of the optimum, at most sqrt(target' W target).  A domain that no document has may be most of the squares:
    eps has to be small as well, for the others to be met.
    """
    weight, k = np.linalg.inv(second), len(target)
    size = np.sqrt(target @ weight @ target)
    back = np.linalg.inv(np.linalg.cholesky(second))
    h, eps = np.zeros(k), 1.0
    totals, moments, most = _measure(scored, total, k, [h])[0]
    for _ in range(PASSES):
        gap = totals - target
        while True:
            slope = eps * second @ h - gap
            excess = max(0.0, weight @ gap @ totals) + max(0.0, eps * (most - 1) + np.abs(weight @ slope).max()) * size
            if np.abs(gap).max() <= tolerance or (eps <= tolerance / 10 and excess <= max(EXCESS * (gap @ weight @ gap) / 2, (tolerance * size) ** 2 / 2)):
                return h, totals
            if slope @ weight @ slope > (0.1 * eps) ** 2 * (h @ second @ h):
                break
            eps *= FALL
        # In the coordinates of the second moments: well scaled however alike the documents are.
        step = -back.T @ np.linalg.solve(back @ moments @ back.T + eps * np.eye(k), back @ slope)
        tried = [h + x * step for x in LENGTHS]
        found = _measure(scored, total, k, tried)
        # The slope along the step tells better than the value, whose digits cancel, how near its lowest point is.
        best = min(range(len(tried)), key=lambda n: abs((eps * second @ tried[n] - found[n][0] + target) @ step))
        h, (totals, moments, most) = tried[best], found[best]
    raise RuntimeError(f"no least-squares rates after {PASSES} passes: {gap} from the targets, excess up to {excess}")


def fit_rates(scored: DataFrame, targets: list[float], tolerance: float = TOLERANCE) -> tuple[Column, list[float]]:
    """The rate of a row of ``scored`` (n_tokens, p) as a column, and the token totals it leads to.

    ``targets`` are tokens per domain.  Targets that no rates can reach are met in the least-squares sense, which may leave
    few documents with high rates.  Without tokens every rate is 1.
    """
    k = len(targets)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    t = F.col("n_tokens").cast("double")
    moments = scored.agg(F.sum(t).alias("t"), *[F.sum(t * p[i] * p[j]).alias(f"m{i}{j}") for i in range(k) for j in range(k)]).first()
    total = moments.t or 0.0
    if not total:
        return F.lit(1.0), [0.0] * k
    second = np.array([[moments[f"m{i}{j}"] / total for j in range(k)] for i in range(k)]) + 1e-6 * np.eye(k)
    target = np.array(targets) / total
    taken, totals, met = _projected(scored, total, target, second, tolerance)
    if met:
        return _rate(taken), list(totals * total)
    h, totals = _multipliers(scored, total, target, second, tolerance)
    return _multiplied(h), list(totals * total)


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], carry: list[str] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``carry`` columns of every row (all by default), n_tokens, p_<domain> and ``rate``; and two figures of the whole mixture.

    ``weights`` are shares of all tokens by domain.  ``target_gap`` is the largest share of all tokens by which a domain's total
    misses its target, and ``effective_share`` how many tokens of equal rate the mixture is worth, as a share of all tokens:
    (sum of r t)^2 / (sum of r^2 t * sum of t); both are null without tokens.  A null text has no tokens and the rate of its probabilities; repeated rows
    have equal rates; an empty table gives no rows.  Columns of ``docs`` that carry a name made here are replaced.
    """
    domains = tuple(weights)
    made = {"n_tokens", "rate", "target_gap", "effective_share", *[f"p_{d}" for d in domains]}
    own = [c for c in carry or docs.columns if c not in made]
    scored = cut(with_posteriors(docs, fit_classifier(docs, labelled, domains, fit_rows), domains, own))
    total = scored.agg(F.sum("n_tokens")).first()[0] or 0
    targets = [weights[d] * total for d in domains]
    rate, totals = fit_rates(scored, targets)
    gap, effective = None, None
    if total:
        gap = max(abs(a - b) for a, b in zip(totals, targets)) / total
        used = scored.select(F.col("n_tokens").alias("t"), rate.alias("r")).agg(F.expr("sum(r * t)").alias("a"), F.expr("sum(r * r * t)").alias("b")).first()
        effective = used.a**2 / (used.b * total) if used.b else 0.0
    return scored.select(
        "doc.*", "n_tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)], rate.alias("rate"),
        F.lit(gap).cast("double").alias("target_gap"), F.lit(effective).cast("double").alias("effective_share"),
    )


def without_domain(docs: DataFrame, labelled: DataFrame, unwanted: str = "toxic", domains: tuple[str, ...] = DOMAINS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` mixed so that the tokens of one domain go and those of all others stay as they are.

    The targets are the totals of the documents in which the unwanted domain is less likely than not; a document appears as
    often as its rate says, rounded to the nearest whole number.
    """
    scored = cut(with_posteriors(docs, fit_classifier(docs, labelled, domains, fit_rows), domains))
    unlikely = F.get("p", F.lit(domains.index(unwanted))) < 0.5
    totals = scored.where(unlikely).agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(k))) for k in range(len(domains))]).first()
    rate, _ = fit_rates(scored, [x or 0.0 for x in totals])
    times = F.floor(rate + 0.5).cast("int")
    return scored.withColumn("times", times).where("times > 0").select("doc", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("doc.*")
