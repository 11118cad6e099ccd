"""Context-tree weighting, quality rules and mixing against brute force and held-out rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm.ctw import log_gamma, score_documents
from assay.llm.mixing import DOMAINS, _projected, fit_classifier, fit_rates, label_domains, mixing_rates, with_posteriors, without_domain
from assay.llm.quality import BROAD, FLOORS, STATS, judged, measured, robust_estimates, without_rejected
from tests.llm.cases import no_documents, odd_documents, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 9.5, 1e3, 1e9])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def tree_scores(docs, held):
    """log10 probability of every text by the definition of context-tree weighting."""
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        data = b"\xff" * 5 + text + b"\xff"
        for at in range(5, len(data)):
            node = 1
            for i in range(8):
                bit = data[at] >> (7 - i) & 1
                yield data[at - 5 : at], node, bit
                node = 2 * node + bit

    for text, out in zip(docs, held):
        for context, node, bit in () if out else steps(text):
            for d in range(6):
                counts[node, context[5 - d :]][bit] += 1
    children = defaultdict(list)
    for node, context in counts:
        if context:
            children[node, context[1:]].append((node, context))

    def own(key):
        a, b = counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(key):
        if len(key[1]) == 5:
            return own(key)
        return math.log(0.5) + np.logaddexp(own(key), sum(map(weighted, children[key])))

    @lru_cache(None)
    def one(node, context, d=0):
        key = (node, context[5 - d :])
        if key not in counts:
            return 0.5
        a, b = counts[key]
        kt = (b + 0.5) / (a + b + 1)
        if d == 5:
            return kt
        w = math.exp(math.log(0.5) + own(key) - weighted(key))
        return w * kt + (1 - w) * one(node, context, d + 1)

    return [sum(math.log10(one(n, c) if bit else 1 - one(n, c)) for c, n, bit in steps(t)) for t in docs]


@pytest.mark.parametrize("tables", [(6_000_000, 400_000), (40, 5)])
def test_scores(spark, tables):
    docs = odd_documents(spark).where(F.coalesce(F.length("text"), F.lit(0)) < 2000)
    rows = [(k, t.encode().lower()) for k, t in rows_of(docs)]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1 for k, _ in rows]
    words = Counter(w for (_, t), out in zip(rows, held) if not out for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)
    got = sorted(map(tuple, score_documents(docs, *tables).drop("bits_per_byte", "n_bytes").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    want = []
    for (k, t), out, score in zip(rows, held, tree_scores([t for _, t in rows], held)):
        tokens = [*t.split(), None]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((k, out, len(tokens), sum(words[w] > 0 for w in tokens), n, base, score))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_scores_of_nothing(spark):
    assert score_documents(no_documents(spark)).count() == 0


def base_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    docs = odd_documents(spark)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged(docs, carry=["doc_id"]).collect())
    want = Counter()
    for k, t in rows_of(docs):
        c = base_counts(t)
        want[k, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]] += 1
    assert got == want


def test_small_groups_are_judged_by_the_base_rule(spark):
    docs = odd_documents(spark)
    kept = without_rejected(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, t in rows_of(docs) if base_counts(t)[0] >= 50 and 2 * base_counts(t)[4] <= base_counts(t)[0])
    assert judged(no_documents(spark)).count() == 0


def test_outliers_are_found(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(1200):
        words = list(rng.choice(vocabulary, rng.integers(60, 400)))
        if i % 10 == 0:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en", "s0" if i % 3 else f"s{i}"))
    got = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: i % 10 > 0 for i in range(1200)}


def test_rare_languages_and_sources_are_judged(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(2000)]
    rows = []
    for i in range(800):
        words = list(rng.choice(vocabulary, rng.integers(60, 300)))
        if i % 20 == 0:
            words = [w + "$$$" for w in words]
        # a language of 100 rows, one large source, and a source of 100 rows in the large language
        rows.append((i, " ".join(words), "fr" if i < 100 else "en", "s1" if i < 200 else "s0"))
    got = {r.doc_id: (r.kept, r.distance) for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: i % 20 > 0 for i in range(800)}
    assert all(d is not None for _, d in got.values())


def test_estimates_find_the_clean_part(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5)) @ np.diag([0.5, 1, 1, 0.7, 0.6])
    x[:, 1] += 0.8 * x[:, 0]
    x[:600] += 12
    df = spark.createDataFrame([("=en", "=s", *map(float, r)) for r in x], "lang string, pool string, " + ", ".join(f"{s} double" for s in STATS))
    got = robust_estimates(df).first()
    clean = x[600:]
    assert got.n == 4000 and np.abs(np.array([got[f"m{k}"] for k in range(5)]) - clean.mean(0)).max() < 0.1
    ratio = np.array([got[f"v{i}{i}"] for i in range(5)]) / (np.diag(np.cov(clean.T)) + [f**2 for f in FLOORS.values()])
    assert 0.8 < ratio.min() and ratio.max() < 1.6 and ratio.max() / ratio.min() < 1.4


def plain_estimates(x):
    """The estimates of one group in numpy: (n, start, centre, covariance)."""
    n, floors = len(x), np.array(list(FLOORS.values()))
    at = lambda bins, share: np.sort(bins, axis=0)[int(np.ceil(n * share)) - 1]
    bins = np.floor(x * 200 + 0.5)
    m, s = at(bins, 0.5) / 200, np.sqrt(((at(bins, 0.75) - at(bins, 0.25)) / 200 / 1.349) ** 2 + floors**2)
    z = (x - m) / s
    length = np.sqrt((z**2).sum(1, keepdims=True))
    signs = np.where(length > 0, z / np.where(length > 0, length, 1), 0)
    shapes = [np.eye(5), signs.T @ signs / n * 5, np.tanh(z).T @ np.tanh(z) / n]

    def distance_bins(m, c):
        low = np.linalg.cholesky(c + np.diag(floors**2))
        return np.floor(np.log((np.linalg.solve(low, (x - m).T) ** 2).sum(0) + 1e-6) * 50)

    ends = []
    for start, shape in enumerate(shapes):
        centre, c = m, shape * np.outer(s, s)
        for _ in range(6):
            d = distance_bins(centre, c)
            inner = x[d <= at(d, 0.75)]
            centre, c = inner.mean(0), np.cov(inner.T, ddof=0)
        volume = np.log(np.diag(np.linalg.cholesky(c + np.diag(floors**2)))).sum()
        ends.append((round(volume, 9), start, centre, c))
    _, start, centre, c = min(ends, key=lambda e: e[:2])
    scale = max(np.exp((at(distance_bins(centre, c), 0.5) + 1) / 50) / 4.351460191096, 1.0)
    return n, start, centre, (c + np.diag(floors**2)) * scale


def test_verdicts_match_numpy(spark, sf_dir):
    """Estimates of sources, languages and table, their weights, and the distance of every document, with small and single groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = measured(docs.select("doc_id", "text", "lang", "source")).drop("text").toPandas()
    x, passed = rows[list(STATS)].to_numpy(), ~rows.base_failed.to_numpy()
    lang, source = rows.lang.fillna("").to_numpy(), rows.source.fillna("").to_numpy()

    def drawn(of, wider):
        w = of[0] / (of[0] + 200)
        return w * of[2] + (1 - w) * wider[0], w * of[3] + (1 - w) * wider[1]

    table = plain_estimates(x[passed])
    table = drawn(table, (table[2], np.diag([b**2 for b in BROAD.values()])))
    want, starts = {}, set()
    for a in set(lang):
        mine = (lang == a) & passed
        if not mine.any():
            continue
        by_lang = drawn(plain_estimates(x[mine]), table)
        for b in set(source[mine]):
            group = (lang == a) & (source == b)
            own = plain_estimates(x[group & passed])
            starts.add(own[1])
            centre, c = drawn(own, by_lang)
            low = np.linalg.cholesky(c)
            for i in np.nonzero(group)[0]:
                want[rows.doc_id[i]] = (np.linalg.solve(low, x[i] - centre) ** 2).sum()
    got = {r.doc_id: (r.distance, r.kept, r.base_failed) for r in judged(docs, carry=["doc_id"]).collect()}
    assert len(starts) > 1 and len(got) == len(rows)
    for k, (d, kept, failed) in got.items():
        assert (d is None) == (k not in want) and (d is None or math.isclose(d, want[k], rel_tol=1e-5, abs_tol=1e-7))
        assert kept == (not failed and (d is None or d <= 40))


def labelled(spark, n=1500):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        kind = i % 3
        words = [f"w{k}" for k in rng.integers(0, 400, rng.integers(20, 200))]
        if kind:
            words[:: 9] = [("bad", "vile")[k % 2] if kind == 2 else "|" for k in range(len(words[::9]))]
        rows.append((i, " ".join(words), 1.0))
        if i % 2:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, p double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_posteriors_of_unlabelled_documents(spark):
    docs, labels = labelled(spark)
    model = fit_classifier(docs, label_domains(labels))
    rows = with_posteriors(docs, model, carry=["doc_id"]).select("doc.doc_id", "p").collect()
    right = [int(np.argmax(r.p)) == (0, 1, 2)[r.doc_id % 3] for r in rows if r.doc_id % 2 == 0]
    assert np.mean(right) > 0.98


def test_rates_meet_targets(spark):
    docs, labels = labelled(spark)
    rows = mixing_rates(docs, label_domains(labels), {"good": 0.5, "poor": 0.45, "toxic": 0.05}).toPandas()
    totals = np.array([(rows.n_tokens * rows.rate * rows[f"p_{d}"]).sum() for d in DOMAINS]) / rows.n_tokens.sum()
    gap = np.abs(totals - [0.5, 0.45, 0.05]).max()
    assert gap < 1e-5 + 1e-9 and (rows.rate >= 0).all() and np.allclose(rows.target_gap, gap)
    used = rows.rate * rows.n_tokens
    assert np.allclose(rows.effective_share, used.sum() ** 2 / (used * rows.rate).sum() / rows.n_tokens.sum())


@pytest.mark.parametrize("targets,within", [([0.2, 0.15, 0.65], True), ([0.9, 0.0, 0.2], False)])
def test_rates_follow_the_gradient_steps(spark, targets, within):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([1, 1, 1], 300)
    t = rng.integers(1, 100, 300)
    scored = spark.createDataFrame([(int(a), list(map(float, b))) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    targets, share = np.array(targets), t / t.sum()
    second = (p * share[:, None]).T @ p + 1e-6 * np.eye(3)
    taken, totals, met = _projected(scored, t.sum(), targets, second, 1e-9)
    r, values = np.ones(300), []
    for u in taken:
        gap = (p * (share * r)[:, None]).sum(0) - targets
        values.append(gap @ np.linalg.inv(second) @ gap)
        moments = (p * (share * (r > 0))[:, None]).T @ p + 1e-6 * np.eye(3)
        assert np.allclose(moments @ u, gap)
        r = np.maximum(0, r - p @ u)
    assert np.allclose(totals, (p * (share * r)[:, None]).sum(0)) and (r == 0).any()
    assert met == within and values == sorted(values, reverse=True)
    assert len(taken) < 40 and (not within or np.abs(totals - targets).max() <= 1e-9)


@pytest.mark.parametrize("targets", [[0.9, 0.0, 0.2], [0.8, 0.2, 0.0], [0.3, 0.3, 0.4]])
def test_rates_minimise_the_squares(spark, targets):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([1, 1, 1], 300)
    t = rng.integers(1, 100, 300)
    scored = spark.createDataFrame([(int(a), list(map(float, b))) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    targets = np.array(targets) * t.sum()
    rate, totals = fit_rates(scored, list(targets))
    second = (p * t[:, None]).T @ p / t.sum()
    w, r = np.linalg.inv(second + 1e-6 * np.eye(3)), np.ones(300)
    for _ in range(20_000):
        r = np.maximum(0, r - p @ (w @ ((p * (t * r)[:, None]).sum(0) - targets) / t.sum()))
    value = lambda total: (g := (np.array(total) - targets) / t.sum()) @ w @ g
    assert value(totals) < value((p * (t * r)[:, None]).sum(0)) * 1.01 + 1e-9
    rates = np.array([x.r for x in scored.select(rate.alias("r")).collect()])
    assert (rates >= 0).all() and np.allclose((p * (t * rates)[:, None]).sum(0), totals)


def test_unwanted_domain_goes(spark):
    docs, labels = labelled(spark)
    kept = without_domain(docs, label_domains(labels))
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and set(ids.values()) == {1}
    assert len([i for i in ids if i % 3 == 2]) <= 10 and len([i for i in ids if i % 3 < 2]) >= 990


def test_mixing_without_labels(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing_rates(docs, label_domains(none), {"good": 0.5, "toxic": 0.5}, ["doc_id"]).collect()
    assert len(rows) == docs.count() and all(abs(r.rate - 1) < 1e-6 and r.p_good == 0.5 for r in rows)
    assert without_domain(docs, label_domains(none)).count() == docs.count()
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert mixing_rates(no_documents(spark), label_domains(nulls), {"good": 1.0, "toxic": 0.0}).count() == 0
