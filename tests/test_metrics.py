import itertools
import math

import pytest
from pyspark.sql import functions as F

from assay.functions.stats import normal_upper, t_quantile_975, t_two_sided
from assay.operators import metrics as mt
from assay.operators import reports as rp

SCHEMA = "claim_id long, label int, pred int"


def predictions(spark, pairs):
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(pairs)], SCHEMA)


def test_scores(spark):
    row = mt.evaluate(predictions(spark, [(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)])).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (2, 1, 1, 1)
    assert row.accuracy == 0.6 and row.f1_real == pytest.approx(2 / 3) and row.f1_fake == 0.5


@pytest.mark.parametrize("pairs,fake,real", [
    ([(1, 1), (0, 1)], 0.0, 2 / 3),  # class 0 never predicted
    ([(1, 1), (1, 1)], 0.0, 1.0),  # class 0 absent
    ([(0, 1), (1, 0)], 0.0, 0.0),
])
def test_empty_denominators(spark, pairs, fake, real):
    row = mt.evaluate(predictions(spark, pairs)).first()
    assert row.f1_fake == fake and row.f1_real == pytest.approx(real)


def test_report_of_an_absent_class(spark):
    rows = {r["class"]: r for r in mt.class_report(predictions(spark, [(1, 1), (1, 0)])).collect()}
    assert rows["FAKE"].support == 0 and rows["FAKE"].recall == 0.0
    assert rows["weighted avg"].recall == 0.5


def test_class_weights(spark):
    rows = {r.label: r.weight for r in mt.class_weights(predictions(spark, [(1, 1), (1, 0), (1, 0), (0, 0)])).collect()}
    assert rows == {0: 2.0, 1: pytest.approx(4 / 6)}
    only = {r.label: r.weight for r in mt.class_weights(predictions(spark, [(1, 1)])).collect()}
    assert only == {0: 0.5, 1: 0.5}


def probability(spark, rows):
    return spark.createDataFrame([(i, y, 1.0 - p, p) for i, (y, p) in enumerate(rows)], "claim_id long, label int, p_fake double, p_real double")


def test_blend_ends_and_tie(spark):
    a, b = probability(spark, [(1, 0.25), (0, 0.5)]), probability(spark, [(1, 0.75), (0, 0.5)])
    assert [r.p_real for r in mt.blend(a, b, 0.0).orderBy("claim_id").collect()] == [0.25, 0.5]
    assert [r.p_real for r in mt.blend(a, b, 1.0).orderBy("claim_id").collect()] == [0.75, 0.5]
    half = mt.blend(a, b, 0.5).orderBy("claim_id").collect()
    assert [r.pred for r in half] == [0, 0] and all(r.p_fake + r.p_real == pytest.approx(1.0) for r in half)


def test_equal_weights_keep_the_smallest(spark):
    a, b = probability(spark, [(1, 0.9), (0, 0.1)]), probability(spark, [(1, 0.8), (0, 0.2)])
    graded = mt.weight_scores(a, b)
    assert graded.count() == len(mt.BLEND_WEIGHTS) and mt.best_weight(graded).first()["weight"] == 0.05


def test_grid_equals_single_blends(spark):
    a = probability(spark, [(i % 2, (i * 37 % 100) / 100) for i in range(80)])
    b = probability(spark, [(i % 2, (i * 53 % 100) / 100) for i in range(80)])
    grid = {r.weight: r.f1_macro for r in mt.weight_scores(a, b).collect()}
    for w in mt.BLEND_WEIGHTS:
        assert mt.evaluate(mt.blend(a, b, w)).first()["f1_macro"] == grid[w]


def evaluate_column(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("t,p", [(-1.365, 0.2441), (-0.917, 0.4109), (-5.005, 0.0075), (-3.206, 0.0327), (11.186, 0.0004)])
def test_t_distribution_published_values(spark, t, p):
    assert evaluate_column(spark, t_two_sided(F.lit(t), F.lit(4))) == pytest.approx(p, abs=2e-4)


@pytest.mark.parametrize("df,quantile", [(1, 12.7062), (2, 4.30265), (3, 3.18245), (4, 2.77645), (9, 2.26216), (30, 2.04227)])
def test_t_quantile(spark, df, quantile):
    assert evaluate_column(spark, t_quantile_975(F.lit(df))) == pytest.approx(quantile, abs=1e-4)


@pytest.mark.parametrize("z", [-2.5, 0.0, 0.3, 1.96, 2.99, 3.01, 6.0])
def test_normal_tail(spark, z):
    assert evaluate_column(spark, normal_upper(F.lit(z))) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def pairs(spark, a, b):
    return spark.createDataFrame([("m", i, x, y) for i, (x, y) in enumerate(zip(a, b))], "model string, seed int, a double, b double")


def test_archived_three_seed_test(spark):
    full = [0.619327709299391, 0.5981927250496715, 0.6118163375150085]
    naive = [0.6098245054752378, 0.6158345411357369, 0.6107378630916107]
    row = rp.paired_ttest(pairs(spark, full, naive), "model").first()
    assert row.t == pytest.approx(-0.2934, abs=1e-4) and row.p_two_sided == pytest.approx(0.797, abs=1e-3)
    assert row.p_one_sided == 1.0


def test_equal_differences_have_no_t(spark):
    row = rp.paired_ttest(pairs(spark, [0.5, 0.5], [0.25, 0.25]), "model").first()
    assert row.t is None and row.p_one_sided is None


def test_wilcoxon_exact(spark):
    row = rp.wilcoxon(pairs(spark, [0.9, 0.8, 0.7, 0.95, 0.6], [0.5, 0.45, 0.5, 0.4, 0.5]), "model").first()
    assert row.w_minus == 0 and row.p_one_sided == pytest.approx(1 / 32)
    same = rp.wilcoxon(pairs(spark, [0.5, 0.75], [0.25, 0.5]), "model").first()
    assert same.p_one_sided is None
    worse = rp.wilcoxon(pairs(spark, [0.1, 0.2], [0.5, 0.9]), "model").first()
    assert worse.p_one_sided == 1.0


def enumerated(d):
    """One-sided p-value over all sign patterns of the mean ranks of the differences other than zero."""
    d = [x for x in d if x]
    ranks = [sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d]
    smaller = min(sum(r for x, r in zip(d, ranks) if x > 0), sum(r for x, r in zip(d, ranks) if x < 0))
    sums = [sum(r for r, up in zip(ranks, signs) if up) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(2 * sum(s <= smaller for s in sums) / len(sums), 1.0) / 2


@pytest.mark.parametrize("d", [
    [1, 1, -2, 3],
    [1, 1, 1, 1, -1],
    [0, 0, 3, 5, -4, 2],
    [2, -2, 2, -2, 4],
    [1, 2, 2, 3, 3, 3, -1, -4, 0, 9, 9, 12],
])
def test_wilcoxon_equals_all_sign_patterns(spark, d):
    row = rp.wilcoxon(pairs(spark, [float(x) for x in d], [0.0] * len(d)), "model").first()
    assert row.n == len(d) and row.n_ranked == sum(x != 0 for x in d)
    assert row.p_one_sided == pytest.approx(enumerated(d), rel=1e-12)


def test_wilcoxon_of_many_ranks(spark):
    """No number of ranks changes the form: 60 and 120 untied ranks against counts in whole numbers."""
    for n in (60, 120):
        d = [k if k % 3 else -k for k in range(1, n + 1)]
        smaller = sum(-x for x in d if x < 0)
        ways = [1] + [0] * smaller
        for r in range(1, n + 1):
            ways = [c + (ways[s - r] if s >= r else 0) for s, c in enumerate(ways)]
        row = rp.wilcoxon(pairs(spark, [float(x) for x in d], [0.0] * n), "model").first()
        assert row.p_one_sided == pytest.approx(sum(ways) / 2**n, rel=1e-12)


def test_wilcoxon_normal_form(spark):
    # Differences 1, 1, -2, 3: ranks 1.5, 1.5, 3, 4; W- = 3, mean 5, variance 7.5 - 6/48.
    row = rp.wilcoxon(pairs(spark, [1.0, 1.0, 0.0, 3.0], [0.0, 0.0, 2.0, 0.0]), "model", exact=False).first()
    z = 2.0 / math.sqrt(7.5 - 6 / 48)
    assert row.w_plus == 7.0 and row.w_minus == 3.0
    assert row.p_one_sided == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


RESULT = "model string, augmentation string, retrieve boolean, use_speaker boolean, use_ensemble boolean, seed int, test_acc double, test_f1_macro double, test_f1_fake double"


def test_report_filters_on_all_flags_and_skips_unequal_seeds(spark):
    runs = [("r", "synonym", True, True, True, s, 0.6, 0.60 + s / 100, 0.5) for s in (1, 2, 3)]
    runs += [("r", "synonym", True, False, True, s, 0.6, 0.9, 0.5) for s in (1, 2, 3)]  # must not count as complete
    base = [("good", s, 0.5 + s / 50) for s in (1, 2, 3)] + [("few", 1, 0.5)]
    report = rp.significance_report(
        spark.createDataFrame(runs, RESULT), spark.createDataFrame(base, "model string, seed int, test_f1_macro double")
    )
    rows = {r.model: r for r in report.collect()}
    assert rows["good"].n_full == 3 and rows["good"].mean_a == pytest.approx(0.62) and rows["good"].t is not None
    assert rows["few"].verdict.startswith("skipped") and rows["few"].p_one_sided is None


def test_both_deviations(spark):
    f1 = [0.60, 0.61, 0.63]
    rows = [("r", "none", True, True, True, i, 0.6, x, 0.5) for i, x in enumerate(f1)]
    row = rp.variant_summary(spark.createDataFrame(rows, RESULT)).first()
    mean = sum(f1) / 3
    total = sum((x - mean) ** 2 for x in f1)
    assert row.f1_macro_std_pop == pytest.approx(math.sqrt(total / 3)) and row.f1_macro_std_samp == pytest.approx(math.sqrt(total / 2))
    assert row.n_seeds == 3


def test_effect_size(spark):
    row = rp.with_effect(rp.paired_ttest(pairs(spark, [1.0, 2.0, 4.0], [0.0, 0.0, 1.0]), "model"), 5).first()
    assert row.cohens_d == pytest.approx(2.0) and row.alpha_corrected == 0.01
    assert row.ci_low == pytest.approx(2 - 4.302653 / math.sqrt(3), abs=1e-5)
    margin = evaluate_column(spark, rp.margin_of_error(F.lit(0.6306), F.lit(1267.0)))
    assert margin == pytest.approx(0.0266, abs=1e-4)


def test_mcnemar(spark):
    rows = [(i, "clean", 1, 1) for i in range(4)] + [(0, "x", 1, 1), (1, "x", 1, 0), (2, "x", 1, 0), (3, "x", 1, 0)]
    df = spark.createDataFrame(rows, "claim_id long, attack string, label int, pred int")
    row = mt.mcnemar(mt.paired_outcomes(df, "clean")).first()
    assert (row.both_right, row.only_base, row.only_variant, row.both_wrong) == (1, 3, 0, 0)
    assert row.statistic == pytest.approx(4 / 3)


def test_robustness_grades_predictions_once(spark):
    """Drops and tests on them read a small stored table; predictions are not made again for each side of a join."""
    from assay.plans.experiments import robustness

    rows = [(m, s, a, i, i % 2, (i + s) % 2 if a != "clean" else i % 2) for m in ("x", "y") for s in (1, 2) for a in ("clean", "p15") for i in range(4)]
    out = robustness(spark.createDataFrame(rows, "model string, seed int, attack string, claim_id int, label int, pred int"), within=("model", "seed"))
    assert "RDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.model, r.seed, r.attack): r.robustness_drop for r in out.collect() if r.attack != "clean"} == {
        (m, s, "p15"): pytest.approx(float(s % 2)) for m in ("x", "y") for s in (1, 2)
    }
