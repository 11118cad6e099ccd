"""Experiment reports: variants, paired tests, effect sizes.

Inputs are result tables with one row per model, configuration and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.stats import normal_upper, signed_rank_exact, t_quantile_975, t_two_sided
from assay.operators.metrics import ratio

FLAGS = ("augmentation", "retrieve", "use_speaker", "use_ensemble")


def variant_summary(results: DataFrame) -> DataFrame:
    """Seeds, mean and spread of macro F1, mean accuracy and mean fake F1 per configuration.

    Gives the population deviation and the sample deviation side by side.
    """
    return results.groupBy(*FLAGS).agg(
        F.count("*").alias("n_seeds"),
        F.avg("test_f1_macro").alias("f1_macro_mean"),
        F.stddev_pop("test_f1_macro").alias("f1_macro_std_pop"),
        F.stddev_samp("test_f1_macro").alias("f1_macro_std_samp"),
        F.avg("test_acc").alias("acc_mean"),
        F.avg("test_f1_fake").alias("f1_fake_mean"),
    )


def scores_per_model(results: DataFrame, model: str = "model", score: str = "test_f1_macro") -> DataFrame:
    """``(model, scores)`` with the scores in seed order."""
    packed = F.sort_array(F.collect_list(F.struct("seed", F.col(score).alias("score"))))
    return results.groupBy(model).agg(F.transform(packed, lambda s: s["score"]).alias("scores"))


def drop_over_seeds(drops: DataFrame, *by: str) -> DataFrame:
    """Mean and spread of the robustness drop over seeds."""
    return drops.groupBy(*by).agg(
        F.count("*").alias("n_seeds"),
        F.avg("drop").alias("drop_mean"),
        F.stddev_pop("drop").alias("drop_std_pop"),
        F.stddev_samp("drop").alias("drop_std_samp"),
    )


def full_runs(results: DataFrame) -> DataFrame:
    """Rows of the complete configuration: all four flags decide."""
    return results.where(
        F.col("retrieve") & F.col("use_speaker") & F.col("use_ensemble") & (F.col("augmentation") == "synonym")
    )


def paired(first: DataFrame, second: DataFrame, score: str = "score", *by: str) -> DataFrame:
    """Scores of two methods on the same seed: ``(<by>, seed, a, b)``."""
    a = first.select(*by, "seed", F.col(score).alias("a"))
    b = second.select(*by, "seed", F.col(score).alias("b"))
    return a.join(b, [*by, "seed"])


def paired_ttest(pairs: DataFrame, *by: str) -> DataFrame:
    """One-sided paired t-test of a > b per group.

    ``p_one_sided`` is half the two-sided value for positive t and 1 otherwise.
    """
    d = F.col("a") - F.col("b")
    moments = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg(d).alias("mean_d"),
        F.stddev_samp(d).alias("sd_d"),
    )
    t = F.when(F.col("sd_d") > 0, F.col("mean_d") / (F.col("sd_d") / F.sqrt(F.col("n").cast("double"))))
    tested = moments.withColumn("t", t).withColumn(
        "p_two_sided", F.when(F.col("n") > 1, t_two_sided(F.col("t"), F.greatest(F.col("n") - 1, F.lit(1))))
    )
    one = F.when(F.col("t") > 0, F.col("p_two_sided") / 2.0).when(F.col("t").isNotNull(), F.lit(1.0))
    return tested.withColumn("p_one_sided", one)


def drop_test(drops: DataFrame, first: str, second: str, by: str = "attack", clean: str = "clean", drop: str = "robustness_drop") -> DataFrame:
    """Paired t-test per attack, over seeds, of whether model ``first`` drops more than ``second``.

    ``drops(model, seed, <by>, <drop>)``; ``a`` and ``b`` of the test are the drops of the two models.
    """
    rows = drops.where(F.col(by) != clean)
    return paired_ttest(paired(rows.where(F.col("model") == first), rows.where(F.col("model") == second), drop, by), by)


def with_effect(tested: DataFrame, n_tests: Column | int, alpha: float = 0.05) -> DataFrame:
    """Add Cohen's d, the corrected threshold, the verdict under it and a 95 % interval of the mean."""
    n_tests = n_tests if isinstance(n_tests, Column) else F.lit(n_tests)
    half = t_quantile_975(F.greatest(F.col("n") - 1, F.lit(1))) * F.col("sd_d") / F.sqrt(F.col("n").cast("double"))
    return tested.withColumns(
        {
            "cohens_d": F.when(F.col("sd_d") > 0, F.col("mean_d") / F.col("sd_d")),
            "alpha_corrected": F.lit(alpha) / n_tests,
            "ci_low": F.col("mean_d") - half,
            "ci_high": F.col("mean_d") + half,
        }
    ).withColumn("significant_corrected", F.col("p_two_sided") < F.col("alpha_corrected"))


def margin_of_error(accuracy: Column, n: Column, z: float = 1.96) -> Column:
    """Half-width of the interval of one proportion."""
    return F.lit(z) * F.sqrt(accuracy * (1.0 - accuracy) / n)


def wilcoxon(pairs: DataFrame, *by: str, exact: bool = True) -> DataFrame:
    """One-sided Wilcoxon signed-rank test of a > b per group.

    Fewer than two distinct differences give a null p-value; a sum of differences
    of zero or less gives 1.  Zero differences are left out and ties share their
    mean rank.  The null distribution is that of the ranks at hand, whatever their
    number and ties; its work grows with the cube of the ranks of a group, which
    are the seeds of one comparison.  ``exact=False`` takes the normal distribution
    with tie correction for all groups instead.
    """
    d = pairs.select(*by, (F.col("a") - F.col("b")).alias("d"))
    whole = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("d").alias("distinct_d"), F.sum("d").alias("sum_d")
    )
    ties = d.where("d != 0").groupBy(*by, F.abs("d").alias("size")).agg(
        F.count("*").alias("members"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("positive")
    )
    before = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ties.withColumn("below", F.coalesce(F.sum("members").over(before), F.lit(0))).withColumn(
        "rank", F.col("below") + (F.col("members") + 1) / 2.0
    )
    m = F.col("members").cast("double")
    twice = F.array_repeat((2 * F.col("below") + F.col("members") + 1).cast("int"), F.col("members").cast("int"))
    sums = ranked.groupBy(*by).agg(
        F.sum("members").alias("n_ranked"),
        F.sum(F.col("rank") * F.col("positive")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("members") - F.col("positive"))).alias("w_minus"),
        F.sum(m * m * m - m).alias("tie_term"),
        *([F.flatten(F.collect_list(twice)).alias("doubled")] if exact else []),
    )
    joined = whole.join(sums, list(by), "left") if by else whole.withColumn("_one", F.lit(1)).join(
        sums.withColumn("_one", F.lit(1)), "_one", "left"
    ).drop("_one")
    w, n = F.least("w_plus", "w_minus"), F.col("n_ranked").cast("double")
    spread = F.sqrt(n * (n + 1.0) * (2.0 * n + 1.0) / 24.0 - F.col("tie_term") / 48.0)
    by_normal = F.least(2.0 * normal_upper(F.abs(w - n * (n + 1.0) / 4.0) / spread), F.lit(1.0))
    two = signed_rank_exact(F.col("doubled"), 2 * w) if exact else by_normal
    one = F.when(F.col("distinct_d") < 2, F.lit(None).cast("double")).when(F.col("sum_d") > 0, two / 2.0).otherwise(1.0)
    return joined.withColumn("p_one_sided", one).drop("tie_term", "doubled")


def significance_report(results: DataFrame, baselines: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The complete configuration against every baseline model, paired by seed.

    Unequal seed sets are reported with a note instead of a test.
    """
    full = full_runs(results).select("seed", F.col("test_f1_macro").alias("a"))
    base = baselines.select("model", "seed", F.col("test_f1_macro").alias("b"))
    n_full = full.agg(F.count("*").alias("n_full"))
    pairs = base.join(full, "seed")
    tested = paired_ttest(pairs, "model")
    seeds = base.groupBy("model").agg(F.count("*").alias("n_base")).withColumn("_one", F.lit(1))
    joined = seeds.join(n_full.withColumn("_one", F.lit(1)), "_one").drop("_one").join(tested, "model", "left")
    same = (F.col("n_base") == F.col("n_full")) & (F.col("n") == F.col("n_full"))
    verdict = F.when(~F.coalesce(same, F.lit(False)), F.lit("skipped: seed sets differ")).when(
        F.col("p_one_sided") < alpha, F.lit("SIGNIFICANT")
    ).otherwise(F.lit("NOT significant"))
    report = joined.withColumn("verdict", verdict)
    tests = ["n", "mean_a", "mean_b", "mean_d", "sd_d", "t", "p_two_sided", "p_one_sided"]
    for c in tests[3:]:
        report = report.withColumn(c, F.when(F.coalesce(same, F.lit(False)), F.col(c)))
    return report.select("model", "n_base", "n_full", *tests[1:], "verdict")
