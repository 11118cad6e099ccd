import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from assay.functions.hashing import digest
from assay.operators import features as ft
from assay.operators import models as md
from assay.operators.metrics import evaluate
from assay.plans.training import Verifier, VerifierOptions, fit_verifier
from assay.session import scratch_path

TOPICS = ["good honest true record of facts", "bad false wild rumor of lies"]


@pytest.fixture(scope="module")
def claims(spark):
    rows = [
        (i, f"{TOPICS[i % 2]} number{i % 5} case", ["ann", "bob", ""][i % 3], ["tax", None][i % 2], 1 - i % 2)
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "claim_id long, claim string, speaker string, subject string, label int").cache()


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("of", ["from"]), ("case", ["matter"])], "word string, candidates array<string>")


QUICK = VerifierOptions(max_terms=200, iterations=(20,), hidden=(8,), lr_iterations=50)


def test_end_to_end_save_and_load(spark, claims, lexicon):
    train, val = claims.where("claim_id < 40"), claims.where("claim_id >= 40")
    evidence = spark.createDataFrame([(1, ["some evidence"])], "claim_id long, passages array<string>")
    fitted = fit_verifier(train, val, QUICK, evidence, lexicon)
    assert fitted.options.weight in (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35)
    rows = fitted.predict(val).orderBy("claim_id").collect()
    assert len(rows) == 20 and all(r.p_fake + r.p_real == pytest.approx(1.0) for r in rows)
    assert all(r.evidence_mode == "none" for r in rows)
    assert evaluate(fitted.predict(val)).first()["accuracy"] > 0.9
    path = scratch_path(spark, "saved")
    fitted.save(path)
    loaded = Verifier.load(path)
    assert loaded.options == fitted.options
    assert [(r.claim_id, r.p_real) for r in loaded.predict(val).orderBy("claim_id").collect()] == [(r.claim_id, r.p_real) for r in rows]


def test_without_ensemble(spark, claims):
    train, val = claims.where("claim_id < 40"), claims.where("claim_id >= 40")
    options = VerifierOptions(augmentation="none", use_ensemble=False, use_speaker=False, evidence_fusion="vector", iterations=(20,), hidden=(8,))
    fitted = fit_verifier(train, val, options)
    assert fitted.tfidf is None and len(fitted.history) == 1
    assert {"p_fake", "p_real", "pred"} <= set(fitted.predict(val).columns)


def test_speaker_changes_the_vector(claims):
    rows = claims.withColumn("passages", F.array().cast("array<string>")).limit(3)
    with_speaker = {r.claim_id: r.vector for r in ft.input_vectors(rows, True).collect()}
    without = {r.claim_id: r.vector for r in ft.input_vectors(rows, False).collect()}
    assert all(len(x) == 384 for x in with_speaker.values())
    assert all(with_speaker[i] != without[i] for i in without)


def test_no_evidence_keeps_the_claim_vector(spark):
    rows = spark.createDataFrame(
        [(1, "a claim here", "", "", ["one passage", "two passage"]), (2, "a claim here", "", "", [])],
        "claim_id long, claim string, speaker string, subject string, passages array<string>",
    )
    got = {r.claim_id: r.vector for r in ft.input_vectors(rows, False, "vector").collect()}
    plain = ft.hashed_vectors(spark.createDataFrame([("a claim here",)], "text string")).first()["vector"]
    assert got[2] == plain and got[1] != plain


def test_plugged_in_encoder(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "abcdef")], "claim_id long, text string")
    got = {r.claim_id: r.vector for r in ft.encoded_vectors(rows, load, batch=1).collect()}
    assert got == {1: [3.0, 1.0], 2: [6.0, 1.0]}


def test_ml_stages_equal_the_long_form(spark, claims):
    texts = claims.select("claim_id", F.col("claim").alias("text"))
    counts = ft.gram_counts(texts)
    vocab = ft.vocabulary(counts, 25)
    n = texts.agg(F.count("*").alias("n")).scalar()
    long = {}
    for r in ft.tfidf(counts, vocab, n).collect():
        long.setdefault(r.claim_id, []).append(round(r.weight, 9))
    out = Pipeline(stages=ft.tfidf_stages(texts, ft.TfidfOptions(max_terms=25))).fit(texts).transform(texts)
    for r in out.select("claim_id", "tfidf").collect():
        assert sorted(round(float(x), 9) for x in r.tfidf.values) == sorted(long[r.claim_id])


def test_ngrams(spark):
    from assay.functions.text import ngrams

    row = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>").select(ngrams(F.col("t"), 1, 3).alias("g")).first()
    assert row["g"] == ["a", "b", "c", "a b", "b c", "a b c"]


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_rank_does_not_depend_on_buckets(spark, digits):
    rows = spark.range(500).withColumnRenamed("id", "claim_id")
    ranked = md.hash_rank(rows, digest(F.col("claim_id")), digits=digits).collect()
    import hashlib

    want = sorted(range(500), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [r.claim_id for r in sorted(ranked, key=lambda r: r.pos)] == want


def test_balanced(spark):
    rows = spark.createDataFrame([(i, 1 if i % 5 else 0) for i in range(200)], "claim_id long, label int")
    out = md.balanced(rows).collect()
    assert sum(r.label == 1 for r in out) == sum(r.label == 0 for r in out) == 40
    assert len({(r.label, r.draw) for r in out}) == 80


def test_folds_hold_both_classes(spark):
    rows = spark.createDataFrame([(i, int(i % 15 == 0)) for i in range(200)], "claim_id long, label int")
    dealt = md.stratified_folds(rows, 5).collect()
    sizes = {(y, f): sum(r.label == y and r.fold == f for r in dealt) for y in (0, 1) for f in range(5)}
    assert len(dealt) == 200 and {r.claim_id for r in dealt} == set(range(200))
    assert all(sizes[1, f] in (2, 3) and sizes[0, f] in (37, 38) for f in range(5))
    assert {(r.claim_id, r.fold) for r in dealt} == {(r.claim_id, r.fold) for r in md.stratified_folds(rows.repartition(7), 5).collect()}


def test_calibrated_svm(claims):
    rows = ft.hashed_vectors(claims.withColumn("text", F.col("claim"))).drop("text")
    model = md.fit_calibrated_svm(rows, "vector", folds=2, max_iter=10)
    out = model.probabilities(rows, "vector").collect()
    assert len(model.members) == 2 and all(0.0 <= r.p_real <= 1.0 for r in out)
    assert sum(r.pred == r.label for r in out) > 50


def test_svm_folds_have_few_partitions(claims, monkeypatch):
    """Each iteration is a job with a task for every partition: dealing rows to folds must not leave hundreds."""
    from pyspark.ml.classification import LinearSVC

    rows, seen, plain = ft.hashed_vectors(claims.withColumn("text", F.col("claim"))).drop("text"), [], LinearSVC.fit
    monkeypatch.setattr(LinearSVC, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), plain(self, df))[1])
    md.fit_calibrated_svm(rows, "vector", folds=2, max_iter=2)
    assert len(seen) == 2 and max(seen) <= rows.sparkSession.sparkContext.defaultParallelism


def test_balanced_logistic(spark):
    rows = spark.createDataFrame([(i, [float(i % 10 == 0), 1.0], int(i % 10 == 0)) for i in range(100)], "claim_id long, vector array<double>, label int")
    model = md.fit_logistic(rows, "vector", c=1.0, balance=True)
    assert evaluate(md.probabilities(model, rows, "vector")).first()["f1_macro"] == 1.0


def test_hash_split_is_stable(claims):
    first = {r.claim_id: r.fold for r in md.hash_split(claims).collect()}
    assert first == {r.claim_id: r.fold for r in md.hash_split(claims.repartition(7)).collect()}
    assert set(first.values()) == {"train", "val"}


@pytest.mark.parametrize("speaker,subject,blank,text", [
    ("Bob", "tax", "unknown", "[Bob] [tax] c"), (None, " ", "unknown", "[unknown] [unknown] c"), (" Bob ", "", None, "[ Bob ] [] c"),
])
def test_context_text(spark, speaker, subject, blank, text):
    df = spark.createDataFrame([("c", speaker, subject)], "claim string, speaker string, subject string")
    got = df.select(ft.context_text(F.col("claim"), F.col("speaker"), F.col("subject"), blank).alias("t")).first()["t"]
    assert got == text


def test_model_text_takes_three_passages(spark):
    df = spark.createDataFrame([("c", ["a", "b", "d", "e"]), ("c", []), ("c", [" "])], "claim string, passages array<string>")
    got = [r.t for r in df.select(ft.model_text(F.col("claim"), F.col("passages")).alias("t")).collect()]
    assert got == ["c [SEP] a b d", "c", "c"]


def test_ml_stages_refuse_damped_counts(spark):
    from assay.operators.features import TfidfOptions, tfidf_stages

    with pytest.raises(ValueError):
        tfidf_stages(spark.createDataFrame([(1, "a b")], "claim_id long, text string"), TfidfOptions(sublinear=True))


def _vectors(spark, n=60):
    rows = [(i, i % 2, [float((i * 7 + d * 3) % 11) / 11 + (i % 2) * 0.4 * (d % 2) for d in range(6)]) for i in range(n)]
    return spark.createDataFrame(rows, "claim_id long, label int, vector array<float>")


def test_selection_is_one_run(spark, monkeypatch):
    """Steps go on from the weights before, so the iterations add up to the last count, and the best state is kept."""
    rows, calls = _vectors(spark), []
    plain = md._fit_layers

    def watched(x, layers, max_iter, seed, before=None):
        model = plain(x, layers, max_iter, seed, before)
        calls.append((max_iter, before, model))
        return model

    monkeypatch.setattr(md, "_fit_layers", watched)
    chosen = md.select_mlp(rows, rows, iterations=(2, 5, 9), patience=3, hidden=(4,))
    assert [n for n, _, _ in calls] == [2, 3, 4]
    assert calls[0][1] is None and [b for _, b, _ in calls[1:]] == [m for _, _, m in calls[:-1]]
    assert [h["max_iter"] for h in chosen.history] == [2, 5, 9]
    losses = [h["loss"] for h in chosen.history]
    assert losses == sorted(losses, reverse=True)
    best = max(chosen.history, key=lambda h: (h["f1_macro"], -h["step"]))
    assert chosen.max_iter == best["max_iter"] and chosen.model is calls[best["step"] - 1][2]
    with pytest.raises(ValueError):
        md.select_mlp(rows, rows, iterations=(5, 5), hidden=(4,))


def test_runs_share_what_they_have_in_common(spark, sf_dir, monkeypatch):
    """Each row of the matrix equals the run fitted alone; perceptrons, text models and vectors are made once."""
    from dataclasses import replace

    from assay.operators.metrics import evaluate
    from assay.plans import experiments, training
    from assay.plans.catalog import _verifier_inputs

    made = {"mlp": 0, "lr": 0}
    for name, function in (("mlp", "select_mlp"), ("lr", "fit_logistic")):
        plain = getattr(md, function)
        monkeypatch.setattr(md, function, lambda *a, plain=plain, name=name, **k: (made.__setitem__(name, made[name] + 1), plain(*a, **k))[1])
    train, val, test, evidence, lexicon = _verifier_inputs(spark, sf_dir)
    configs = {k: experiments.ABLATIONS[k] for k in ("full", "no_speaker", "no_ensemble")}
    base = replace(QUICK, hidden=(4,))
    got = {(r.model, r.seed): r for r in experiments.ablations(train, val, test, evidence, lexicon, configs, (1, 2), base).collect()}
    assert set(got) == {(c, s) for c in configs for s in (1, 2)}
    assert made == {"mlp": 4, "lr": 2}
    for name, changes in configs.items():
        options = replace(base, seed=2, **changes)
        alone = training.fit_verifier(train, val, options, evidence, lexicon)
        want = evaluate(alone.predict(test, evidence)).first()
        row = got[name, 2]
        assert row.ensemble_weight == alone.options.weight and row.use_speaker == options.use_speaker and row.use_ensemble == options.use_ensemble
        assert (row.test_acc, row.test_f1_macro) == pytest.approx((want.accuracy, want.f1_macro))


def test_iterations_have_a_task_for_each_core():
    assert [md.training_tasks(n << 20, 12) for n in (0, 1, 5, 40, 100, 768, 769, 10_000)] == [1, 1, 2, 10, 12, 12, 24, 168]


@pytest.mark.parametrize("fit", ["select_mlp", "fit_logistic"])
def test_training_rows_are_dealt_evenly(spark, monkeypatch, fit):
    """A table in one file keeps one core busy unless its rows are dealt to tasks, each with its share."""
    from pyspark.ml import Estimator

    seen, plain = [], Estimator.fit

    def watched(self, rows, *more):
        sizes = rows.groupBy(F.spark_partition_id()).count().collect()
        seen.append(sorted(r["count"] for r in sizes))
        return plain(self, rows, *more)

    monkeypatch.setattr(Estimator, "fit", watched)
    monkeypatch.setattr(md, "SPARSE_BYTES", 1 << 14)
    rows = spark.range(3000).coalesce(1).select(
        F.col("id").alias("claim_id"), (F.col("id") % 2).cast("int").alias("label"), F.array_repeat(F.col("id") / 3000, 400).alias("vector")
    )
    if fit == "select_mlp":
        md.select_mlp(rows, rows.limit(10), iterations=(1,), hidden=(2,))
    else:
        md.fit_logistic(rows, "vector", max_iter=1)
    (sizes,) = seen
    assert len(sizes) > 1 and sizes[-1] < 2 * sizes[0]


def test_baselines_grade_the_text_model_once(spark, sf_dir, monkeypatch):
    """The text model has no seed: its predictions are made once, and its rows stand once per seed."""
    from assay.plans import experiments
    from assay.plans.catalog import _verifier_inputs

    train, val, test, _, _ = _verifier_inputs(spark, sf_dir)
    seen, plain = [], md.probabilities
    monkeypatch.setattr(md, "probabilities", lambda model, rows, features: (seen.append(features), plain(model, rows, features))[1])
    found = experiments.baselines(train, val, test, seeds=(1, 2), max_terms=50, iterations=(1,), lr_iterations=2).collect()
    assert seen.count("tfidf") == 2
    assert [(r.model, r.seed) for r in found] == [("tfidf_lr", 1), ("vectors_mlp", 1), ("tfidf_lr", 2), ("vectors_mlp", 2)]
    assert found[0][2:] == found[2][2:]
