"""The named queries: each takes a session and a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import text as tx
from assay.functions import vectors as vx
from assay.functions.hashing import digest, uniform
from assay.functions.uncertainty import FEATURES, with_budget
from assay.lexicons import LABEL_CLASS
from assay.operators import augment as aug
from assay.operators import dense as dn
from assay.operators import evidence as ev
from assay.operators import features as ft
from assay.operators import metrics as mt
from assay.operators import models as md
from assay.operators import reports as rp
from assay.operators import retrieval as rt
from assay.plans import views as v
from assay.session import cut, scratch_path, width
from assay.sources import claims as cl
from assay.sources import fever as fv
from assay.sources import results as rs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- Uncertainty -------------------------------------------------------------------------------


@query
def uncertainty_features(spark, sf_dir):
    scored = with_budget(v.claims(spark, sf_dir), v.HEDGE, v.VAGUE, keep_features=True)
    return scored.select("claim_id", *FEATURES, "uncertainty", "k")


@query
def uncertainty_builtin_words(spark, sf_dir):
    scored = with_budget(v.short_claims(spark, sf_dir), keep_features=True)
    return scored.select("claim_id", *FEATURES, "uncertainty", "k")


@query
def adaptive_k(spark, sf_dir):
    scored = with_budget(v.short_claims(spark, sf_dir), v.HEDGE, v.VAGUE, k_min=2, k_max=4)
    return scored.select("claim_id", "uncertainty", "k")


@query
def k_distribution(spark, sf_dir):
    scored = with_budget(v.claims(spark, sf_dir), v.HEDGE, v.VAGUE)
    return _rounded(ev.k_distribution(scored), "share")


# --- Retrieval ---------------------------------------------------------------------------------


@query
def keyword_query(spark, sf_dir):
    return rt.keyword_queries(v.claims(spark, sf_dir), v.STOPWORDS).select("claim_id", "query")


@query
def corpus_index(spark, sf_dir):
    return rt.postings(v.corpus(spark, sf_dir))


def _candidates(spark, sf_dir, **options):
    queries = rt.keyword_queries(v.probes(spark, sf_dir), v.STOPWORDS)
    return rt.search_pages(queries, rt.postings(v.corpus(spark, sf_dir)), **options)


@query
def candidate_pages(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query
def candidate_pages_hot_terms(spark, sf_dir):
    """The same search with a low bound for hot terms, so that both ways are taken."""
    return _candidates(spark, sf_dir, hot_pages=60)


@query
def candidate_pages_stored_index(spark, sf_dir):
    """The same search on a written index, reading only the buckets asked for."""
    index = rt.write_index(v.corpus(spark, sf_dir), scratch_path(spark, "index"), buckets=16)
    queries = rt.keyword_queries(v.probes(spark, sf_dir), v.STOPWORDS)
    return rt.search_pages(queries, index, buckets=16)


@query
def candidate_pages_blocks(spark, sf_dir):
    """The same search on the impact-ordered index: blocks that can't hold one of the best pages never meet a query."""
    index = rt.write_blocks(v.corpus(spark, sf_dir), scratch_path(spark, "blocks"), buckets=16)
    queries = rt.keyword_queries(v.probes(spark, sf_dir), v.STOPWORDS)
    return rt.search_blocks(queries, index, buckets=16)


@query
def chunk_passages(spark, sf_dir):
    return rt.passages(v.corpus(spark, sf_dir))


@query
def similarity_filter(spark, sf_dir):
    scored = rt.scored_passages(v.probes(spark, sf_dir), cut(_candidates(spark, sf_dir), spread=True), v.corpus(spark, sf_dir))
    kept = rt.similar_passages(scored)
    return _rounded(kept.select("claim_id", "page_id", "page_rank", "chunk_no", "similarity"), "similarity")


@query
def adaptive_topk_evidence(spark, sf_dir):
    claims = with_budget(v.probes(spark, sf_dir), v.HEDGE, v.VAGUE)
    return rt.adaptive_passages(claims, cut(_candidates(spark, sf_dir), spread=True), v.corpus(spark, sf_dir))


def _flat(evidence: DataFrame) -> DataFrame:
    joined = ev.join_evidence(F.col("passages"))
    return evidence.select(
        "claim_id", "k_used", "n_candidates", "n_passages", "n_kept", "used_fallback",
        F.md5(joined).alias("evidence_md5"),
    )


@query
def evidence_build(spark, sf_dir):
    """Flagship: every conversation turn against the document corpus."""
    found = rt.retrieve(
        v.short_claims(spark, sf_dir), v.corpus(spark, sf_dir), stopwords=v.STOPWORDS, hedge=v.HEDGE, vague=v.VAGUE
    )
    return _flat(found)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_counts(texts: DataFrame) -> DataFrame:
    """An encoder that SQL can state too: how often each letter occurs in either case."""
    # Letters are one byte each, so bytes that go missing count them; replacing works on bytes, translating on characters.
    without = lambda c: F.replace(F.replace(F.col("text"), F.lit(c)), F.lit(c.upper()))
    counts = [F.octet_length("text") - F.octet_length(without(c)) for c in LETTERS]
    return texts.withColumn("vector", F.array(*[c.cast("double") for c in counts]))


@query
def dense_evidence(spark, sf_dir):
    """Evidence for the benchmark items with passages compared by encoded vectors."""
    found = rt.retrieve(
        v.probes(spark, sf_dir), v.corpus(spark, sf_dir), stopwords=v.STOPWORDS, hedge=v.HEDGE, vague=v.VAGUE,
        encode=_letter_counts, threshold=0.97,
    )
    return _flat(found)


@query
def evidence_build_resumed(spark, sf_dir):
    """The flagship as a job in two runs on a stored index: the first half of the claims, then what is pending."""
    from assay.plans.evidence_build import build_evidence

    claims, pages = v.short_claims(spark, sf_dir), v.corpus(spark, sf_dir)
    index = rt.write_index(pages, scratch_path(spark, "index"), buckets=16)
    path = scratch_path(spark, "evidence")
    options = {"index": index, "buckets": 16, "stopwords": v.STOPWORDS, "hedge": v.HEDGE, "vague": v.VAGUE}
    build_evidence(claims, pages, path, max_claims=claims.count() // 2, **options)
    return _flat(build_evidence(claims, pages, path, **options))


@query
def fallback_retrieval(spark, sf_dir):
    """Documents against the small probe corpus: many first searches find nothing."""
    pages = v.probes(spark, sf_dir).select(F.col("claim_id").alias("page_id"), F.col("claim").alias("extract"))
    found = rt.retrieve(
        v.claims(spark, sf_dir), pages, stopwords=v.STOPWORDS, hedge=v.HEDGE, vague=v.VAGUE
    )
    return _flat(found)


@query
def retrieval_fill_rate(spark, sf_dir):
    """Fill rate per evidence budget of the probe claims."""
    found = rt.retrieve(
        v.probes(spark, sf_dir), v.corpus(spark, sf_dir), stopwords=v.STOPWORDS, hedge=v.HEDGE, vague=v.VAGUE
    )
    return _rounded(ev.fill_rate(found, "k_used"), "fill_rate")


# --- Evidence tables ---------------------------------------------------------------------------


@query
def evidence_resume(spark, sf_dir):
    claims = v.claims(spark, sf_dir).select("claim_id", "claim")
    done = v.labelled(spark, sf_dir).select("claim_id", "claim")
    new = ev.pending(claims, done).withColumn("state", F.lit("new"))
    old = ev.reused(claims, done).withColumn("state", F.lit("reused"))
    return new.unionByName(old).select("claim_id", "state", F.length("claim").alias("n_chars"))


@query
def evidence_lookup_last_wins(spark, sf_dir):
    cache = v.claims(spark, sf_dir).select(
        "claim", F.array("speaker", F.col("claim_id").cast("string")).alias("passages"), F.col("claim_id").alias("row_no")
    )
    found = ev.lookup(v.claims(spark, sf_dir).select("claim_id", "claim"), cache)
    return found.select("claim_id", ev.join_evidence(F.col("passages")).alias("evidence"))


@query
def evidence_alignment(spark, sf_dir):
    claims = v.claims(spark, sf_dir).select("claim_id", "split")
    aligned = ev.align(claims, v.own_evidence(spark, sf_dir)).unionByName(ev.align(claims, None))
    return aligned.select("claim_id", "evidence_mode", F.size("passages").alias("n_passages"))


@query
def fill_rate(spark, sf_dir):
    aligned = ev.align(v.claims(spark, sf_dir).select("claim_id", "split"), v.own_evidence(spark, sf_dir))
    return _rounded(ev.fill_rate(aligned, "split"), "fill_rate")


@query
def evidence_parse(spark, sf_dir):
    """Document lines as joined evidence, parsed back into a list."""
    joined = F.array_join(F.split("text", "\n"), ev.SEPARATOR)
    docs = v.table(spark, sf_dir, "documents").select("doc_id", ev.parse_evidence(joined).alias("passages"))
    return docs.select(F.col("doc_id").alias("claim_id"), F.size("passages").alias("n_passages"),
                       F.md5(ev.join_evidence(F.col("passages"))).alias("evidence_md5"))


@query
def evidence_csv_roundtrip(spark, sf_dir):
    """Evidence exported as CSV and read back."""
    rows = v.own_evidence(spark, sf_dir).select(
        F.col("claim_id").cast("string").alias("claim"), F.size("passages").alias("k_used"), "passages"
    )
    path = scratch_path(spark, "evidence-csv")
    rs.export_evidence_csv(rows, path)
    back = rs.import_evidence_csv(spark, path)
    return back.select(
        F.col("claim").cast("long").alias("claim_id"), "k_used", F.size("passages").alias("n_passages"),
        F.md5(ev.join_evidence(F.col("passages"))).alias("evidence_md5"),
    )


# --- Claims ------------------------------------------------------------------------------------

LABEL_NAMES = (*LABEL_CLASS, "not-rated")


def write_raw_claims(spark, sf_dir) -> str:
    """Documents as raw claims files: German rows carry a surplus field, Spanish rows are short."""
    docs = v.claims(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in LABEL_NAMES])
    flat = F.regexp_replace("claim", f"(?U){tx.SPACE}+", " ")
    counts = [F.floor(uniform(F.lit(c), F.col("claim_id")) * 9).cast("string") for c in cl.RAW_COUNTS]
    short = [
        F.concat(F.lit("c"), F.col("claim_id")), F.get(names, F.floor(uniform(F.lit("label"), F.col("claim_id")) * len(LABEL_NAMES)).cast("int")),
        flat, F.col("subject"), F.when(F.col("subject") == "fr", "").otherwise(F.concat(F.lit(" "), "speaker", F.lit(" "))),
        F.lit("job"), F.lit("state"), F.lit("party"),
    ]
    full = [*short, *counts, F.lit("context")]
    line = (
        F.when(F.col("subject") == "de", F.concat_ws("\t", *full, F.lit("surplus")))
        .when(F.col("subject") == "es", F.concat_ws("\t", *short))
        .otherwise(F.concat_ws("\t", *full))
    )
    folder = scratch_path(spark, "raw-claims")
    lines = cut(docs.select("split", line.alias("value")))
    for split, name in cl.SPLIT_FILES.items():
        lines.where(F.col("split") == split).select("value").write.text(f"{folder}/{name}")
    return folder


@query
def raw_claims_scan(spark, sf_dir):
    raw = cl.scan_splits(spark, write_raw_claims(spark, sf_dir))
    return raw.select("id", "label_str", "subject", "speaker", "party", *cl.RAW_COUNTS, "context",
                      F.md5("claim").alias("claim_md5"))


@query
def load_splits(spark, sf_dir):
    loaded = cl.load_splits(spark, write_raw_claims(spark, sf_dir))
    return loaded.select("split", "speaker", "subject", "label", "label_str", F.md5("claim").alias("claim_md5"))


@query
def processed_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "processed")
    cl.write_processed(cl.load_splits(spark, write_raw_claims(spark, sf_dir)), path, "csv")
    back = cl.read_processed(spark, path, "csv")
    return back.groupBy("split", "label_str", "label").agg(
        F.count("*").alias("n_rows"), F.sum(F.length("claim")).alias("n_chars"),
        F.sum(F.when(F.col("speaker") == "", 1).otherwise(0)).cast("long").alias("no_speaker"),
    )


@query
def speaker_history(spark, sf_dir):
    raw = cl.scan_splits(spark, write_raw_claims(spark, sf_dir))
    shares = [c.replace("_counts", "_share") for c in cl.RAW_COUNTS]
    return _rounded(cl.speaker_history(raw).select("id", "history_total", *shares), *shares)


@query
def split_stats(spark, sf_dir):
    return _rounded(cl.split_stats(v.labelled(spark, sf_dir)), "real_share")


@query
def label_histogram(spark, sf_dir):
    named = v.labelled(spark, sf_dir).withColumn("label_str", F.when(F.col("label") == 1, "true").otherwise("false"))
    return cl.label_histogram(named)


@query
def clean_text(spark, sf_dir):
    """Trimmed claims, missing speaker and subject filled."""
    raw = v.short_claims(spark, sf_dir).withColumn(
        "label_str", F.when(F.col("speaker") == "user", "mostly-true").when(F.col("speaker") == "assistant", "pants-fire")
        .otherwise("unrated")
    )
    return cl.clean(raw).select("claim_id", "speaker", "subject", "label", F.md5("claim").alias("claim_md5"))


@query
def head_sample(spark, sf_dir):
    return cl.head(v.labelled(spark, sf_dir), 50).select("claim_id", "label")


# --- Text for models ---------------------------------------------------------------------------


@query
def context_text(spark, sf_dir):
    text = ft.context_text(F.col("claim"), F.col("speaker"), F.col("subject"))
    raw = ft.context_text(F.col("claim"), F.col("speaker"), F.col("subject"), blank_as=None)
    bare = ft.context_text(F.col("claim"), None, None)
    return v.short_claims(spark, sf_dir).select(
        "claim_id", text.alias("context"), F.md5(raw).alias("raw_md5"), F.md5(bare).alias("bare_md5")
    )


@query
def model_text(spark, sf_dir):
    rows = ev.align(v.claims(spark, sf_dir), v.own_evidence(spark, sf_dir))
    context = ft.context_text(F.col("claim"), F.col("speaker"), F.col("subject"))
    whole = ft.model_text(context, F.col("passages"))
    one = ft.model_text_joined(context, F.get("passages", F.lit(0)))
    return rows.select("claim_id", F.length(whole).alias("n_chars"), F.md5(whole).alias("text_md5"), F.md5(one).alias("joined_md5"))


@query
def tfidf_terms(spark, sf_dir):
    """1 to 3 grams, 15,000 terms, unit length; fitted on and applied to the short claims with context."""
    context = ft.context_text(F.col("claim"), F.col("speaker"), F.col("subject"))
    texts = v.short_claims(spark, sf_dir).select("claim_id", context.alias("text"))
    counts = ft.gram_counts(texts)
    n = texts.agg(F.count("*").alias("n")).scalar()
    return _rounded(ft.tfidf(counts, ft.vocabulary(counts), n), "weight")


@query
def tfidf_train_only(spark, sf_dir):
    """1 to 2 grams with damped counts; fitted on train documents, applied to test documents."""
    docs = v.claims(spark, sf_dir).select("claim_id", "split", F.col("claim").alias("text"))
    train, test = docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test")
    vocab = ft.vocabulary(ft.gram_counts(train, ngram=(1, 2)), 50_000)
    n = train.agg(F.count("*").alias("n")).scalar()
    weights = ft.tfidf(ft.gram_counts(test, ngram=(1, 2)), vocab, n, sublinear=True)
    return _rounded(weights, "weight")


@query
def tfidf_vectors(spark, sf_dir):
    """The ML stages: sparse vectors of the same weights, as number, sum and largest of the entries."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    context = ft.context_text(F.col("claim"), F.col("speaker"), F.col("subject"))
    texts = v.short_claims(spark, sf_dir).select("claim_id", context.alias("text"))
    out = Pipeline(stages=ft.tfidf_stages(texts)).fit(texts).transform(texts)
    dense = out.select("claim_id", F.filter(vector_to_array("tfidf"), lambda w: w > 0).alias("w"))
    return _rounded(
        dense.select(
            "claim_id", F.size("w").alias("n_terms"), F.aggregate("w", F.lit(0.0), lambda a, b: a + b).alias("total"),
            F.array_max("w").alias("largest"),
        ), "total", "largest", digits=5,
    )


# --- Augmentation ------------------------------------------------------------------------------


@query
def random_deletion(spark, sf_dir):
    out = aug.delete_words(F.col("claim"), F.col("claim_id"), 0.1, 7)
    return v.claims(spark, sf_dir).select("claim_id", F.md5(out).alias("text_md5"), F.length(out).alias("n_chars"))


@query
def random_swap(spark, sf_dir):
    out = aug.swap_words(F.col("claim"), F.col("claim_id"), 2, 7)
    return v.claims(spark, sf_dir).select("claim_id", F.md5(out).alias("text_md5"), F.length(out).alias("n_chars"))


def _digest_rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select("claim_id", *more, F.md5("claim").alias("text_md5"), F.length("claim").alias("n_chars"))


@query
def synonym_substitute(spark, sf_dir):
    return _digest_rows(aug.substitute_words(v.claims(spark, sf_dir), v.lexicon(spark), 0.15, 7))


@query
def combined_augment(spark, sf_dir):
    return _digest_rows(aug.combined(v.short_claims(spark, sf_dir), v.lexicon(spark), seed=7))


@query
def augment_union(spark, sf_dir):
    claims = ev.align(v.labelled(spark, sf_dir), v.own_evidence(spark, sf_dir))
    both = aug.doubled(claims, "synonym", lexicon=v.lexicon(spark))
    return _digest_rows(both.withColumn("n_passages", F.size("passages")), "is_augmented", "label", "speaker", "subject", "n_passages")


@query
def paraphrase_table(spark, sf_dir):
    """Paraphrases supplied as a table (the labelled claims in reverse word order), then substitution."""
    table = v.labelled(spark, sf_dir).select(
        "claim_id", F.array_join(F.reverse(tx.words(F.col("claim"))), " ").alias("paraphrase")
    )
    out = aug.augment(v.claims(spark, sf_dir), "both", v.lexicon(spark), table, 0.3, 11)
    return _digest_rows(out)


@query
def attack_sets(spark, sf_dir):
    return _digest_rows(aug.attack_sets(v.short_claims(spark, sf_dir), v.lexicon(spark)), "attack", "speaker")


@query
def attack_sets_over_seeds(spark, sf_dir):
    """Every labelled claim under every attack with the draws of five seeds, in one job."""
    attacked = aug.attack_sets(v.labelled(spark, sf_dir), v.lexicon(spark), seeds=v.SEEDS)
    return _digest_rows(attacked, "attack", "seed")


def _rule_predictions(spark, sf_dir):
    """Two rules on clean and attacked texts, all seeds in one pass: hedged claims and claims of long words count as 1."""
    from assay.plans.experiments import attack_predictions

    class Rules:
        def predict(self, claims, evidence=None):
            hedged = lambda ws: F.exists(ws, lambda w: F.lower(w).isin(*v.HEDGE))
            long_words = lambda ws: F.length("claim") >= 6 * F.size(ws)
            rules = tx.let(tx.words(F.col("claim")), lambda ws: F.array(*[
                F.struct(F.lit(name).alias("model"), F.when(rule(ws), 1).otherwise(0).alias("pred"))
                for name, rule in (("hedged", hedged), ("long_words", long_words))
            ]))
            return claims.select("*", F.inline(rules))

    return attack_predictions(Rules(), v.labelled(spark, sf_dir), v.lexicon(spark), seeds=v.SEEDS)


@query
def robustness_over_seeds(spark, sf_dir):
    """Drops of two rules under attack over five seeds, and whether one drops more than the other on the same seeds."""
    from assay.plans.experiments import robustness

    drops = robustness(_rule_predictions(spark, sf_dir), within=("model", "seed"))
    tested = rp.drop_test(drops, "long_words", "hedged")
    return _rounded(tested, "mean_a", "mean_b", "mean_d", "sd_d", "t", "p_two_sided", "p_one_sided")


# --- Vectors -----------------------------------------------------------------------------------


def _embeddings(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("claim_id"), F.col("embedding").alias("vector"), "label"
    )


@query
def mean_pool(spark, sf_dir):
    pooled = ft.mean_pool(_embeddings(spark, sf_dir), key="label")
    return pooled.select("label", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query
def claim_evidence_blend(spark, sf_dir):
    """Each vector blended with the mean of the vectors of its label; label 0 has no evidence."""
    rows = _embeddings(spark, sf_dir)
    means = ft.mean_pool(rows.where(F.col("label") != 0), key="label", output="m")
    evidence = rows.join(means, "label").select("claim_id", F.col("m").alias("vector"))
    out = ft.claim_evidence_vectors(rows, evidence)
    return out.select("claim_id", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query
def fusion_vectors(spark, sf_dir):
    """Model input of claims and all their passages, encoded apart and blended."""
    rows = ev.align(v.claims(spark, sf_dir), v.own_evidence(spark, sf_dir))
    out = ft.input_vectors(rows, evidence_fusion="vector", encode=_letter_counts)
    return out.select("claim_id", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query
def dense_cosine_filter(spark, sf_dir):
    """Vectors against the mean vector of their label, kept at a cosine of 0.25 or more."""
    rows = _embeddings(spark, sf_dir)
    means = ft.mean_pool(rows, key="label", output="passage_vector")
    pairs = rows.withColumnRenamed("vector", "claim_vector").join(means, "label")
    return _rounded(rt.dense_similar(pairs).select("claim_id", "label", "similarity"), "similarity")


@query
def hashed_text_vectors(spark, sf_dir):
    """Default text encoder: width and length of each vector."""
    rows = ft.input_vectors(ev.align(v.short_claims(spark, sf_dir), None))
    return rows.select("claim_id", F.size("vector").alias("width"), F.round(F.sqrt(vx.dot(F.col("vector"), F.col("vector"))), 6).alias("length"))


# --- Splits, weights, metrics ------------------------------------------------------------------


@query
def hash_split(spark, sf_dir):
    return md.hash_split(v.labelled(spark, sf_dir)).select("claim_id", "label", "fold")


@query
def balanced_resample(spark, sf_dir):
    """Real claims drawn to the number of fake ones; classes swapped, so the larger class is drawn down."""
    rows = v.labelled(spark, sf_dir).select("claim_id", "label")
    return md.balanced(rows).select("claim_id", "label", "draw", "shuffle_key")


@query
def class_weights(spark, sf_dir):
    return _rounded(mt.class_weights(v.labelled(spark, sf_dir)), "weight")


def _model(spark, sf_dir, name):
    return v.variant_predictions(spark, sf_dir).where(F.col("model") == name).select(
        "claim_id", "seed", "label", "p_fake", "p_real"
    )


@query
def ensemble_blend(spark, sf_dir):
    mixed = mt.blend(_model(spark, sf_dir, "tfidf_lr"), _model(spark, sf_dir, "vectors_mlp"), 0.3, ("claim_id", "seed"))
    return _rounded(mixed.select("claim_id", "seed", "label", "p_fake", "p_real", "pred"), "p_fake", "p_real")


@query
def weight_grid(spark, sf_dir):
    graded = mt.weight_scores(_model(spark, sf_dir, "tfidf_lr"), _model(spark, sf_dir, "vectors_mlp"), key=("claim_id", "seed"))
    return _rounded(graded, "accuracy", "f1_macro", "f1_fake", "f1_real")


@query
def best_weight(spark, sf_dir):
    graded = mt.weight_scores(_model(spark, sf_dir, "tfidf_lr"), _model(spark, sf_dir, "vectors_mlp"), key=("claim_id", "seed"))
    return _rounded(mt.best_weight(graded).select("weight", "f1_macro"), "f1_macro")


@query
def confusion_metrics(spark, sf_dir):
    graded = mt.evaluate(v.variant_predictions(spark, sf_dir), "model", "seed")
    return _rounded(graded, "accuracy", "f1_macro", "f1_fake", "f1_real")


@query
def classification_report(spark, sf_dir):
    rows = mt.class_report(v.variant_predictions(spark, sf_dir), "model")
    return _rounded(rows, "precision", "recall", "f1")


@query
def robustness_drop(spark, sf_dir):
    graded = mt.evaluate(v.attack_predictions(spark, sf_dir), "attack", "seed").select("attack", "seed", "accuracy", "f1_macro")
    dropped = mt.drop_from(graded, "clean", "attack", "accuracy", "seed")
    return _rounded(dropped.withColumnRenamed("drop", "robustness_drop"), "accuracy", "f1_macro", "robustness_drop")


@query
def drop_over_seeds(spark, sf_dir):
    graded = mt.evaluate(v.attack_predictions(spark, sf_dir), "attack", "seed")
    dropped = mt.drop_from(graded, "clean", "attack", "accuracy", "seed")
    return _rounded(rp.drop_over_seeds(dropped, "attack"), "drop_mean", "drop_std_pop", "drop_std_samp")


@query
def variant_drop(spark, sf_dir):
    """Mean macro F1 of each variant against the complete configuration."""
    means = v.results(spark, sf_dir).groupBy("model").agg(F.avg("test_f1_macro").alias("f1_macro"))
    return _rounded(mt.drop_from(means, "full", "model", "f1_macro"), "f1_macro", "drop")


@query
def variant_summary(spark, sf_dir):
    names = ("f1_macro_mean", "f1_macro_std_pop", "f1_macro_std_samp", "acc_mean", "f1_fake_mean")
    return _rounded(rp.variant_summary(v.results(spark, sf_dir)), *names)


@query
def scores_per_model(spark, sf_dir):
    rows = rp.scores_per_model(v.results(spark, sf_dir))
    return rows.select("model", F.posexplode("scores").alias("pos", "score")).withColumn("score", F.round("score", 6))


def _pairs(spark, sf_dir):
    results = v.results(spark, sf_dir).select("model", "seed", F.col("test_f1_macro").alias("score"))
    full = results.where(F.col("model") == "full").select("seed", F.col("score").alias("a"))
    return results.where(F.col("model") != "full").join(full, "seed").select("model", "seed", "a", F.col("score").alias("b"))


@query
def paired_ttest(spark, sf_dir):
    names = ("mean_a", "mean_b", "mean_d", "sd_d", "t", "p_two_sided", "p_one_sided")
    return _rounded(rp.paired_ttest(_pairs(spark, sf_dir), "model"), *names)


@query
def effect_size(spark, sf_dir):
    tested = rp.with_effect(rp.paired_ttest(_pairs(spark, sf_dir), "model"), 6)
    names = ("cohens_d", "alpha_corrected", "ci_low", "ci_high")
    return _rounded(tested.select("model", *names, "significant_corrected"), *names)


@query
def wilcoxon(spark, sf_dir):
    tested = rp.wilcoxon(_pairs(spark, sf_dir), "model")
    return _rounded(tested.select("model", "n", "n_ranked", "w_plus", "w_minus", "p_one_sided"), "p_one_sided")


@query
def significance_report(spark, sf_dir):
    results = v.results(spark, sf_dir)
    runs, base = results.where(F.col("augmentation") != "baseline"), results.where(F.col("augmentation") == "baseline")
    names = ("mean_a", "mean_b", "mean_d", "sd_d", "t", "p_two_sided", "p_one_sided")
    return _rounded(rp.significance_report(runs, base), *names)


@query
def accuracy_margin(spark, sf_dir):
    graded = mt.evaluate(v.variant_predictions(spark, sf_dir), "model", "seed")
    n = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("double")
    rows = graded.select("model", "seed", "accuracy", rp.margin_of_error(F.col("accuracy"), n).alias("margin"))
    return _rounded(rows, "accuracy", "margin")


@query
def mcnemar(spark, sf_dir):
    pairs = mt.paired_outcomes(v.attack_predictions(spark, sf_dir), "clean", key=("claim_id", "seed"))
    return _rounded(mt.mcnemar(pairs), "statistic")


@query
def stratified_accuracy(spark, sf_dir):
    """Accuracy by evidence, specificity and length of the claim."""
    features = with_budget(v.labelled(spark, sf_dir), v.HEDGE, v.VAGUE, keep_features=True)
    rows = ev.align(features, v.own_evidence(spark, sf_dir)).select("claim_id", "specificity", "n_words", "passages")
    both = v.attack_predictions(spark, sf_dir).select("claim_id", "label", "pred").join(rows, "claim_id")
    strata = mt.stratified(
        both,
        evidence=F.when(F.size("passages") > 3, "many").when(F.size("passages") > 0, "some").otherwise("none"),
        specific=F.when(F.col("specificity") > 0, "yes").otherwise("no"),
        length=F.when(F.col("n_words") < 100, "short").when(F.col("n_words") < 400, "medium").otherwise("long"),
    )
    return _rounded(strata, "accuracy")


@query
def results_append(spark, sf_dir):
    """Result rows appended in two runs and summed up per variant."""
    path = scratch_path(spark, "results")
    results = v.results(spark, sf_dir)
    rs.append_results(results.where(F.col("augmentation") != "baseline"), path)
    rs.append_results(results.where(F.col("augmentation") == "baseline"), path)
    return spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("n_rows"), F.round(F.sum("test_acc"), 6).alias("acc_sum"))


@query
def final_summary(spark, sf_dir):
    results = v.results(spark, sf_dir)
    return rs.summary(
        baseline=results.where(F.col("augmentation") == "baseline"), main=results.where(F.col("augmentation") != "baseline")
    )


@query
def report_files(spark, sf_dir):
    """A report written in each format and read back."""
    report = scores_per_model(spark, sf_dir)
    out = []
    for fmt in ("csv", "json"):
        path = scratch_path(spark, "report")
        rs.write_report(report, path, fmt)
        reader = spark.read.schema(report.schema)
        rows = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
        out.append(rows.select(F.lit(fmt).alias("fmt"), "model", "pos", "score"))
    return out[0].unionByName(out[1])


@query
def final_nested(spark, sf_dir):
    """All result sections exported as one JSON object, read back as rows."""
    results = v.results(spark, sf_dir).select("model", "seed", F.round("test_f1_macro", 6).alias("score"))
    base = F.col("model") == "full"
    path = scratch_path(spark, "nested")
    rs.export_nested({"full": results.where(base), "others": results.where(~base)}, path)
    row = "array<struct<model:string,seed:int,score:double>>"
    read = spark.read.schema(f"full {row}, others {row}").json(path)
    parts = [read.select(F.lit(name).alias("section"), F.inline(name)) for name in ("full", "others")]
    return parts[0].unionByName(parts[1])


@query
def dense_search(spark, sf_dir):
    """The ten nearest vectors of every row whose id is divisible by 100, against all rows."""
    vectors = v.table(spark, sf_dir, "embeddings")
    index = dn.build_index(vectors, scratch_path(spark, "dense"))
    return _rounded(dn.search(vectors.where(F.col("vec_id") % 100 == 0), index), "cosine")


# --- Key-based evidence ------------------------------------------------------------------------


def write_page_dump(spark, sf_dir) -> str:
    """Documents as a page dump; texts of one language and length share a title."""
    docs = v.table(spark, sf_dir, "documents")
    lines = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.when(i % 5 == 4, F.concat(F.lit("note\t"), s)).otherwise(
            F.concat(F.when(i % 7 == 6, i - 1).otherwise(i).cast("string"), F.lit("\t"), s)
        ),
    )
    rows = docs.select("doc_id", F.to_json(F.struct(
        F.concat_ws("-", "lang", "n_chars").alias("id"), F.array_join(lines, "\n").alias("lines"))).alias("value"))
    path = scratch_path(spark, "pages")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return path


def write_keyed_claims(spark, sf_dir) -> str:
    """Conversation turns as claims that cite four sentences drawn from all of a document's, one of them twice,
    one without a page now and then, and one broken tuple."""
    docs = v.table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n")).scalar()
    turns = v.short_claims(spark, sf_dir)
    draws = turns.select("claim_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select(
        "claim_id", "j", F.floor(uniform(F.lit("cite"), F.col("claim_id"), F.col("j")) * n).cast("long").alias("doc_id"),
        uniform(F.lit("sent"), F.col("claim_id"), F.col("j")).alias("u"),
    )
    titles = docs.select("doc_id", F.concat_ws("-", "lang", "n_chars").alias("title"), F.size(F.split("text", "\n")).alias("n_lines"))
    titled = draws.join(titles, "doc_id").withColumn("sent", F.floor(F.col("u") * F.col("n_lines")).cast("int"))
    page = F.when((F.col("j") == 3) & (F.col("sent") == 0), F.lit(None).cast("string")).otherwise(F.col("title"))
    one = F.array(F.lit("1"), F.col("j").cast("string"), page, F.col("sent").cast("string"))
    cited = titled.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("j", one.alias("e")))).alias("c"))
    cited = cited.select("claim_id", F.transform("c", lambda c: c["e"]).alias("e"))
    groups = F.array(F.slice("e", 1, 2), F.array(F.get("e", F.lit(0)), F.array(F.lit("9"), F.lit("9"))), F.slice("e", 3, 2))
    label = (
        F.when(F.col("speaker") == "user", "SUPPORTS").when(F.col("speaker") == "assistant", "REFUTES")
        .otherwise("NOT ENOUGH INFO")
    )
    rows = turns.join(cited, "claim_id").select(
        "claim_id",
        F.to_json(F.struct(F.col("claim_id").cast("string").alias("claim"), label.alias("label"), groups.alias("evidence")),
                  {"ignoreNullFields": "false"}).alias("value"),
    )
    path = scratch_path(spark, "keyed-claims")
    rows.repartitionByRange("claim_id").sortWithinPartitions("claim_id").select("value").write.text(path)
    return path


@query
def page_sentences(spark, sf_dir):
    sentences = fv.sentence_table(fv.scan_pages(spark, write_page_dump(spark, sf_dir)))
    return sentences.select("title", "sent_id", F.md5("text").alias("text_md5"))


@query
def keyed_claims(spark, sf_dir):
    loaded = fv.load_claims(spark, write_keyed_claims(spark, sf_dir))
    return loaded.select(F.col("claim").cast("long").alias("claim_id"), "label", "label_str",
                         F.size(F.flatten("evidence")).alias("n_tuples"))


@query
def evidence_resolve(spark, sf_dir):
    path = scratch_path(spark, "sentences")
    pages = fv.scan_pages(spark, write_page_dump(spark, sf_dir))
    sentences = fv.write_sentences(fv.sentence_table(pages), path, path.rsplit("/", 1)[1].replace("-", "_"), width(spark))
    loaded = fv.load_claims(spark, write_keyed_claims(spark, sf_dir))
    loaded = loaded.withColumn("claim_id", F.col("claim").cast("long"))
    out = ev.resolve(loaded, sentences)
    return out.select("claim_id", "label", F.length("evidence_text").alias("n_chars"), F.md5("evidence_text").alias("text_md5"))


# --- Models (rows only) ------------------------------------------------------------------------


def _folds(spark, sf_dir):
    rows = v.labelled(spark, sf_dir).drop("split")
    split = md.hash_split(rows, val_share=0.25).withColumn("text", ft.context_text(F.col("claim"), F.col("speaker"), F.col("subject")))
    return split.where(F.col("fold") == "train").drop("fold"), split.where(F.col("fold") == "val").drop("fold")


def _tfidf(train, *others, max_terms=ft.MAX_TERMS):
    from pyspark.ml import Pipeline

    fitted = Pipeline(stages=ft.tfidf_stages(train, ft.TfidfOptions(max_terms=max_terms))).fit(train)
    return [cut(fitted.transform(t).select("claim_id", "label", "tfidf")) for t in (train, *others)]


@query
def lr_fit(spark, sf_dir):
    train, val = _tfidf(*_folds(spark, sf_dir))
    model = md.fit_logistic(train)
    return md.probabilities(model, val, "tfidf").select("claim_id", "label", "p_fake", "p_real", "pred")


@query
def lr_balanced_fit(spark, sf_dir):
    train, val = _tfidf(*_folds(spark, sf_dir))
    model = md.fit_logistic(train, c=1.0, balance=True)
    return md.probabilities(model, val, "tfidf").select("claim_id", "label", "p_fake", "p_real", "pred")


@query
def svm_fit(spark, sf_dir):
    train, val = _tfidf(*_folds(spark, sf_dir))
    model = md.fit_calibrated_svm(train)
    return model.probabilities(val).select("claim_id", "label", "p_fake", "p_real", "pred")


@query
def mlp_fit(spark, sf_dir):
    """Perceptron on the given dense vectors; even labels against odd ones."""
    rows = _embeddings(spark, sf_dir).withColumn("label", F.col("label") % 2)
    rows = md.hash_split(rows)
    model = md.fit_mlp(rows.where(F.col("fold") == "train"))
    return md.probabilities(model, rows.where(F.col("fold") == "val"), "vector").select("claim_id", "label", "p_fake", "p_real", "pred")


@query
def model_selection(spark, sf_dir):
    """History of the validation search over iteration counts."""
    rows = cut(md.hash_split(_embeddings(spark, sf_dir).withColumn("label", F.col("label") % 2)))
    chosen = md.select_mlp(
        rows.where(F.col("fold") == "train"), rows.where(F.col("fold") == "val"), hidden=md.HIDDEN_SMALL
    )
    return spark.createDataFrame(
        [{**h, "chosen": h["max_iter"] == chosen.max_iter} for h in chosen.history],
        "step int, max_iter int, loss double, accuracy double, f1_macro double, f1_fake double, f1_real double, chosen boolean",
    )


def _verifier_inputs(spark, sf_dir):
    rows = cut(v.labelled(spark, sf_dir))
    parts = [rows.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")]
    return (*parts, v.own_evidence(spark, sf_dir), v.lexicon(spark))


@query
def verifier_fit(spark, sf_dir):
    """End to end: fit, save, load, predict on the test split."""
    from assay.plans.training import Verifier, VerifierOptions, fit_verifier

    train, val, test, evidence, lexicon = _verifier_inputs(spark, sf_dir)
    path = scratch_path(spark, "verifier")
    fit_verifier(train, val, VerifierOptions(), evidence, lexicon).save(path)
    return Verifier.load(path).predict(test, evidence).select("claim_id", "label", "evidence_mode", "p_fake", "p_real", "pred")


@query
def ablation_matrix(spark, sf_dir):
    from assay.plans.experiments import ABLATIONS, SEEDS, ablations
    from assay.plans.training import VerifierOptions

    train, val, test, evidence, lexicon = _verifier_inputs(spark, sf_dir)
    return ablations(train, val, test, evidence, lexicon, ABLATIONS, seeds=SEEDS, base=VerifierOptions())


@query
def baseline_runs(spark, sf_dir):
    from assay.plans.experiments import SEEDS, baselines

    train, val, test, _, _ = _verifier_inputs(spark, sf_dir)
    return baselines(train, val, test, seeds=SEEDS)


@query
def robustness_run(spark, sf_dir):
    """A fitted verifier on clean and attacked test claims."""
    from assay.plans.experiments import attack_predictions, robustness
    from assay.plans.training import VerifierOptions, fit_verifier

    train, val, test, evidence, lexicon = _verifier_inputs(spark, sf_dir)
    verifier = fit_verifier(train, val, VerifierOptions(), evidence, lexicon)
    return robustness(attack_predictions(verifier, test, lexicon, evidence, "same"))


# --- Streaming ---------------------------------------------------------------------------------


@query
def stream_scores(spark, sf_dir):
    """Scores of claims that arrive as files."""
    from assay.streaming.jobs import read_claims, score_stream

    folder, out = scratch_path(spark, "arriving"), scratch_path(spark, "scores")
    v.short_claims(spark, sf_dir).select("claim_id", "claim").repartition(4, "claim_id").write.parquet(folder)
    scored = score_stream(read_claims(spark, folder, files_per_batch=2), v.HEDGE, v.VAGUE)
    started = (
        scored.select("claim_id", "uncertainty", "k").writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "scores-state")).option("path", out)
        .trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema("claim_id long, uncertainty double, k int").parquet(out)


@query
def stream_evidence(spark, sf_dir):
    """Evidence of probe claims that arrive in two rounds, some of them twice."""
    from assay.streaming.jobs import build_evidence_stream, read_claims

    folder, out, state = (scratch_path(spark, n) for n in ("probes", "evidence", "evidence-state"))
    index = rt.write_index(v.corpus(spark, sf_dir), scratch_path(spark, "index"), buckets=16)
    arriving = v.probes(spark, sf_dir)
    late = arriving.where(uniform(F.lit("late"), F.col("claim_id")) < 0.5)
    for part in (late, arriving):
        part.write.mode("append").parquet(folder)
        build_evidence_stream(
            read_claims(spark, folder, files_per_batch=1), v.corpus(spark, sf_dir), index, out, state,
            stopwords=v.STOPWORDS, hedge=v.HEDGE, vague=v.VAGUE, buckets=16,
        ).awaitTermination()
    return _flat(spark.read.parquet(out))


@query
def stream_fill_rate(spark, sf_dir):
    """Hourly fill rate of evidence rows; event times come from the event table, value decides on evidence."""
    from assay.streaming.jobs import fill_rate_stream

    folder, out = scratch_path(spark, "evidence-events"), scratch_path(spark, "fill")
    rows = v.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ingested_at"),
        F.when(F.col("value") >= 10, F.array(F.col("event_type"))).otherwise(F.array(F.lit(" "))).alias("passages"),
    )
    rows.repartitionByRange(4, "ingested_at").write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    started = (
        fill_rate_stream(stream).writeStream.outputMode("update")
        .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"))
        .option("checkpointLocation", scratch_path(spark, "fill-state")).trigger(availableNow=True).start()
    )
    started.awaitTermination()
    # A batch writes the windows it changed; the last word on a window counts.
    last = F.max_by(F.struct("n_claims", "n_filled", "fill_rate"), "batch").alias("last")
    rows = spark.read.parquet(out).groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(last)
    return _rounded(rows.select("window_start", "last.*"), "fill_rate")
