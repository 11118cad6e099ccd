from pyspark.sql import functions as F

from assay.functions.uncertainty import with_budget
from assay.operators import retrieval as rt
from assay.plans import views as v
from assay.session import scratch_path
from assay.streaming import jobs


def test_evidence_stream_equals_batch_and_restarts(spark, sf_dir):
    claims, pages = v.probes(spark, sf_dir), v.corpus(spark, sf_dir)
    index = rt.write_index(pages, scratch_path(spark, "index"), buckets=8)
    options = {"stopwords": v.STOPWORDS, "hedge": v.HEDGE, "vague": v.VAGUE}
    folder, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))

    def run():
        stream = jobs.read_claims(spark, folder, files_per_batch=1)
        jobs.build_evidence_stream(stream, pages, index, out, state, buckets=8, **options).awaitTermination()

    claims.where("claim_id < 15").coalesce(1).write.mode("append").parquet(folder)
    run()
    claims.coalesce(1).write.mode("append").parquet(folder)  # the first fifteen arrive once more
    run()
    run()  # nothing new
    key = ["claim_id", "k_used", "passages", "n_candidates", "n_passages", "n_kept", "used_fallback"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*key).collect()))
    want = sorted(map(tuple, rt.retrieve(claims, pages, **options).select(*key).collect()))
    assert got == want


def test_replayed_batch_leaves_one_copy(spark, sf_dir):
    """The state is lost, the output is not: the same files come again as batch 0."""
    claims, pages = v.probes(spark, sf_dir), v.corpus(spark, sf_dir)
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    claims.coalesce(1).write.parquet(folder)
    for _ in range(2):
        jobs.build_evidence_stream(
            jobs.read_claims(spark, folder), pages, rt.postings(pages), out, scratch_path(spark, "state"), stopwords=v.STOPWORDS
        ).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == claims.count() == rows.select("claim_id").distinct().count()


def test_scores_equal_batch(spark, sf_dir):
    claims = v.short_claims(spark, sf_dir).select("claim_id", "claim")
    folder, out = scratch_path(spark, "in"), scratch_path(spark, "scores")
    claims.repartition(3).write.parquet(folder)
    scored = jobs.score_stream(jobs.read_claims(spark, folder, files_per_batch=1))
    scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "state")).trigger(
        availableNow=True
    ).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, with_budget(claims).collect()))


def test_fill_rate_windows_in_append_mode(spark):
    folder, out, state = (scratch_path(spark, n) for n in ("in", "fill", "state"))
    schema = "ingested_at timestamp, passages array<string>"

    def arrive(*rows):
        df = spark.createDataFrame([(t, p) for t, p in rows], "t string, passages array<string>")
        df.select(F.col("t").cast("timestamp").alias("ingested_at"), "passages").coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.fill_rate_stream(spark.readStream.schema(schema).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(
            availableNow=True
        ).start().awaitTermination()

    arrive(("2024-01-01 00:10:00", ["a"]), ("2024-01-01 00:50:00", []))
    arrive(("2024-01-01 03:00:00", ["b"]))  # moves the watermark past the first window
    arrive(("2024-01-01 00:20:00", ["late"]), ("2024-01-01 06:00:00", []))  # a late row is left out
    rows = {r.window_start.hour: (r.n_claims, r.n_filled, r.fill_rate) for r in spark.read.parquet(out).collect()}
    assert rows[0] == (2, 1, 0.5) and rows[3] == (1, 1, 1.0)
