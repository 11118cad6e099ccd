import pytest
from pyspark.sql import functions as F

from assay.operators import evidence as ev
from assay.plans.evidence_build import build_evidence
from assay.session import scratch_path, width
from assay.sources import results as rs
from assay.sources.fever import write_sentences

PAGES = [(i, f"topic{i} " + " ".join(f"word{i}_{j}" for j in range(30))) for i in range(12)]
CLAIMS = [(i, f"topic{i} word{i}_1 word{i}_2 word{i}_3 word{i}_4 word{i}_5 word{i}_6") for i in range(12)]


@pytest.mark.parametrize("text,passages", [
    (None, []), ("", []), ("  ", []), ("one", ["one"]), ("a [SEP] b [SEP] c", ["a", "b", "c"]),
    ("a [SEP]   [SEP] b", ["a", "b"]), ("a[SEP]b", ["a[SEP]b"]),
])
def test_parse(spark, text, passages):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(ev.parse_evidence(F.col("t")).alias("p")).first()["p"] == passages


def test_lookup_last_duplicate_wins(spark):
    cache = spark.createDataFrame([("a", ["old"], 1), ("a", ["new"], 2), ("b", ["x"], 3)], "claim string, passages array<string>, row_no long")
    claims = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "claim_id long, claim string")
    got = {r.claim_id: r.passages for r in ev.lookup(claims, cache).collect()}
    assert got == {1: ["new"], 2: ["x"], 3: [], 4: ["new"]}


def test_align_without_table(spark):
    claims = spark.createDataFrame([(1, "a")], "claim_id long, claim string")
    row = ev.align(claims, None).first()
    assert row.passages == [] and row.evidence_mode == "none"


def test_resolve(spark):
    sentences = spark.createDataFrame(
        [("P", 0, "p0"), ("P", 1, "p1"), ("Q", 0, "q0"), ("Q", 1, "q1")], "title string, sent_id int, text string"
    )
    rows = [
        (1, [[["1", "1", "P", "1"], ["1", "2", "P", "1"]], [["1", "3", "Q", "0"]]]),  # repeated citation
        (2, [[["1", "1", None, "1"], ["1", "1", "P"], ["1", "1", "P", None]]]),  # null page, short tuple, null sentence
        (3, [[["1", "1", "Q", "1"], ["1", "1", "P", "0"], ["1", "1", "P", "1"], ["1", "1", "Q", "0"]]]),  # more than three
        (4, [[["1", "1", "Absent", "0"], ["1", "1", "Q", "0"]]]),  # title missing
        (5, []), (6, None),
    ]
    claims = spark.createDataFrame(rows, "claim_id long, evidence array<array<array<string>>>")
    got = {r.claim_id: r.evidence_text for r in ev.resolve(claims, sentences).collect()}
    assert got == {1: "p1 q0", 2: "", 3: "q1 p0 p1", 4: "q0", 5: "", 6: ""}


def test_fill_rate(spark):
    rows = spark.createDataFrame([(["a"],), ([" ", " "],), ([],), ([" ", "b"],)], "passages array<string>")
    row = ev.fill_rate(rows).first()
    assert (row.n_claims, row.n_filled, row.fill_rate) == (4, 2, 0.5)


def test_build_resumes_and_is_bounded(spark):
    claims = spark.createDataFrame(CLAIMS, "claim_id long, claim string")
    pages = spark.createDataFrame(PAGES, "page_id long, extract string")
    path = scratch_path(spark, "build")
    first = build_evidence(claims, pages, path, stopwords=["the"], max_claims=5)
    assert sorted(r.claim_id for r in first.collect()) == [0, 1, 2, 3, 4]
    build_evidence(claims.where("claim_id < 9"), pages, path, stopwords=["the"])
    last = build_evidence(claims, pages, path, stopwords=["the"])
    ids = [r.claim_id for r in last.collect()]
    assert sorted(ids) == list(range(12))
    assert all(len(r.passages) == 1 for r in last.collect())
    again = build_evidence(claims, pages, path, stopwords=["the"])
    assert again.count() == 12 and rs.read_evidence(spark, path).count() == 12


def test_uncommitted_part_is_written_anew(spark):
    """Rows of a part without its record don't count: they are not read, their claims stay pending, the part is replaced."""
    claims = spark.createDataFrame([(i, f"alpha beta {i}") for i in range(8)], "claim_id long, claim string")
    pages = spark.createDataFrame(PAGES, "page_id long, extract string")
    path, whole = scratch_path(spark, "build"), scratch_path(spark, "build")
    build_evidence(claims, pages, path, stopwords=["the"], max_claims=3)
    stopped = rs.read_evidence(spark, path).withColumn("claim_id", F.col("claim_id") + 3).withColumn("claim", F.lit("half"))
    stopped.write.parquet(f"{path}/rows/part=1")
    assert rs.read_evidence(spark, path).count() == 3
    last = build_evidence(claims, pages, path, stopwords=["the"])
    want = build_evidence(claims, pages, whole, stopwords=["the"])
    assert sorted(map(str, last.collect())) == sorted(map(str, want.collect())) and last.count() == 8
    assert rs.committed_parts(spark, path) == [0, 1] and rs.committed_parts(spark, whole) == [0]
    again = build_evidence(claims.where("claim_id < 2"), pages, path, resume=False, stopwords=["the"])
    assert again.count() == 2 and rs.read_evidence(spark, path).count() == 2 and rs.committed_parts(spark, path) == [2]


def test_missing_table_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        rs.read_evidence(spark, scratch_path(spark, "absent"))


def test_csv_keeps_quotes_and_newlines(spark):
    rows = spark.createDataFrame([('say "x"', 2, ['a "q"', "b,c"]), ("plain", 1, [])], "claim string, k_used int, passages array<string>")
    path = scratch_path(spark, "csv")
    rs.export_evidence_csv(rows, path)
    back = {r.claim: (r.k_used, r.passages) for r in rs.import_evidence_csv(spark, path).collect()}
    assert back == {'say "x"': (2, ['a "q"', "b,c"]), "plain": (1, [])}


def test_k_distribution(spark):
    rows = spark.createDataFrame([(1,), (1,), (3,), (5,)], "k int")
    got = {r.k: (r.n_claims, r.share, r.distinct_k) for r in ev.k_distribution(rows).collect()}
    assert got == {1: (2, 0.5, 3), 3: (1, 0.25, 3), 5: (1, 0.25, 3)}


def test_stored_sentences_are_not_moved(spark):
    """The stored side of the join reads its buckets without an exchange; the result is that of plain tables."""
    sentences = spark.createDataFrame([(f"t{i % 9}", i // 9, f"text {i}") for i in range(900)], "title string, sent_id int, text string")
    path = scratch_path(spark, "sentences")
    stored = write_sentences(sentences, path, path.rsplit("/", 1)[1].replace("-", "_"), width(spark))
    cited = [(c, [[["1", "2", f"t{c % 11}", str(c * 7 % 120)], ["1", "3", f"t{c % 5}", "99"]]]) for c in range(300)]
    claims = spark.createDataFrame(cited, "claim_id long, evidence array<array<array<string>>>")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    plan = ev.resolve(claims, stored)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(threshold, before)
    scan = next(i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
    above = plan.splitlines()[:scan]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    # Up from the scan to the join that reads it: no exchange between them.
    at, steps = depth(plan.splitlines()[scan]), []
    for line in reversed(above):
        if depth(line) < at:
            at = depth(line)
            steps.append(line.strip(" :+-*"))
            if "Join" in line:
                break
    assert "Join" in steps[-1] and not any(s.startswith("Exchange") for s in steps)
    want = {r.claim_id: r.evidence_text for r in ev.resolve(claims, sentences).collect()}
    assert {r.claim_id: r.evidence_text for r in ev.resolve(claims, stored).collect()} == want and any(want.values())
