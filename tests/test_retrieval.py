import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assay.functions.uncertainty import with_budget
from assay.operators import retrieval as rt
from assay.plans import views as v
from assay.session import scratch_path

STOP = ["the", "of", "and", "is", "in"]


def terms(text):
    return [t for t in re.findall(r"\w{2,}", text.lower())]


def brute_force_search(queries, pages, limit):
    tf = {p: Counter(terms(t)) for p, t in pages}
    found = []
    for claim_id, query in queries:
        asked = set(terms(query))
        hits = [(sum(t in c for t in asked), sum(c[t] for t in asked), p) for p, c in tf.items()]
        hits = sorted((-m, -s, p) for m, s, p in hits if m)[:limit]
        found += [(claim_id, p, -m, -s, r) for r, (m, s, p) in enumerate(hits, 1)]
    return sorted(found)


@pytest.mark.parametrize("claim,query", [
    ("Taxes rose again", "Taxes rose again"),
    ("the cat and the dog chased the cat in the big garden", "cat dog chased big garden"),
    ("zeta beta alpha beta gamma delta epsilon zeta", "zeta beta alpha delta epsilon"),
    ("the of and is in the of", "the of and is in"),
    ("", ""),
])
def test_keyword_query(spark, claim, query):
    claims = spark.createDataFrame([(1, claim)], "claim_id long, claim string")
    assert rt.keyword_queries(claims, STOP).first()["query"] == query


@pytest.fixture(scope="module")
def small_corpus(spark, sf_dir):
    pages = v.corpus(spark, sf_dir)
    queries = rt.keyword_queries(v.probes(spark, sf_dir), v.STOPWORDS).select("claim_id", "query")
    return queries, pages, [tuple(r) for r in queries.collect()], [tuple(r) for r in pages.collect()]


@pytest.mark.parametrize("hot_pages", [0, 3, 20, 10**9])
def test_search_equals_brute_force_for_any_hot_bound(small_corpus, hot_pages):
    queries, pages, raw_queries, raw_pages = small_corpus
    got = rt.search_pages(queries, rt.postings(pages), hot_pages=hot_pages)
    got = sorted((r.claim_id, r.page_id, r.matched, r.tf_sum, r.page_rank) for r in got.collect())
    assert got == brute_force_search(raw_queries, raw_pages, 10)


def test_one_term_in_most_pages_and_copied_queries(spark):
    """A term that holds most postings, ties, and a third of all queries being the same."""
    pages = [(i, "common " + ("rare%d " % (i % 7)) * (i % 3 + 1) + ("second" if i % 2 else "")) for i in range(300)]
    queries = [(i, q) for i, q in enumerate(["common second"] * 20 + ["common rare%d" % (i % 9) for i in range(40)] + ["", "absent"])]
    qs = spark.createDataFrame(queries, "claim_id long, query string")
    ps = spark.createDataFrame(pages, "page_id long, extract string")
    want = brute_force_search(queries, pages, 10)
    for hot in (1, 50, 200, 1000):
        got = rt.search_pages(qs, rt.postings(ps), hot_pages=hot).collect()
        assert sorted((r.claim_id, r.page_id, r.matched, r.tf_sum, r.page_rank) for r in got) == want


def test_layout_does_not_matter(spark, small_corpus):
    queries, pages, _, _ = small_corpus
    results = [
        sorted(map(tuple, rt.search_pages(queries.repartition(n), rt.postings(pages.repartition(n)), hot_pages=30).collect()))
        for n in (1, 4, 16)
    ]
    assert results[0] == results[1] == results[2]


def test_stored_index_prunes_buckets(spark, small_corpus):
    queries, pages, raw_queries, raw_pages = small_corpus
    index = rt.write_index(pages, scratch_path(spark, "index"), buckets=8)
    got = rt.search_pages(queries, index, buckets=8)
    assert sorted((r.claim_id, r.page_id, r.matched, r.tf_sum, r.page_rank) for r in got.collect()) == brute_force_search(
        raw_queries, raw_pages, 10
    )


@pytest.mark.parametrize("block", [1, 3, 16, 10**6])
def test_block_search_equals_brute_force_for_any_block(spark, small_corpus, block):
    queries, pages, raw_queries, raw_pages = small_corpus
    index = rt.write_blocks(pages, scratch_path(spark, "blocks"), buckets=4, block=block)
    got = rt.search_blocks(queries, index, buckets=4).collect()
    assert sorted((r.claim_id, r.page_id, r.matched, r.tf_sum, r.page_rank) for r in got) == brute_force_search(
        raw_queries, raw_pages, 10
    )


def test_blocks_are_ordered_and_whole(spark, small_corpus):
    _, pages, _, raw_pages = small_corpus
    rows = rt.write_blocks(pages, scratch_path(spark, "blocks"), buckets=4, block=16).orderBy("term", "block").collect()
    got = {}
    for r in rows:
        assert 0 < r.n == len(r.entries) <= 16 and (r.top_page, r.top_tf) == tuple(r.entries[0])
        assert {e.tf for e in r.entries} == {r.top_tf} and sorted(r.entries) == r.entries
        assert tuple(r.block) == (-r.top_tf, r.top_page)
        got.setdefault(r.term, []).extend((-e.tf, e.page_id) for e in r.entries)
    want = {}
    for p, t in raw_pages:
        for term, n in Counter(terms(t)).items():
            want.setdefault(term, []).append((-n, p))
    assert {term: sorted(entries) for term, entries in got.items()} == {term: sorted(entries) for term, entries in want.items()}


def test_blocks_are_made_after_their_ids_are_dealt_out(spark, small_corpus):
    """A block is several times as wide as its ids: what is dealt out to buckets has no blocks yet."""
    _, pages, _, _ = small_corpus
    plan = rt.block_rows(pages, buckets=4, block=16)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions")
    assert "AS entries" in above and "AS entries" not in below and "AS block" not in below


def test_blocks_behind_the_floor_are_not_read(spark):
    """Common terms, ties and copied queries: exact, and few postings of the long lists meet a query."""
    pages = [(i, "common " * (i % 5 + 1) + ("rare%d " % (i % 100)) * (i % 3 + 1) + ("second " * (i % 4) if i % 2 else "")) for i in range(3000)]
    texts = ["common", "common second", "common second absent", "rare7 common second", "rare7", "absent", ""]
    queries = [(i, texts[i % len(texts)]) for i in range(21)]
    qs = spark.createDataFrame(queries, "claim_id long, query string")
    index = rt.write_blocks(spark.createDataFrame(pages, "page_id long, extract string"), scratch_path(spark, "blocks"), buckets=4, block=32)
    for limit in (1, 10, 5000):
        got = rt.search_blocks(qs, index, limit=limit, buckets=4).collect()
        assert sorted((r.claim_id, r.page_id, r.matched, r.tf_sum, r.page_rank) for r in got) == brute_force_search(queries, pages, limit)

    lists = index.groupBy("term").agg(F.sum("n").alias("pages"), F.max("top_tf").alias("top_tf"))
    asked = spark.createDataFrame([(q, t) for q, text in enumerate(texts) for t in set(text.split())], "query_id long, term string")
    found = brute_force_search([(q, text) for q, text in enumerate(texts) if text], pages, 10)
    floor = spark.createDataFrame([(q, m, s, p) for q, p, m, s, r in found if r == 10], "query_id long, matched long, tf_sum long, page_id long")
    met = asked.join(lists, "term")
    left = rt.surviving_blocks(met, index.select("term", "block", "top_tf", "top_page"), floor).join(index, ["term", "block"])
    rows = {r.query_id: r["sum(n)"] for r in left.groupBy("query_id").sum("n").collect()}
    before = {r.query_id: r["sum(pages)"] for r in met.groupBy("query_id").sum("pages").collect()}
    assert before[0] == 3000 and rows[0] <= 32  # one list, ended by its first block
    assert before[1] == 4500 and rows[1] <= 1500  # only the shorter list is gone through
    assert sum(rows.values()) < sum(before.values()) / 4


def brute_force_evidence(claims, pages, stop, threshold=0.25):
    """(claim id -> k passages) with the search of the keyword query and of the claim's start."""
    texts = dict(pages)
    out = {}
    for claim_id, claim, k, query in claims:
        found = brute_force_search([(claim_id, query)], pages, 10) or brute_force_search([(claim_id, claim[:100])], pages, 10)
        own = Counter(terms(claim))
        kept, n = [], 0
        for _, page, _, _, _ in sorted(found, key=lambda r: r[4]):
            ws = texts[page].split()
            for at in range(0, len(ws), 100):
                passage = " ".join(ws[at : at + 100])
                n += 1
                other = Counter(terms(passage))
                dot = sum(c * other[t] for t, c in own.items())
                scale = math.sqrt(sum(c * c for c in own.values()) * sum(c * c for c in other.values()))
                if scale and dot / scale >= threshold:
                    kept.append(passage)
        out[claim_id] = (k, kept[:k], len(found), n)
    return out


def test_retrieve_equals_brute_force(spark, sf_dir):
    claims = v.short_claims(spark, sf_dir).select("claim_id", "claim")
    pages = v.corpus(spark, sf_dir)
    got = rt.retrieve(claims, pages, stopwords=v.STOPWORDS, hedge=v.HEDGE, vague=v.VAGUE, hot_pages=40)
    got = {r.claim_id: (r.k_used, r.passages, r.n_candidates, r.n_passages) for r in got.collect()}
    raw = rt.keyword_queries(with_budget(claims, v.HEDGE, v.VAGUE), v.STOPWORDS)
    raw = [(r.claim_id, r.claim, r.k, r.query) for r in raw.collect()]
    assert got == brute_force_evidence(raw, [tuple(r) for r in pages.collect()], v.STOPWORDS)


def test_fallback_hit_miss_and_all_filtered(spark):
    pages = spark.createDataFrame(
        [(1, "the harbour office opened early"), (2, "words " * 150 + "zinc"), (3, " ")], "page_id long, extract string"
    )
    claims = spark.createDataFrame(
        [
            (10, "in of and the is early"),  # keyword "early": plain hit
            (11, "the and aa bb cc dd ee"),  # keywords unknown, "the" found by the second search
            (12, "qq ww ee rr tt yy uu"),  # nothing at all
            (13, "zinc aa bb cc dd ee ff gg"),  # page found, no passage similar enough
            (14, ""),
            (15, "in of and the is early"),  # copy of 10
        ],
        "claim_id long, claim string",
    )
    rows = {r.claim_id: r for r in rt.retrieve(claims, pages, stopwords=STOP).collect()}
    assert len(rows) == 6
    assert rows[10].n_candidates == 1 and not rows[10].used_fallback and rows[10].n_kept == 1
    assert rows[11].used_fallback and rows[11].n_candidates == 1
    assert rows[12].used_fallback and rows[12].n_candidates == 0 and rows[12].passages == []
    assert rows[13].n_candidates == 1 and rows[13].n_passages == 2 and rows[13].n_kept == 0
    assert rows[14].passages == [] and rows[14].n_candidates == 0
    assert rows[15].passages == rows[10].passages


def test_null_claims_keep_their_row(spark):
    pages = spark.createDataFrame([(1, "the harbour office opened early")], "page_id long, extract string")
    claims = spark.createDataFrame([(1, "in of and the is early"), (2, None), (3, None)], "claim_id long, claim string")
    rows = {r.claim_id: r for r in rt.retrieve(claims, pages, stopwords=STOP).collect()}
    assert sorted(rows) == [1, 2, 3] and rows[1].n_kept == 1 and rows[2].passages == [] == rows[3].passages


def letter_vectors(texts):
    return texts.withColumn("vector", F.array(*[(F.length("text") - F.length(F.translate("text", c, ""))).cast("float") for c in "aeiourstln"]))


def test_retrieve_with_an_encoder(spark):
    """Evidence by plugged-in vectors: page order, the claim's budget, a null claim, nothing similar, a shared page."""
    pages = [(1, "harbour " + "rust " * 250), (2, "harbour " + "eel " * 120), (3, "harbour")]
    claims = [(1, "the harbour rust rust rust rust"), (2, None), (3, "harbour eel eel eel eel"), (4, "harbour zzz"), (5, "harbour zzz")]
    got = rt.retrieve(
        spark.createDataFrame(claims, "claim_id long, claim string"), spark.createDataFrame(pages, "page_id long, extract string"),
        stopwords=STOP, encode=letter_vectors, threshold=0.9, k_min=2, k_max=2,
    )
    rows = {r.claim_id: r for r in got.collect()}

    def vector(text):
        return [(text or "").count(c) for c in "aeiourstln"]

    def cosine(a, b):
        scale = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / scale if scale else 0.0

    found = {(c, p): r for c, p, _, _, r in brute_force_search([(i, t or "") for i, t in claims], pages, 10)}
    for i, claim in claims:
        kept, n = [], 0
        for p in sorted((p for c, p in found if c == i), key=lambda p: found[i, p]):
            ws = dict(pages)[p].split()
            for at in range(0, len(ws), 100):
                n += 1
                if cosine(vector(claim), vector(" ".join(ws[at : at + 100]))) >= 0.9:
                    kept.append(" ".join(ws[at : at + 100]))
        assert (rows[i].passages, rows[i].n_passages, rows[i].k_used) == (kept[:2], n, 2)
    assert rows[1].n_kept == 2 and rows[2].n_kept == 0 and len(rows) == 5


def test_encoded_evidence_is_cut_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 2, "harbour")], "claim_id long, k int, claim string")
    found = spark.createDataFrame([(1, 1, 1)], "claim_id long, page_id long, page_rank int")
    pages = spark.createDataFrame([(1, "harbour")], "page_id long, extract string")
    plan = rt._encoded_kept_per_claim(rows, found, pages, letter_vectors, 100, 0.2, 5, "extract")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_passages_cover_the_whole_text(spark):
    text = "  " + "\n".join("w%d" % i for i in range(250)) + " "
    pages = spark.createDataFrame([(1, text), (2, "  "), (3, "one")], "page_id long, extract string")
    rows = sorted((r.page_id, r.chunk_no, r.text) for r in rt.passages(pages).collect())
    assert [(p, c) for p, c, _ in rows] == [(1, 0), (1, 1), (1, 2), (3, 0)]
    assert " ".join(t for p, _, t in rows if p == 1).split() == text.split()


def test_page_rank_cut_happens_before_the_shuffle(small_corpus):
    queries, pages, _, _ = small_corpus
    plan = rt.search_pages(queries, rt.postings(pages))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_dense_filter(spark):
    pairs = spark.createDataFrame(
        [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 1.0]), (3, [0.0, 0.0], [0.0, 1.0])],
        "claim_id long, claim_vector array<float>, passage_vector array<float>",
    )
    assert [r.claim_id for r in rt.dense_similar(pairs).collect()] == [1]


def test_index_counts_inside_the_row(spark):
    pages = spark.createDataFrame([(1, "Ab ab x AB_c é1 É1")], "page_id long, extract string")
    index = rt.postings(pages)
    assert sorted(map(tuple, index.collect())) == [("ab", 1, 2), ("ab_c", 1, 1), ("é1", 1, 2)]
    assert "Exchange" not in index._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot_pages", [3, 10**9])
def test_shuffled_postings_give_the_same(spark, small_corpus, hot_pages):
    """Without any broadcast."""
    queries, pages, raw_queries, raw_pages = small_corpus
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rt.search_pages(queries, rt.postings(pages), hot_pages=hot_pages).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.claim_id, r.page_id, r.matched, r.tf_sum, r.page_rank) for r in got) == brute_force_search(
        raw_queries, raw_pages, 10
    )


def test_hits_leave_a_slice_only_among_its_best(spark):
    """Rows of a search grow with queries and slices, not with hits; repeated and null page ids count as one page."""
    pages = [(i % 180, "common word%d " % (i % 5) + "common " * (i % 3)) for i in range(200)] + [(None, "common word1"), (None, "word1")]
    queries = [(q, t) for q in range(30) for t in ("common", "word%d" % (q % 5), "absent")] + [(7, "common")]
    read = rt.postings(spark.createDataFrame(pages, "page_id long, extract string"))
    query_terms = spark.createDataFrame(queries, "query_id long, term string")
    expected = {}
    for q, p, m, s in rt._score(query_terms.join(read, "term"), "query_id").collect():
        expected.setdefault(q, []).append((-m, -s, -1 if p is None else p))
    for slice_postings, block_queries in ((10**6, 10**6), (150, 7)):
        got, slices = {}, -(-read.count() // slice_postings)
        rows = rt.sliced_hits(query_terms, read, 4, slice_postings, block_queries).collect()
        assert len(rows) <= 30 * slices * 4
        for q, p, m, s in rows:
            got.setdefault(q, []).append((-m, -s, -1 if p is None else p))
        assert {q: sorted(x)[:4] for q, x in got.items()} == {q: sorted(x)[:4] for q, x in expected.items()}


def test_terms_of_a_page_are_counted_before_it_meets_claims(spark, sf_dir):
    """However many claims share a page: no pattern is matched on the rows of claims and candidates."""
    claims = spark.range(3).selectExpr("id AS claim_id", "'alpha beta gamma' AS claim")
    pages = spark.createDataFrame([(1, "alpha beta beta"), (2, "")], "page_id long, extract string")
    candidates = claims.selectExpr("claim_id", "1L AS page_id", "1 AS page_rank")
    scored = rt.scored_passages(claims, candidates, pages)
    assert {round(r.similarity, 6) for r in scored.collect()} == {round(3 / math.sqrt(15), 6)}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[: plan.index("Join")]


def test_cells_are_as_many_as_tasks_not_as_queries_times_pages():
    """Postings are copied per block of queries, queries and hits per group of slices: both are few, whatever the size."""
    assert rt.cells(480_000_000, 1_600_000, 24) == (120, 12, 2)
    assert rt.cells(8_000_000, 25_000, 16) == (16, 16, 1)
    assert rt.cells(600_000, 25_000, 16) == (3, 3, 6)
    assert rt.cells(0, 0, 16) == (1, 1, 16)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_the_best_of_many_slices(spark, monkeypatch, kind):
    """Slices of a group are gone through in one task; of pages that score the same the first ones count, a null before all others."""
    monkeypatch.setattr(rt, "EMIT_QUERIES", 7)
    pages = [(i, "common word%d " % (i % 5) + "common " * (i % 2)) for i in range(3000)] + [(None, "common common word3")]
    named = spark.createDataFrame(pages, "page_id long, extract string").withColumn("page_id", F.col("page_id").cast(kind))
    read = rt.postings(named)
    query_terms = spark.createDataFrame([(q, t) for q in range(40) for t in ("common", "word%d" % (q % 5))], "query_id long, term string")
    for block_queries in (10**6, 9):
        hits = rt.sliced_hits(query_terms, read, 3, slice_postings=50, block_queries=block_queries)
        assert hits.schema["page_id"].dataType == read.schema["page_id"].dataType
        expected = rt._best_pages(rt._score(query_terms.join(read, "term"), "query_id"), "query_id", 3)
        assert sorted(map(str, rt._best_pages(hits, "query_id", 3).collect())) == sorted(map(str, expected.collect()))
        if kind != "string":
            assert hits.count() <= 40 * 3 * 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("repeat", [False, True])
def test_texts_follow_chosen_passages(spark, repeat):
    """Passages are chosen by number; where an id stands for several pages, their own texts are kept and put in order."""
    words = " ".join(f"w{i}" for i in range(6))
    pages = [(1, words), (2, "w0 w1 x y w0 w2 z z w3 w4 w5 w0"), (3, "none of them")] + ([(1, "w0 w9 w1 w2 w3 q")] if repeat else [])
    claims = spark.createDataFrame([(7, words, 3), (8, "w0 w1", 1), (9, "else", 2)], "claim_id long, claim string, k int")
    found = spark.createDataFrame([(c, p, r) for c in (7, 8, 9) for p, r in ((2, 1), (1, 2), (3, 3))], "claim_id long, page_id long, page_rank int")
    frame = spark.createDataFrame(pages, "page_id long, extract string")
    kept = rt._kept_per_claim(claims, found, frame, 2, 0.2, 5, "extract")
    got = {r.claim_id: [tuple(e) for e in r.evidence] for r in kept.collect()}
    assert got[7] == [(2, 0, "w0 w1"), (2, 2, "w0 w2"), (2, 4, "w3 w4")]
    assert got[8] == [(2, 0, "w0 w1")] and got[9] == []
    claims = spark.createDataFrame([(7, words, 9)], "claim_id long, claim string, k int")
    (row,) = rt._kept_per_claim(claims, found, frame, 2, 0.2, 9, "extract").collect()
    own = [(1, 0, "w0 w1"), (1, 1, "w2 w3"), (1, 2, "w4 w5")]
    other = [(1, 0, "w0 w9"), (1, 1, "w1 w2"), (1, 2, "w3 q")] if repeat else []
    first = [(2, 0, "w0 w1"), (2, 2, "w0 w2"), (2, 4, "w3 w4"), (2, 5, "w5 w0")]
    assert [tuple(e) for e in row.evidence] == (first + own + other)[:9] and row.n_candidates == 3 + repeat


def test_texts_are_not_shuffled_with_every_pair(spark):
    """Ten pages of a claim keep ten passages each, of which one is evidence: the chosen texts alone are grouped by claim."""
    pages = [(p, " ".join(["same words here"] * 400)) for p in range(10)]
    claims = spark.createDataFrame([(c, "same words here", 1) for c in range(20)], "claim_id long, claim string, k int")
    found = spark.createDataFrame([(c, p, p + 1) for c in range(20) for p in range(10)], "claim_id long, page_id long, page_rank int")
    kept = rt._kept_per_claim(claims, found, spark.createDataFrame(pages, "page_id long, extract string"), 100, 0.2, 5, "extract")
    assert "page_rank" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert all(len(r.evidence) == 1 and r.evidence[0].page_id == 0 and r.n_passages == 120 for r in kept.collect())
