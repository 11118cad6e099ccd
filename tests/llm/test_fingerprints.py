"""SimHash components and scaled sketches against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assay.llm import simhash as simhash_module
from assay.llm.fingerprints import compare_with_edits, fingerprint, likeness, low, merged, near, shingles, sketch
from assay.llm.graph import components
from assay.llm.simhash import allocate, ball, linked_components, links, prefix_pairs, without_near_copies
from tests.llm.cases import no_documents, odd_documents, rows_of


def groups(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text, k=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_documents(spark):
    docs = odd_documents(spark)
    rows = [(k, simhash(t)) for k, t in rows_of(docs)]
    fps = sorted({f for _, f in rows})
    roots = groups(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for k, f in rows:
        if k is not None:
            least[roots[f]] = min(least.get(roots[f], k), k)
    want = Counter((k, f"{f:016x}", least.get(roots[f])) for k, f in rows)
    assert Counter(map(tuple, linked_components(docs).collect())) == want


def test_no_documents(spark):
    assert linked_components(no_documents(spark)).count() == 0
    assert compare_with_edits(no_documents(spark)).count() == 0
    assert without_near_copies(no_documents(spark)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 7])
def test_links_are_all_close_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(2**63), 2**63, 60)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 10), False))) for b in base for _ in range(6)]
    fps = sorted({*map(int, base), *near})
    got = Counter(frozenset(map(int, r)) for r in links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance).collect())
    want = Counter(frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
    assert got == want


def test_thresholds_add_up():
    cost, chosen = allocate([[0, 1, 10, 100], [0, 5, 6, 7], [0, 2, 30, 400]], 5)
    assert sum(t + 1 for t in chosen) == 5 and cost == 1 + 7 + 2 - 0 and chosen == [0, 2, 0]
    assert len(ball(0b1011, 2)) == 1 + 3 + 3


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_one_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    base = next(r.text for r in docs.where("doc_id = 5").collect())
    assert [r.doc_id for r in rows if (r.text or "").lower().startswith(base[:200])] .count(5) == 1
    ids = [r.doc_id for r in rows]
    assert 6 not in ids and 8 not in ids and None not in ids and ids.count(0) == 1 and 1 not in ids and 2 not in ids
    assert all(i in ids for i in range(16, 40))


@pytest.mark.parametrize("n", [100, 400])
def test_near_copies_by_exact_similarity(spark, n):
    """Pairs closely above and below the similarity: above, one of the two goes; below, both stay."""
    texts, similar = [], []
    for i in range(150):
        words = [f"d{i}w{k}" for k in range(n)]
        whole = {tuple(words[k : k + 5]) for k in range(n - 4)}
        drop = next(d for d in range(n) if len(whole) - d <= len(whole) * (0.8 if i % 2 else 0.785))
        cut_off = words[: n - drop + (i % 2)]  # a prefix: its shingles are a part of the whole
        texts += [" ".join(words), " ".join(cut_off)]
        similar.append((len(cut_off) - 4) / (n - 4) >= 0.8)
    assert 0 < sum(similar) < len(similar)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r.doc_id for r in without_near_copies(docs).select("doc_id").collect()}
    assert all(2 * i in ids for i in range(150))
    wrong = [i for i in range(150) if not similar[i] and 2 * i + 1 not in ids]
    missed = [i for i in range(150) if similar[i] and 2 * i + 1 in ids]
    assert not wrong and len(missed) <= 2


@pytest.mark.parametrize("big", [60, 2000])
def test_groups_equal_all_comparisons(spark, big):
    """A large group of near copies, chains and groups that share passages, against all pairs of whole shingle sets."""
    rng = np.random.default_rng(big)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    edited = lambda base, k: [w if i not in spots else f"e{rng.integers(10**9)}" for spots in [set(rng.integers(0, len(base), k).tolist())] for i, w in enumerate(base)]
    base, texts = words(120), []
    texts += [edited(base, int(rng.integers(0, 3))) for _ in range(big)]
    for _ in range(25):
        other = words(int(rng.integers(6, 200)))
        texts += [other, edited(other, 1), edited(other, 2), other[: int(len(other) * 0.85)], base[:60] + other]
    rng.shuffle(texts)
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for j, common in Counter(j for shingle in s for j in holders.get(shingle, ())).items():
            if find(i) != find(j) and common >= 0.8 * (len(s) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for shingle in s:
            holders.setdefault(shingle, []).append(i)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in without_near_copies(docs).collect()} == {find(i) for i in range(len(texts))}


@pytest.mark.parametrize("edits", [(3, 8), (0, 8)])
def test_pairs_of_a_large_group_that_are_no_links_stay_few(spark, monkeypatch, edits):
    """Copies that share bands, but are mostly too far apart: the pairs to compare grow with the group, not its square."""
    rng, n = np.random.default_rng(edits[0]), 500
    base, texts = [f"w{x}" for x in range(150)], []
    for _ in range(n):
        spots = set(rng.choice(150, rng.integers(*edits), False).tolist())
        texts.append([w for i, w in enumerate(base) for w in ([] if i in spots and rng.random() < 0.3 else [f"e{rng.integers(10**9)}"] if i in spots else [w])])
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if find(i) != find(j) and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    made, cut = [], simhash_module.cut
    monkeypatch.setattr(simhash_module, "cut", lambda df, *a: (out := cut(df, *a), made.append(out.count() if out.columns == ["a", "b"] else 0))[0])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in without_near_copies(docs).collect()} == {find(i) for i in range(n)}
    assert len({find(i) for i in range(n)}) > n / 4 and max(made) < 40 * n


def test_prefixes_meet_all_alike_sets(spark):
    """All pairs of alike sets with different roots are among the pairs, also of few shingles, equal sets and frequent shingles."""
    rng, sets = np.random.default_rng(5), []
    for size in (1, 2, 3, 4, 5, 6, 9, 10, 11, 40, 41, 90):
        for _ in range(4):
            whole = rng.choice(120 if size > 6 else 12, size, False).tolist()
            sets += [set(whole), {*whole[: max(1, int(size * 0.85))]}, {*whole[1:], 500 + len(sets)}, {*whole, 900 + len(sets)}, set(whole)]
    root = [int(r) for r in rng.integers(0, 40, len(sets))]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    rows = spark.createDataFrame([(i, r, sorted(s)) for i, (r, s) in enumerate(zip(root, sets))], "node long, root long, shingles array<long>")
    got = [tuple(r) for r in prefix_pairs(rows, 0.8).collect()]
    assert len(got) == len(set(got)) and len(alike) > 100 and alike <= set(got) and all(root[a] != root[b] and a < b for a, b in got)


def test_edits_and_next_documents(spark):
    docs = odd_documents(spark)
    found = compare_with_edits(docs).collect()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found)
    rows = sorted(rows_of(docs), key=lambda r: r[1].encode())
    rows.sort(key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)  # keeps the order of texts
    want, shares = Counter(), {}
    for i, (k, t) in enumerate(rows):
        third, after = len(t) // 3, rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - third] + after[:third]
        key = k, len(t), hashlib.sha256(edited.encode()).hexdigest()
        want[key] += 1
        shares.setdefault(key, []).append((contained(t, edited), contained(t, after)))
    assert got == want
    off = []
    for key, exact in shares.items():
        mine = sorted((r.near_edited, r.near_next) for r in found if (r.doc_id, r.n_chars, r.edited_sha256) == key)
        off += [abs(x - y) for a, b in zip(mine, sorted(exact)) for x, y in zip(a, b)]
    assert sum(off) / len(off) < 0.02 and max(off) < 0.2
    assert len({r.fingerprint for r in found if r.n_chars == 0}) <= 1


def contained(a, b):
    sets = []
    for text in (a, b):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    least = min(map(len, sets))
    return len(sets[0] & sets[1]) / least if least else float(not sets[0] and not sets[1])


def test_parts_of_any_length_are_contained(spark):
    """A part of 5 to 2,000 words of a long text, and a text of other words, by whole sets and by sketches alone."""
    words = [f"w{i}" for i in range(20000)]
    rows = [(n, " ".join(words), " ".join(words[100 : 100 + n])) for n in (5, 6, 10, 30, 100, 500, 1000, 2000)]
    rows += [(0, " ".join(words), " ".join(f"v{i}" for i in range(n))) for n in (5, 50, 2000)]
    hashed = spark.createDataFrame(rows, "n int, a string, b string").select("n", shingles(F.col("a")).alias("a"), shingles(F.col("b")).alias("b"))
    sides = hashed.select("*", low(F.col("a")).alias("x"), low(F.col("b")).alias("y"))
    for r in sides.select("n", near(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("near"), likeness(F.col("x"), F.col("y")).alias("by_sketch")).collect():
        assert r.near == (1 if r.n else 0) and r.by_sketch in (None, r.near)


def test_sketches_of_unequal_texts_merge(spark):
    """The union of a short and a long sketch is the sketch of the whole, but for the shingles across the joint."""
    words = [f"w{i}" for i in range(5000)]
    df = spark.createDataFrame([(" ".join(words[:40]), " ".join(words[40:]), " ".join(words))], "a string, b string, ab string")
    r = df.select(merged(sketch(F.col("a")), sketch(F.col("b"))).alias("m"), sketch(F.col("ab")).alias("ab")).first()
    assert set(r.m) <= set(r.ab) and len(r.ab) - len(r.m) <= 4


def test_sketches_compare_and_merge(spark):
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words), " ".join(words[:2000]), " ".join(words[2000:]), " ".join(f"v{i}" for i in range(3000)), "", "one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("s", sketch(F.col("text")))
    pair = df.alias("l").join(df.alias("r"), F.lit(True)).select(F.col("l.i").alias("a"), F.col("r.i").alias("b"), likeness(F.col("l.s"), F.col("r.s")).alias("x"))
    x = {(r.a, r.b): r.x for r in pair.collect()}
    assert x[0, 1] > 0.97 and x[0, 2] > 0.97 and x[1, 2] < 0.02 and x[0, 3] == 0 and x[4, 4] is None and x[4, 5] is None and x[5, 5] in (None, 1)
    parts = {r.i: r.s for r in df.collect()}
    both = df.where("i = 1").select("s").join(df.where("i = 2").select(F.col("s").alias("t")), F.lit(True)).select(merged(F.col("s"), F.col("t")).alias("m")).first().m
    assert set(both) <= set(parts[0]) and len(parts[0]) - len(both) <= 4  # the shingles across the cut
    assert 350 < len(parts[0]) < 650
    texts_of = {r.i: r.f for r in df.select("i", fingerprint(F.col("s")).alias("f")).collect()}
    assert texts_of[4] == "" and len(texts_of[0]) == 16 * len(parts[0])
