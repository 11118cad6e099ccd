"""Induced sorting and removal of repeated strings against brute force; the pipeline on a small corpus."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from assay.llm import induced, suffix_dedup
from assay.llm.induced import END, repeated, sorted_suffixes
from assay.llm.suffix_dedup import removal_digests, repeated_windows, without_repeats
from tests.llm.cases import no_documents, odd_documents, rows_of


def some_text(rng):
    parts = []
    for _ in range(rng.randint(1, 6)):
        letters = rng.choice([1, 2, 3, 26])
        parts.append(bytes(rng.choice(range(97, 97 + letters)) for _ in range(rng.randint(0, 60))))
        if rng.random() < 0.5:
            parts.append(rng.choice(parts) + parts[-1])
        if rng.random() < 0.2:
            parts.append(b"a" * rng.randint(1, 90))
    return parts


@pytest.mark.parametrize("seed", range(40))
def test_suffixes_and_common_prefixes(seed):
    rng = random.Random(seed)
    cap = rng.choice([3, 5, 8, 20, 40])
    parts = some_text(rng)
    raw = b"".join(p + b"\xff" for p in parts)
    text = np.frombuffer(raw, "u1")
    seen = 0
    for at, lcp in sorted_suffixes(text, cap, rng.choice([0, 10, 10**7])):
        heads = [raw[i : i + cap] for i in at.tolist()]
        assert heads == sorted(heads) or heads == sorted(heads, reverse=True)
        for i in range(1, len(at)):
            a, b = raw[at[i - 1] : at[i - 1] + cap], raw[at[i] : at[i] + cap]
            assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        seen += len(at)
    assert seen == len(text)
    valid, place = np.zeros(len(text), bool), 0
    for p in parts:
        valid[place : place + max(0, len(p) - cap + 1)] = True
        place += len(p) + 1
    weight = np.array([rng.choice([1, 1, 2]) for _ in range(len(text))])
    often = Counter()
    for i in np.nonzero(valid)[0]:
        often[raw[i : i + cap]] += weight[i]
    want = [bool(valid[i]) and often[raw[i : i + cap]] >= 2 for i in range(len(text))]
    assert repeated(text, valid, weight, cap, rng.choice([0, 10**7])).tolist() == want


def brute(texts, length):
    often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, last = np.zeros(len(t), bool), 0
        for i in range(len(t) - length + 1):
            if often[t[i : i + length]] > 1:
                gone[max(i, last) : i + length] = True
                last = i + length
        out.append(gone)
    return out


def digests(docs, length):
    rows = [(k, t.encode()) for k, t in rows_of(docs)]
    want = Counter()
    for (k, t), gone in zip(rows, brute([t for _, t in rows], length)):
        kept = bytes(np.frombuffer(t, "u1")[~gone])
        want[k, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype("i1")])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return want


def test_names_that_are_alone_are_not_sorted_again(monkeypatch):
    """Doubling goes on with the names that others share: a copied passage of 300 bytes, not 20,000 random ones around it."""
    rng = np.random.default_rng(5)
    noise, passage = rng.integers(1, 250, 20000, "u1"), rng.integers(1, 250, 300, "u1")
    text = np.concatenate([noise[:9000], passage, noise[9000:], passage, [END]]).astype("u1")
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(induced.np, "argsort", lambda a, **options: sizes.append(len(a)) or argsort(a, **options))
    padded = np.concatenate([text, np.zeros(16, "u1")])
    starts = np.nonzero((text[1:-1] < text[:-2]) & (text[1:-1] < text[2:]))[0] + 1
    order, shared = induced._sort_starred(len(text), induced._words(padded), starts, 200)
    whole = text.tobytes()
    assert all(whole[a : a + 200] <= whole[b : b + 200] for a, b in zip(order[:-1].tolist(), order[1:].tolist()))
    assert max(shared) == 200 and sum(n > len(starts) // 2 for n in sizes) <= 3


@pytest.mark.parametrize("length", [400, 150])
def test_removal(spark, length):
    docs = odd_documents(spark)
    assert Counter(map(tuple, removal_digests(docs, length).collect())) == digests(docs, length)
    assert removal_digests(no_documents(spark), length).count() == 0


@pytest.mark.parametrize("hash_bytes", [1000, 1 << 20])
def test_hot_hashes_are_split(spark, monkeypatch, hash_bytes):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcd ") for _ in range(130))
    texts = ["".join(rng.choice("efgh ") for _ in range(200)) + passage[: rng.randint(90, 130)] + "".join(rng.choice("ijkl ") for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = lambda every, once, length, gram=24, *_: repeated_windows(every, once, length, gram, 5000, hash_bytes)
    monkeypatch.setattr(suffix_dedup, "repeated_windows", small)
    assert Counter(map(tuple, removal_digests(docs, 100).collect())) == digests(docs, 100)


def test_texts_without_repeats(spark):
    docs = odd_documents(spark)
    cut_docs = without_repeats(docs, 400)
    assert cut_docs.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.kept) for r in cut_docs.collect())
    rows = docs.select("doc_id", "text", "kept").collect()
    gone = brute([(r.text or "").encode() for r in rows], 400)
    want = Counter()
    for r, g in zip(rows, gone):
        data = (r.text or "").encode()
        edges = np.nonzero(np.diff(np.concatenate([[1], g.astype("i1"), [1]])))[0].reshape(-1, 2)
        kept = "".join(data[a:b].decode(errors="ignore") for a, b in edges)
        want[r.doc_id, None if r.text is None else kept, r.kept] += 1
    assert got == want


def test_pipeline(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "suffix dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.select("doc_id").distinct().count() == before


def test_stages_on_odd_and_no_documents(spark, sf_dir):
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            docs = spark.createDataFrame(out.collect(), out.schema)
