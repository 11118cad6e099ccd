"""Token tables and packing against the tokenizer itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from assay.llm.packing import first_fit_decreasing, pack_documents
from assay.llm.token_orc import lookup, token_directory, write_tokens
from assay.llm.tokens import ChunkEncoder, default_vocabulary, document_ids
from assay.session import scratch_path
from tests.llm.cases import no_documents, odd_documents, rows_of


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_ids_equal_those_of_whole_texts(tokenizer):
    texts = ["", "a b", "It's don'T x_y-z!! ½²³", "<|endoftext|>b İstanbul ΣΑΣ \x1c\x85\xa0 q", "é 日本語" * 30, "z" * 300]
    assert [list(x) for x in document_ids(default_vocabulary(), texts, 1)] == [whole(tokenizer, t) for t in texts]


def test_token_table_round_trip(spark, tokenizer):
    docs = odd_documents(spark)
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_directory(spark, path).collect())
    want, start = [], 0
    for key, text in sorted(rows_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = np.array(whole(tokenizer, text), "<u4")
        want.append((start, key, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert [list(r.ids) for r in lookup(spark, path, [4]).collect()] == [whole(tokenizer, "two words")]


def test_lookup_reaches_the_files(spark):
    path = scratch_path(spark, "tokens")
    write_tokens(odd_documents(spark), path)
    plan = lookup(spark, path, [4])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in plan


def test_empty_token_table(spark):
    path = scratch_path(spark, "tokens")
    write_tokens(no_documents(spark), path)
    assert token_directory(spark, path).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 200):
        lengths = rng.integers(1, 101, n)
        bins, offsets = first_fit_decreasing(lengths, 100)
        room, want = [], np.zeros(n, int)
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(100)
            want[i] = k
            assert offsets[i] == 100 - room[k]
            room[k] -= lengths[i]
        assert (bins == want).all()


def test_packing_loses_nothing(spark, tokenizer):
    docs = odd_documents(spark)
    rows = pack_documents(docs, capacity=256).collect()
    want = defaultdict(int)
    for key, text in rows_of(docs):
        ids = np.array(whole(tokenizer, text), "<u4")
        for at in range(0, len(ids), 256):
            want[key, at, zlib.crc32(ids[at : at + 256].tobytes()), len(ids)] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.start, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(x for _, x in pieces[:k]) for k in range(len(pieces))]
        assert sum(x for _, x in pieces) <= 256
    assert sum(r.length for r in rows) / (256 * len(sequences)) > 0.95


def test_packing_nothing(spark):
    assert pack_documents(no_documents(spark)).count() == 0


def test_words_need_no_pattern(tokenizer):
    """Words with or without a mark are one or two pieces; the pattern is for all else."""
    letters = [chr(c) for c in range(0x21, 0x260) if chr(c).isalpha()]
    words = ["".join(letters[i : i + 3]) for i in range(0, len(letters), 3)]
    texts = [w + mark for w in [*words, *letters, "Word", "it's", "a1"] for mark in ("", ".", ",", "?", "'", "..")]
    assert [list(x) for x in document_ids(default_vocabulary(), texts, 1)] == [whole(tokenizer, t) for t in texts]
    coder, asked = ChunkEncoder(default_vocabulary()), []
    plain, coder.split = coder.split, lambda text: (asked.append(text), plain(text))[1]
    coder.encode(["Some words, über alles: yes! don't a1 Some"])
    assert asked == ["don't", "a1"]


def test_long_chunks_are_not_kept():
    coder = ChunkEncoder(default_vocabulary())
    coder.encode(["ab " + "z" * 300 + " " + "z" * 300 + ". ab", "é" * 90])
    assert list(coder.kept) == [b"ab"] and not coder.kept.long and not coder.pieces.long
