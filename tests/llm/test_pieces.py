"""Piece ids and decoded texts against the library itself."""

import random
from hashlib import sha256

import pytest

from assay.llm.pieces import PrefixTable, decode_documents, default_model, encode_documents, encoder, merged, round_trip
from tests.llm.cases import no_documents, odd_documents, rows_of

PARTS = ["a", "b", " ", "  ", "the", "ing", " the", "é", "日", "本", "𐍈", "\n", "\t", "\x00", "▁", "<s>", "=", "====", "-", "e", "t", "h", "in", "　", "ﬁ", " " * 20, "___", "1", "23"]


@pytest.fixture(scope="module")
def model():
    return encoder(default_model()).model


def digest(text):
    return sha256(text.encode()).hexdigest()


def test_ids_equal_the_library(model):
    own, rng = encoder(default_model()), random.Random(3)
    pieces = [own.table.names[i] for i in sorted(own.table.names)]
    for _ in range(3000):
        for bag, most in ((PARTS, 40), (pieces, 6)):
            text = "".join(rng.choice(bag) for _ in range(rng.randint(0, most)))
            assert own.encode(text) == model.encode(text)
    for text in ("x" * 20_000, "the" * 5000, "=" * 3001, "\n" * 500, " " * 999, "日本語" * 2000):
        assert own.encode(text) == model.encode(text)


def test_given_and_odd_documents(spark, sf_dir, model):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_documents(spark)):
        want = []
        for key, text in rows_of(docs):
            ids = model.encode(text)
            want.append((key, len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids))))
        assert sorted(map(tuple, round_trip(docs).collect()), key=repr) == sorted(want, key=repr)


def test_documents_there_and_back(spark, model):
    docs = odd_documents(spark)
    encoded = encode_documents(docs)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=repr) == sorted(((k, model.encode(t)) for k, t in rows_of(docs)), key=repr)
    back = sorted(((r.doc_id, r.text) for r in decode_documents(encoded).collect()), key=repr)
    assert back == sorted(((k, model.decode(model.encode(t))) for k, t in rows_of(docs)), key=repr)


def test_no_documents(spark):
    assert round_trip(no_documents(spark)).count() == encode_documents(no_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_any_pieces_and_costs(seed):
    """Random vocabularies: equal costs, costs out of order, pieces that no text gives, characters that are no pieces."""
    rng = random.Random(seed)
    names = list("abc") + sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)})
    costs = [float(rng.randint(1, 12 if seed % 2 else 1000)) for _ in names]
    table = PrefixTable(dict(enumerate(names)), dict(enumerate(costs)))
    for _ in range(400):
        text = "".join(rng.choice("abcx") for _ in range(rng.randint(0, 14)))
        got = [names[t] if t >= 0 else chr(~t) for t in table.tokens(text)]
        assert got == merged(text, table.cost)[0]


def test_a_worker_forgets_and_stays_right(monkeypatch, model):
    from assay.llm import pieces

    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 5)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 5)
    own, rng = pieces.PieceEncoder(default_model()), random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choice("abcdeinst") for _ in range(rng.randint(1, 9))) for _ in range(12))
        assert own.encode(text) == model.encode(text)
