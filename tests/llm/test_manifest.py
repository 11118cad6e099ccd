"""Merkle manifest against whole trees built by plain Python."""

from hashlib import sha256
from zlib import crc32

import pytest

from assay.llm import merkle
from tests.llm.cases import no_documents, odd_documents


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        first = at // 3 * 3
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 3])
        at //= 3


def plain(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text)))
    trees = {s: levels([plain_leaf(r, r.text) for r in sources[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            proof = [*siblings(trees[s], i), *siblings(top, k)]
            tampered = r.doc_id is not None and r.text is not None and crc32(str(r.doc_id).encode()) % 2 == 0
            folded = plain_leaf(r, r.text.replace("\n", "") if tampered else r.text)
            for left, right in proof:
                folded = digest(left + folded + right)
            yield r.doc_id, trees[s][0][i], trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in proof)), folded, folded == top[-1][0]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def small_blocks(monkeypatch, count):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", count)
    monkeypatch.setattr(merkle, "BLOCK", 3**count)


@pytest.mark.parametrize("count", [1, 2, 7])
def test_odd_documents(spark, monkeypatch, count):
    """Nulls, copies, equal ids, clashing names; several blocks and levels of blocks."""
    small_blocks(monkeypatch, count)
    docs = odd_documents(spark)
    assert in_order(merkle.verify(docs).collect()) == in_order(plain(docs.collect()))


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = merkle.verify(docs).collect()
    assert in_order(got) == in_order(plain(docs.collect()))
    assert {r.verified for r in got} == {True, False}


def test_layout_does_not_matter(spark, monkeypatch):
    small_blocks(monkeypatch, 2)
    docs = odd_documents(spark)
    assert in_order(merkle.verify(docs.repartition(1)).collect()) == in_order(merkle.verify(docs.repartition(13)).collect())


def test_manifest_has_a_row_for_each_source(spark):
    docs = odd_documents(spark)
    rows, manifest = merkle.witness_table(docs)
    want = {(r.source, bytes(r.subroot), bytes(r.root)): 0 for r in manifest.collect()}
    sizes = {r.source: r["size"] for r in manifest.collect()}
    joined = docs.groupBy("source").count().collect()
    assert sizes == {r.source: r["count"] for r in joined} and len(want) == len(joined)
    assert rows.count() == docs.count()


def test_a_changed_row_is_found(spark):
    rows = [(1, "a", "en", 3, "one\ntwo"), (2, "a", "en", 3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = {r.doc_id: r.verified for r in merkle.verify(docs).collect()}
    assert got == {i: crc32(str(i).encode()) % 2 == 1 or "\n" not in t for i, _, _, _, t in rows}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.verify(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == digest("1:5----") and row.proof_sha256 == digest("")
    assert merkle.verify(no_documents(spark)).count() == 0


def test_open_tree_grows_as_a_whole_one():
    for n in range(1, 40):
        leaves = [digest(str(i)) for i in range(n)]
        grown = merkle.OpenTree()
        for leaf in leaves:
            grown.append(bytes.fromhex(leaf))
        tree = levels(leaves)
        assert grown.close().hex() == tree[-1][0]
        assert [[(a.hex(), b.hex()) for a, b in w] for w in grown.witnesses] == [list(siblings(tree, i)) for i in range(n)]
