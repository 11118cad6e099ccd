"""Merkle manifest of a table with a witness for every row, built by appending.

Leaves are appended in order to a tree whose last subtrees are still open.  Each open subtree holds the partial witnesses of
its leaves; when a run of siblings completes, the witnesses below each of them grow by the others' digests and all go on to
the parent.  A tree is cut into aligned blocks of leaves that are appended in separate tasks; the roots of the blocks are
appended to the levels above in the same way, and so are the roots of the sources to the tree over all of them.  A leaf's
witness is that of its block, then that of its block's root, and so on.

Digests are SHA-256, and a parent's input are the lowercase hex digits of its children's digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.session import cut, width

# Children of a node; levels and leaves of a block.
ARITY, BLOCK_LEVELS = 3, 7
BLOCK = ARITY**BLOCK_LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# For each level the digests left and right of the node, as raw bytes one after the other.
WITNESS = "array<struct<left: binary, right: binary>>"


class OpenTree:
    """A tree that leaves are appended to; every open level has at most ``ARITY - 1`` nodes between two appends."""

    def __init__(self) -> None:
        self.witnesses: list[list[tuple[bytes, bytes]]] = []
        # By level: (digest, first leaf, leaf behind the last) of the nodes without a parent.
        self.open: list[list[tuple[bytes, int, int]]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._add(0, (digest, at, at + 1))

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The nodes of a level become a parent; each one's digest goes to the witnesses below the others."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for i, (_, first, end) in enumerate(run):
            step = (b"".join(digests[:i]), b"".join(digests[i + 1 :]))
            for leaf in range(first, end):
                self.witnesses[leaf].append(step)
        parent = sha256(b"".join([d.hex().encode() for d in digests])).digest()
        self._add(level + 1, (parent, run[0][1], run[-1][2]))

    def close(self, levels: int | None = None) -> bytes:
        """Complete what is open and return the root, ``levels`` above the leaves, or as soon as one node is left."""
        level = 0
        while True:
            if level == levels or levels is None and all(not nodes for nodes in self.open[level + 1 :]) and len(self.open[level]) == 1:
                return self.open[level][0][0]
            if self.open[level]:
                self._complete(level)
            level += 1


def leaf(text: Column | None = None) -> Column:
    """Digest of a row's fields: of each ``-`` if null, else the length in bytes, ``:`` and the value; ``text`` in place of its own."""
    values = [F.col(f).cast("string") if f != "text" or text is None else text for f in FIELDS]
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def ranked(nodes: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """``nodes`` (written) with their place ``rank`` in their tree, from 0, and its number ``size`` of nodes.

    The rows are dealt out by ranges of (tree, order), so a tree of any size is spread; each range counts its own rows of a
    tree, and the counts of earlier ranges are added from a table with a row for each tree and range.
    """
    keys = [F.asc_nulls_first(c) for c in tree + order]
    spread = nodes.repartitionByRange(width(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    schema = nodes.schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            places = []
            # The columns of the tree, or one tree if there are none.
            for now in zip(*[batch.column(c).to_pylist() for c in tree]) if tree else [()] * batch.num_rows:
                if now != last:
                    last, at = now, 0
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    counted = spread.mapInArrow(count, schema.add("place", "long"))
    counted = cut(counted.withColumn("part", F.spark_partition_id()))
    sizes = counted.groupBy(*tree, "part").agg((F.max("place") + 1).alias("n"))
    earlier = Window.partitionBy(*tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_{c}") for c in tree], F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy(*tree)).alias("size"),
    )
    same = F.col("part") == F.col("_part")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counted.join(offsets, same).select(*schema.names, (F.col("place") + F.col("before")).alias("rank"), "size")


def append_blocks(nodes: DataFrame, tree: str, carry: list[str]) -> DataFrame:
    """(tree, rank, size, digest, <carry>, root, witness) of nodes (tree, rank, size, digest, <carry>): one block is one group.

    ``root`` is the block's, ``witness`` the node's below it.  Blocks of a tree that has several are all closed at the same level.
    """
    names = [tree, "rank", "size", "digest", *carry]

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        grown = OpenTree()
        for digest in group.column("digest").to_pylist():
            grown.append(digest)
        root = grown.close(BLOCK_LEVELS if group.column("size")[0].as_py() > BLOCK else None)
        steps = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        witnesses = [[{"left": a, "right": b} for a, b in w] for w in grown.witnesses]
        columns = [*group.select(names).columns, pa.array([root] * len(group), pa.binary()), pa.array(witnesses, steps)]
        return pa.table(columns, names=[*names, "root", "witness"])

    kinds = dict(nodes.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + f", root binary, witness {WITNESS}"
    given = nodes.select(*names, F.floor(F.col("rank") / BLOCK).alias("block"))
    return given.groupBy(tree, "block").applyInArrow(build, schema)


def witnessed(nodes: DataFrame, tree: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """((tree, rank, digest, <carry>, witness) of all nodes, (tree, size, root) of all trees) for nodes (tree, rank, size, digest, <carry>).

    Level by level of blocks, each a ``BLOCK``-th of the one below; then witnesses are put together from the top.
    """
    floors, roots, level = [], None, nodes
    while True:
        built = cut(append_blocks(level, tree, carry if level is nodes else []))
        floors.append(built)
        level = built.where(F.col("rank") % BLOCK == 0).select(
            tree, F.floor(F.col("rank") / BLOCK).alias("rank"), F.floor((F.col("size") + BLOCK - 1) / BLOCK).alias("size"), F.col("root").alias("digest")
        )
        # Trees of one block are done: their block's root is their own.
        done = level.where("size = 1").select(tree, F.col("digest").alias("root"))
        roots = done if roots is None else roots.union(done)
        level = level.where("size > 1")
        if level.isEmpty():
            break
    above = None
    for built in reversed(floors):
        whole = built.drop("size", "root")
        if above is not None:
            upper = above.select(F.col(tree).alias("_tree"), F.col("rank").alias("_block"), F.col("witness").alias("_more"))
            inside = F.col(tree).eqNullSafe(F.col("_tree")) & (F.floor(F.col("rank") / BLOCK) == F.col("_block"))
            grown = F.concat("witness", F.coalesce("_more", F.array().cast(WITNESS))).alias("witness")
            whole = whole.join(upper, inside, "left").select(*[c for c in whole.columns if c != "witness"], grown)
        above = whole
    sizes = floors[0].where("rank = 0").select(F.col(tree).alias("_tree"), "size")
    return above, roots.join(sizes, F.col(tree).eqNullSafe(F.col("_tree"))).select(tree, "size", "root")


def folded(digest: Column, witness: Column) -> Column:
    """The root (hex) that a node's digest and witness lead to."""
    step = lambda d, w: F.sha2(F.concat(digits(w["left"]), d, digits(w["right"])).cast("binary"), 256)
    return F.aggregate(witness, digits(digest), step)


def proof_digest(witness: Column) -> Column:
    """Digest (hex) of all digests of a witness, level by level, left to right."""
    joined = F.array_join(F.transform(witness, lambda w: digits(F.concat(w["left"], w["right"]))), "")
    return F.sha2(joined.cast("binary"), 256)


def witness_table(docs: DataFrame, extra: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, leaf, <extra>, subroot, root, witness) of every row, (source, size, subroot, root) of every source).

    ``extra`` are further columns of ``docs`` to carry; digests are binary.  Null sources are a source of their own, before all
    others, which come by their bytes.  Within a source rows are in order of doc_id, null first; equal ids are in order of
    their leaves, so that repeated rows may take each other's place and lead to the same digests.  Texts of any length are
    digested where they are read and never moved.  An empty table gives no rows.
    """
    extra = extra or {}
    typed = docs.select(*[F.col(f).cast("long" if f in ("doc_id", "n_chars") else "string").alias(f) for f in FIELDS])
    leaves = cut(typed.select("source", "doc_id", leaf().alias("digest"), *[c.alias(n) for n, c in extra.items()]))
    placed = ranked(leaves, ["source"], ["doc_id", "digest"])
    below, subroots = witnessed(placed, "source", ["doc_id", *extra])
    subroots = cut(subroots.withColumnsRenamed({"size": "leaves", "root": "digest"}))
    top, root = witnessed(ranked(subroots, [], ["source"]).withColumn("all", F.lit(0)), "all", ["source", "leaves"])
    top = cut(top)
    total = [r.root for r in root.collect()]  # one row, or none
    root = F.lit(bytes(total[0]) if total else None).cast("binary").alias("root")
    upper = top.select(F.col("source").alias("_source"), F.col("digest").alias("subroot"), F.col("witness").alias("_more"))
    rows = below.join(upper, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), *extra, "subroot", root, F.concat("witness", "_more").alias("witness"))
    return rows, top.select("source", F.col("leaves").alias("size"), F.col("digest").alias("subroot"), root)


def verify(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, some of them tampered with; digests in hex.

    Where two divides the CRC-32 of the decimal doc_id, line feeds are taken out of the text before it is checked against the
    original witness; a null doc_id has no decimal and stays.  Other cases are those of ``witness_table``.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    seen = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows, _ = witness_table(docs, {"seen": leaf(seen)})
    out = rows.select(
        "doc_id", *[digits(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_digest(F.col("witness")).alias("proof_sha256"),
        folded(F.col("seen"), F.col("witness")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
