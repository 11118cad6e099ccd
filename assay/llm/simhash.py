"""SimHash fingerprints and their links within a Hamming distance, found with the generalised pigeonhole principle.

The 64 bits are split into partitions, correlated bits together.  Each partition i gets its own threshold t_i, so that the
sum of all t_i + 1 is the distance + 1: two fingerprints within the distance then lie within t_i of each other in at
least one partition.  A dynamic program chooses the thresholds that make the fewest probes and estimated candidates.
Every fingerprint is stored under its bits of each partition and probes all values within t_i of them; what meets is
verified on all 64 bits.  Only distinct fingerprints take part, so exact copies cost one row however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import key_and_text, slices
from assay.llm.graph import components
from assay.session import cut, lasting, passing

BITS = 64
SEED = 42

# Bins of a min-hash signature, and the standard deviations below the wanted similarity at which a pair is dropped by it.
BINS, MARGIN = 256, 4.0

# Bands of min-hashes, and rows of each: a pair at similarity 0.8 has no band in common in (1 - 0.8 ** 8) ** 48 = 0.015 % of cases.
BANDS, BAND_ROWS = 48, 8

# Nodes of a group that all others of it are compared with first.
HUBS = 3

# Ratio of the sizes of neighbouring classes, by which sets of different groups meet.
SIZE_STEP = 1.02

# Cost of a probe (a row to shuffle) in candidates to verify.
PROBE_COST = 10


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of the lower-cased (A-Z) words of a text, repeats included."""
    from xxhash import xxh64_digest

    found = text.encode().lower().split()  # on bytes, both know ASCII only
    if not found:
        return np.zeros(0, ">u8")
    flat = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) < shingle_words:
        spans = [(0, len(flat))]
    else:
        starts = np.concatenate([[0], ends[: len(found) - shingle_words] + 1])
        spans = zip(starts.tolist(), ends[shingle_words - 1 :].tolist())
    return np.frombuffer(b"".join([xxh64_digest(flat[a:b], SEED) for a, b in spans]), ">u8")


def simhash(hashes: np.ndarray) -> int:
    """Fingerprint as a signed 64-bit number: a bit is set if it is in over half the hashes; none: zero."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp) of every document; a null text counts as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [simhash(shingle_hashes(t, shingle_words)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return key_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(make, "doc_id long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 by 64), summed over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().astype("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype("f4")
            n += len(bits)
            both += bits.T @ bits
        if n:
            i, j = np.divmod(np.arange(BITS * BITS + 1), BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.append(both.ravel(), n).astype("i8"))], ["i", "j", "c"]
            )

    rows = fps.select("fp").mapInArrow(count, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both = np.zeros((BITS + 1, BITS))
    for r in rows:
        both[r.i, r.j] = r.c
    return int(both[BITS, 0]), both[:BITS]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[int]:
    """Masks of ``parts`` partitions of near equal width; each takes in turn the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, masks = set(range(BITS)), []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        # Start from the bit that has the least to tell: near constant bits stay together.
        bits = [min(left, key=lambda b: (spread[b], b))]
        left.remove(bits[0])
        while len(bits) < size:
            best = max(left, key=lambda b: (related[b, bits].sum(), -b))
            bits.append(best)
            left.remove(best)
        masks.append(sum(1 << b for b in bits))
    return masks


def ball(mask: int, radius: int) -> list[int]:
    """All changes of at most ``radius`` bits within ``mask``."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]


def close_share(p: np.ndarray, mask: int) -> np.ndarray:
    """Chance that two fingerprints with independent bits differ in at most 0, 1, 2... bits of ``mask``."""
    exact = np.array([1.0])
    for b in range(BITS):
        if mask >> b & 1:
            q = 2 * p[b] * (1 - p[b])
            exact = np.append(exact * (1 - q), 0) + np.append(0, exact * q)
    return np.cumsum(exact)


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds with the least total cost.

    ``costs[i][u]`` is the cost of partition i with threshold u - 1 (u = 0: not probed); the u must add up to ``units``.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for u, more in enumerate(row[: units - used + 1]):
                if used + u not in step or cost + more < step[used + u][0]:
                    step[used + u] = (cost + more, [*chosen, u - 1])
        best = step
    return best[units]


def plan(fps: DataFrame, distance: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions to probe, for the distinct fingerprints ``fps``."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    ways = {m: group_bits(n, both, m) for m in range(2, distance + 2)} if distance else {1: [(1 << BITS) - 1]}
    masks = sorted({mask for way in ways.values() for mask in way})
    # Pairs that agree on all bits of a mask, counted over all fingerprints.
    keyed = fps.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, mask in enumerate(masks)
    ])).alias("k")).select("k.i", "k.key")
    same = keyed.groupBy("i", "key").agg(F.count("*").alias("c")).groupBy("i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    agree = {masks[r.i]: r.pairs for r in same.collect()}
    choices = []
    for way in ways.values():
        costs = []
        for mask in way:
            share, width = close_share(p, mask), mask.bit_count()
            row = [0.0]
            for t in range(min(distance, width) + 1):
                probes = sum(comb(width, r) for r in range(t + 1))
                row.append(max(agree.get(mask, 0), n * (n - 1) / 2 * share[0]) * share[t] / max(share[0], 1e-300) + PROBE_COST * max(n, 1) * (1 + probes))
            costs.append(row)
        cost, chosen = allocate(costs, distance + 1)
        choices.append((cost, [(mask, t) for mask, t in zip(way, chosen) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): all pairs of the distinct fingerprints ``fps`` that differ in at most ``distance`` bits, once each.

    Of two fingerprints with different bits in a partition, the one with the smaller bits probes for the other.
    """
    parts = plan(fps, distance)
    key = lambda mask: F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    stored = fps.select(F.col("fp").alias("b"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), key(mask).alias("key")) for i, (mask, _) in enumerate(parts)
    ])).alias("k")).select("b", "k.part", "k.key")

    def around(i: int, mask: int, t: int) -> Column:
        changes = F.array(*[F.lit(_signed(d)) for d in ball(mask, t)])
        keys = F.filter(F.transform(changes, lambda d: d.bitwiseXOR(key(mask))), lambda k: k >= key(mask))
        return F.transform(keys, lambda k: F.struct(F.lit(i).alias("part"), k.alias("key")))

    probes = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*[around(i, *p) for i, p in enumerate(parts)])).alias("k")).select("a", "k.part", "k.key")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    met = F.bit_count(differ) <= distance
    # Equal bits of the partition: the pair meets from both sides, once counts.  Several partitions: the first counts.
    first = F.lit(True)
    for i, (mask, t) in enumerate(parts):
        apart = F.bit_count(differ.bitwiseAND(F.lit(_signed(mask))))
        first = first & ((F.col("part") < i) | ((F.col("part") == i) & ((apart > 0) | (F.col("a") < F.col("b")))) | ((F.col("part") > i) & (apart > t)))
    return probes.join(stored, ["part", "key"]).where(met & first).select("a", "b")


def linked_components(docs: DataFrame, distance: int = 4, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``component_id`` is the smallest doc_id that links of at most ``distance`` bits lead to, the row's own included; null if
    no row there has a doc_id.  Texts without words have fingerprint zero and link like any other.  Repeated rows come back
    as often; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, shingle_words))
    firsts = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(firsts.select("fp"), distance), "a", "b")
    grouped = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = cut(grouped.join(smallest, "root").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def signature(hashes: np.ndarray) -> bytes:
    """A one-permutation min-hash of a shingle set: in each of ``BINS`` bins of the hashes, 16 bits of the smallest; 0: empty."""
    out = np.zeros(BINS, "<u2")
    if len(hashes):
        h = np.sort(hashes.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
        bins = (h & np.uint64(BINS - 1)).astype("i8")
        used, first = np.unique(bins, return_index=True)  # the first of a bin is its smallest
        out[used] = np.maximum((h[first] >> np.uint64(16)).astype("<u2"), 1)
    return out.tobytes()


def bands(hashes: list[np.ndarray]) -> np.ndarray:
    """``BANDS`` numbers for each of several shingle sets, each a mix of ``BAND_ROWS`` min-hashes; zeros for empty sets."""
    out = np.zeros((len(hashes), BANDS), "u8")
    some = [i for i, h in enumerate(hashes) if len(h)]
    if some:
        flat = np.concatenate([hashes[i] for i in some]).astype("u8")
        starts = np.concatenate([[0], np.cumsum([len(hashes[i]) for i in some])[:-1]])
        factors = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, BAND_ROWS, 2), "u8") * np.uint64(2) + np.uint64(1)
        for k in range(BANDS):
            mixed = np.zeros(len(some), "u8")
            for factor, mix in factors[k]:
                mixed = (mixed ^ np.minimum.reduceat(flat * factor, starts)) * mix
            out[some, k] = mixed ^ (mixed >> np.uint64(31))
    return out.view("i8")


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures don't speak against the similarity."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in ("sig_a", "sig_b"))
            either = ((x > 0) | (y > 0)).sum(axis=1)
            same = ((x == y) & (x > 0)).sum(axis=1)
            keep = pa.array(same >= similarity * either - MARGIN * np.sqrt(similarity * (1 - similarity) * either) - 1e-9)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: every member (key, node) of a key with the smallest node there, and with those of the least hashes."""
    of = Window.partitionBy("key")
    orders = [F.struct(F.lit(0).cast("long"), F.col("node"))] + [F.struct(F.xxhash64("node", F.lit(i)), F.col("node")) for i in range(1, HUBS)]
    hubs = F.array(*[F.min(o).over(of)["node"] for o in orders])
    pairs = members.select("node", hubs.alias("hubs")).select("node", F.explode(F.array_distinct("hubs")).alias("hub")).where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def mixed_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the members (key, node) of all keys whose members lie in different components (node, root), once each."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = Window.partitionBy("key")
    return placed.withColumn("low", F.min("root").over(of)).withColumn("high", F.max("root").over(of)).where("low < high").select("node", "root").distinct()


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: a superset of the pairs of sets (node, root, shingles) with different roots that reach ``similarity``.

    Prefix filter: two sets of x and y members reach it only with t = (x + y) * similarity / (1 + similarity) in common, so in
    one order of all shingles the first one in common has t - 1 others behind it in both.  Shingles with one root come first
    in that order, as no such pair has them in common, then rare ones.  Sets meet on a shingle and a class of sizes, so that
    a common shingle behind many rare ones meets only sets small enough for it; of its most frequent root no two sets meet.
    """
    share = similarity / (1 + similarity)
    size_class = lambda size: F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.log(F.lit(SIZE_STEP)))
    held = sets.select("node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    counts = held.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle", "n")
    ranked = held.join(counts, "shingle").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("ranked"))
    # Shingles behind the one at ``behind``, and it: at least t, which is least for the smallest set that may be alike.
    places = ranked.select("node", "root", "size", F.size("ranked").alias("m"), F.posexplode("ranked").alias("at", "of"))
    places = places.select("node", "root", "size", F.col("of.shingle").alias("shingle"), (F.col("m") - F.col("at")).alias("behind"))
    prefix = cut(places.where(F.col("behind") >= similarity * F.col("size") - 1e-9))
    most = prefix.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots"))
    prefix = prefix.join(most.where("roots > 1"), "shingle")
    smallest, largest = similarity * F.col("size") - 1e-9, F.col("behind") / share - F.col("size") + 1e-9
    probes = prefix.where("root <> top").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "size", "behind")], F.explode(F.sequence(size_class(smallest), size_class(F.greatest(largest, smallest)))).alias("class"))
    stored = prefix.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "size", "behind")], size_class(F.col("size").cast("double")).alias("class"))
    enough = F.least("behind_a", "behind_b") >= share * (F.col("size_a") + F.col("size_b")) - 1e-9
    met = probes.join(stored, ["shingle", "class"]).where((F.col("root_a") != F.col("root_b")) & enough)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def without_near_copies(docs: DataFrame, distance: int = 4, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest doc_id.

    Candidates are fingerprints within ``distance`` bits, and shingle sets with a band of min-hashes in common.  They are links
    if the share of common distinct shingles among all of both, counted on the whole sets, is at least ``similarity``; min-hash
    signatures only drop pairs far below it before that.  Groups are what links connect.  Of the sets with a band (or the whole
    fingerprint) in common, all are first compared with a few of them, so that a large group of copies falls together at the cost
    of its size; then those that lie in different groups so far meet by their rarest shingles (``prefix_pairs``), which loses no link.  A null doc_id comes after all others, equal ids in order of a digest of the text; of repeated rows one
    stays.  Null and empty texts are copies of each other.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes = [shingle_hashes(t, shingle_words) for t in part.column("text").to_pylist()]
            sets = [np.unique(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("key"), pa.array([simhash(h) for h in hashes], pa.int64()), pa.array([signature(h) for h in hashes], pa.binary()),
                    pa.array([sha256(h.tobytes()).digest()[:16] for h in sets], pa.binary()), pa.array(list(bands(sets)), pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "fp", "sig", "set", "bands"],
            )

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle_words)).astype("u8").view("i8") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    key = F.substring(F.unhex(F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)), 1, 16)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    with passing(docs.sparkSession):
        rows = cut(texts.mapInArrow(make, "doc_id long, key binary, fp long, sig binary, set binary, bands array<long>"))
        order = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("key"))
        grouped = rows.groupBy("fp", "set").agg(F.min(order).alias("first"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
        # Candidates are pairs of nodes that have a key in common: a band, or all bits of the fingerprint.
        keyed = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("key"))
        keyed = keyed.union(nodes.select("node", F.xxhash64(F.lit("fp"), "fp").alias("key")))
        members = cut(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "node"))
        # Fingerprints a few bits apart, each by the smallest of its nodes.
        ends = nodes.groupBy("fp").agg(F.min("node").alias("node"))
        near = links(nodes.select("fp").distinct(), distance)
        near = near.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

        def sets_of(some: DataFrame) -> DataFrame:
            """(node, shingles): whole shingle sets of distinct nodes (node), from one document for each."""
            named = nodes.join(some, "node").select("node", F.col("first.doc_id").alias("named_id"), F.col("first.key").alias("named_key"))
            sources = texts.join(named, (F.col("key") == F.col("named_key")) & F.col("doc_id").eqNullSafe(F.col("named_id"))).select("node", "text")
            return cut(sources.dropDuplicates(["node"]).mapInArrow(shingles, "node long, shingles array<long>"))

        def verified(pairs: DataFrame) -> DataFrame:
            """Those of the distinct pairs (a, b) that are links, by signatures and then by whole sets."""
            signed = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
            close = cut(signed.mapInArrow(lambda batches: _alike(batches, similarity), "a long, b long"))
            sets = sets_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
            both = close.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
            common, sizes = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
            return both.select("a", "b", common.alias("common"), sizes.alias("sizes")).where(F.col("common") >= similarity * (F.col("sizes") - F.col("common")) - 1e-9).select("a", "b")

        tried = cut(hub_pairs(members).union(near).distinct())
        linked = cut(verified(tried))
        mixed = cut(mixed_members(members, components(linked, "a", "b")))
        apart = prefix_pairs(sets_of(mixed.select("node")).join(mixed, "node"), similarity)
        rest = cut(apart.join(tried, ["a", "b"], "left_anti"))
        roots = components(linked.union(verified(rest)), "a", "b")
        grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        kept = lasting(grouped.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.key").alias("kept_key")))
        repeats = lasting(rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), key.alias("key"))
    same = (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id"))
    out = tagged.join(kept, same, "left_semi")
    if repeats.limit(1).count():
        out = out.join(repeats, same, "left_anti").union(out.join(repeats, same, "left_semi").dropDuplicates(["id", "key"]))
    return out.select("doc.*")
