"""Exact removal of repeated byte strings with suffix sorting.

Every window of ``length`` bytes is assigned to the leftmost of the smallest hashes of its inner ``gram``-byte strings.
Equal windows have equal such strings, so a window can only repeat within the rows of one hash, and a stretch of text
around a hash that occurs once can't repeat at all.  The stretches ("pieces") of the other hashes are collapsed to
distinct ones with their counts, dealt to shards by hash, and each shard's suffixes are sorted by external induced sorting
(:mod:`assay.llm.induced`), which finds the windows that start more than once.  A hash whose distinct pieces are more than
a shard may hold is split further: its pieces are treated as texts of their own with a longer inner string, at last with
the window itself, where equal windows are one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import slices
from assay.llm.induced import END, repeated
from assay.session import cut, lasting, passing

# Bytes that make a repetition, and what part of them the first inner string has.
LENGTH, GRAM_PART = 400, 4

# Bytes of a shard on average, and of one hash's distinct pieces before the hash is split.
SHARD_BYTES, HASH_BYTES = 3 << 20, 3 << 20

_POSITION_BITS = 24

PIECE = "key binary, h long, s binary, at int, windows int, n long"


def digest(text: Column) -> Column:
    """First 16 bytes of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position."""
    power = h = _mix(data.astype("u8") + np.uint64(1))
    base, factor, size, total, out = 0x100000001B3, 0x100000001B3, 1, 0, None
    while True:
        if gram & size:
            # The lower part comes first, then the longer one already there is appended behind it.
            out, total = (power, size) if out is None else (out[: len(power) - total] * np.uint64(factor) + power[total : total + len(out)][: len(power) - total], total + size)
        size *= 2
        if size > gram:
            return _mix(out[: len(data) - gram + 1])
        power = power[: -(size // 2)] * np.uint64(pow(base, size // 2, 1 << 64)) + power[size // 2 :]
        factor = pow(base, size, 1 << 64)


def _sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest key among the ``width`` from every position; the leftmost of equal ones."""
    place = (np.arange(len(keys), dtype="u8")) & np.uint64((1 << _POSITION_BITS) - 1)
    least = (keys & ~np.uint64((1 << _POSITION_BITS) - 1)) | place
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least & np.uint64((1 << _POSITION_BITS) - 1)).astype("i8")


def pieces_of(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(text number, hash, start, windows) of every piece: a run of windows with the same chosen inner string.

    A piece covers the bytes from its start up to the end of its last window.  Texts shorter than ``length`` have none.
    """
    long = [(i, t) for i, t in enumerate(texts) if len(t) >= length]
    at = 0
    while at < len(long):
        # As many texts at once as positions can be told apart; one very long text goes in overlapping parts.
        group, size = [], 0
        while at < len(long) and (not group or size + len(long[at][1]) < 1 << 22):
            group.append(long[at])
            size += len(long[at][1])
            at += 1
        limit = (1 << _POSITION_BITS) - 1
        if size > limit:
            i, text = group[0]
            start = 0
            while start + length <= len(text):
                for _, h, place, windows in _pieces([(i, text[start : start + limit])], length, gram):
                    yield i, h, start + place, windows
                start += limit - length + 1
            continue
        yield from _pieces(group, length, gram)


def _pieces(group: list[tuple[int, bytes]], length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    data = np.frombuffer(b"".join(t for _, t in group), "u1")
    sizes = np.array([len(t) for _, t in group])
    starts = np.cumsum(sizes) - sizes
    hashes = _gram_hashes(data, gram)
    chosen = _sliding_argmin(hashes, length - gram + 1)
    inside = np.zeros(len(chosen) + 1, "i4")
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(starts + sizes - length + 1, len(chosen)), -1)
    valid = np.cumsum(inside[:-1]) > 0
    text_of = np.zeros(len(chosen), "i4")
    text_of[starts[1:]] = 1
    text_of = np.cumsum(text_of)
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (chosen[1:] != chosen[:-1]) | (text_of[1:] != text_of[:-1])
    first = np.nonzero(fresh)[0]
    # Windows of a piece: valid ones from its first up to the next piece's first or the end of its text.
    ends = np.minimum(np.append(first[1:], len(chosen)), (starts + sizes - length + 1)[text_of[first]])
    chosen_hash = hashes[chosen[first]].astype("i8")
    for k, h, a, b in zip(text_of[first].tolist(), chosen_hash.tolist(), first.tolist(), ends.tolist()):
        yield group[k][0], h, a - int(starts[k]), b - a


def _piece_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """All pieces of ``texts`` (key, text as bytes, n) with a digest of their bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data = part.column("text").to_pylist()
            found = list(pieces_of(data, length, gram))
            if not found:
                continue
            which = pa.array([x[0] for x in found], pa.int32())
            digests = [hashlib.blake2b(data[i][a : a + w + length - 1], digest_size=16).digest() for i, _, a, w in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key").take(which), pa.array([x[1] for x in found], pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.int32()), part.column("n").take(which),
                ],
                ["key", "h", "s", "at", "windows", "n"],
            )

    return texts.mapInArrow(find, PIECE)


def _bytes_of(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, s, n, windows, shard, text) of the wanted pieces; ``wanted`` has a list of them per key."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [
                (x["h"], x["s"], x["n"], x["windows"], x["shard"], text[x["at"] : x["at"] + x["windows"] + length - 1])
                for text, xs in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()) for x in xs
            ]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "s", "n", "windows", "shard", "text"])

    joined = texts.join(wanted, "key").select("text", "wanted")
    return joined.mapInArrow(fetch, "h long, s binary, n long, windows int, shard long, text binary")


def _sorted_shard(length: int):
    def sort(rows: pa.Table) -> pa.Table:
        pieces: dict[bytes, tuple] = {}
        for s, n, windows, text in zip(*(rows.column(c).to_pylist() for c in ("s", "n", "windows", "text"))):
            pieces.setdefault(s, (n, windows, text))  # repeated rows of one document bring a piece again
        data = np.frombuffer(b"".join(t + bytes([END]) for _, _, t in pieces.values()), "u1")
        valid, weight, at, places = np.zeros(len(data), bool), np.zeros(len(data), "i4"), 0, []
        for n, windows, text in pieces.values():
            valid[at : at + windows] = True
            weight[at : at + windows] = min(n, 2)
            places.append(at)
            at += len(text) + 1
        marked = repeated(data, valid, weight, length)
        runs = []
        for (_, windows, _), at in zip(pieces.values(), places):
            edge = np.diff(np.concatenate([[0], marked[at : at + windows].astype("i1"), [0]]))
            runs.append([{"a": a, "b": b} for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist())])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        out = pa.table({"s": pa.array(list(pieces), pa.binary()), "runs": pa.array(runs, kind)})
        return out.filter(pa.array([bool(r) for r in runs], pa.bool_()))

    return sort


def repeated_windows(every: DataFrame, once: DataFrame, length: int = LENGTH, gram: int | None = None, shard_bytes: int = SHARD_BYTES, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """(key, runs): for each distinct text, the runs [a, b) of window starts that occur twice or more among all texts.

    ``every`` has key (a digest of the text), text (bytes) and n (how often it counts); ``once`` has at least one row per key
    with key and text.  Keys without such windows have no row.
    """
    gram = gram or max(1, length // GRAM_PART)
    pieces = cut(_piece_rows(every, length, gram))
    shared = pieces.groupBy("h").agg(F.sum("n").alias("copies")).where("copies > 1").select("h")
    # A row per distinct place of a piece: copies of a text fall together before the shuffle.
    # Dealt anew by all of it, so that adaptive execution can split the join at a hash with very many pieces.
    place = ["h", "s", "key", "at", "windows"]
    places = cut(pieces.join(shared, "h").repartition(*place).groupBy(*place).agg(F.sum("n").alias("n")))
    distinct = cut(places.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min(F.struct("key", "at", "windows")).alias("one")))
    size = F.col("one.windows") + (length - 1)
    totals = distinct.groupBy("h").agg(F.sum(size).alias("bytes"))
    shards = max(1, -(-int(totals.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    large = gram < length
    hot = totals.where(F.col("bytes") > hash_bytes).select("h", F.lit(True).alias("hot")) if large else None
    split = bool(large and hot.limit(1).count())
    marked = distinct.join(hot, "h", "left") if split else distinct.withColumn("hot", F.lit(None).cast("boolean"))
    shard = F.when(F.col("hot"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards)))
    wanted = marked.groupBy(F.col("one.key").alias("key")).agg(
        F.collect_list(F.struct("h", "s", "n", F.col("one.at").alias("at"), F.col("one.windows").alias("windows"), shard.cast("long").alias("shard"))).alias("wanted")
    )
    fetched = _bytes_of(once, wanted, length)
    result = "s binary, runs array<struct<a:int,b:int>>"
    if split:
        fetched = cut(fetched)
    found = fetched.where("shard >= 0").groupBy("shard").applyInArrow(_sorted_shard(length), result)
    if split:
        inner = fetched.where("shard < 0").groupBy("s", "text").agg(F.max("n").alias("n")).select(F.col("s").alias("key"), "text", "n")
        finer = length - max(1, (length - gram) // 10) if gram < length - 10 else length
        found = found.union(repeated_windows(inner, inner, length, finer, shard_bytes, hash_bytes).select(F.col("key").alias("s"), "runs"))
    return (
        places.join(cut(found), "s").groupBy("key")
        .agg(F.collect_list(F.struct("at", "runs")).alias("found"))
        .select("key", F.flatten(F.transform("found", lambda f: F.transform(f.runs, lambda r: F.struct((f.at + r.a).alias("a"), (f.at + r.b).alias("b"))))).alias("runs"))
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans): by text digest, the byte spans [a, b) that repeated strings of ``length`` bytes cover."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t")).where(F.octet_length("t") >= length)
    rows = rows.select("doc_id", digest(F.col("t")).alias("key"), F.encode("t", "UTF-8").alias("text"))
    # Of each text, one document is read again for its bytes.
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    once = rows.join(first.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("key", "text")
    with passing(docs.sparkSession):
        windows = repeated_windows(rows.select("key", "text", F.lit(1).cast("long").alias("n")), once, length)
        return lasting(windows.select("key", F.transform("runs", lambda r: F.struct(r.a.alias("a"), (r.b + (length - 1)).alias("b"))).alias("spans")))


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint spans in order; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, length: int, carry: list[str]) -> DataFrame:
    """(doc, text, spans) of every row: the ``carry`` columns as a struct, the text and its spans."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col("text").alias("text"))
    keyed = rows.withColumn("key", digest(F.coalesce("text", F.lit(""))))
    return keyed.join(repeated_spans(docs, length), "key", "left").drop("key")


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; a null text has no bytes."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                data, spans, h, at = (text or "").encode(), _merge(found), hashlib.sha256(), 0
                for a, b in spans:
                    h.update(data[at:a])
                    at = b
                h.update(data[at:])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), h.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    rows = _with_spans(docs, length, ["doc_id"]).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(measure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut from ``text``; all columns stay.

    Where a cut would split a character, the whole character goes.  Null texts stay null, and repeated rows are cut alike.
    """
    columns = docs.columns
    others = [c for c in columns if c != "text"]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                if found and text:
                    data, at, kept = text.encode(), 0, []
                    for a, b in [*_merge(found), (len(data), len(data))]:
                        kept.append(data[at:a].decode(errors="ignore"))
                        at = b
                    text = "".join(kept)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    rows = _with_spans(docs, length, others)
    out = rows.mapInArrow(strip, rows.select("doc", "text").schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in columns])
