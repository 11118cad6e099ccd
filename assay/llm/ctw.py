"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions, each with a tree of its own over the bytes before it, most recent first, down to
``DEPTH``.  Every node has a Krichevsky-Trofimov estimate of its bit counts; weighting mixes, at each node, its own estimate
and what the nodes below it say, in proportion to how well either has coded the training texts.  The result is a log10
probability, or code length, per byte.

Texts are counted as (five bytes, next byte) pairs.  Contexts with the same two last bytes form a group of the trees' lower
part; the upper part is one group per decision.  A pair that no training text has takes part with zero counts.  For scoring,
workers read the probabilities of the most frequent pairs, a table of bounded size, and the rest is joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import key_and_text, slices
from assay.session import cut, scratch_path

DEPTH = 5

# Begins and ends a text; never part of UTF-8.
END = 0xFF

# Most entries of the tables that a worker reads.
TABLE_PAIRS, TABLE_WORDS = 6_000_000, 400_000

# Entries that a counting task gathers before it passes them on.
GATHERED = 1_500_000

_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series from x + 8 on."""
    x = np.asarray(x, "f8")
    below = np.ones_like(x)
    for k in range(8):
        below *= (x + k) / (8 + k)
    scale = sum(np.log(8.0 + k) for k in range(8))
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(below) - scale


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to a sequence with these bit counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def pair_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all pairs of some texts in a row, and where each text's first and last (its end) stand.

    A code has the preceding bytes, the last one first, and then the byte itself.
    """
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(b"".join(pad + t for t in texts) + bytes([END]), "u1").astype("i8")
    sizes = np.array([len(t) for t in texts], "i8")
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH  # of the code whose byte is the text's first
    n = len(data) - DEPTH
    codes = data[DEPTH:].copy()
    for k in range(1, DEPTH + 1):  # k-th byte back
        codes |= data[DEPTH - k : DEPTH - k + n] << (8 * (DEPTH + 1 - k))
    return codes, starts, starts + sizes


class _Level:
    """The nodes of one depth: rows are (context, byte) keys, and each of the eight decisions has its nodes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.nodes, self.zeros, self.ones, self.weighted, self.own = [], [], [], [], []
        byte = keys & 255
        for i in range(8):
            ids = ((keys >> 8) << 8) | ((byte | 256) >> (8 - i))  # the context, and the bits so far behind a leading 1
            fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
            node = np.cumsum(fresh) - 1
            bit = (byte >> (7 - i)) & 1
            self.nodes.append((ids[fresh], node))
            self.ones.append(np.bincount(node, counts * bit, fresh.sum()))
            self.zeros.append(np.bincount(node, counts * (1 - bit), fresh.sum()))
            self.own.append(log_kt(self.zeros[i], self.ones[i]))

    def weigh(self, below: "_Level | None", row_of: np.ndarray | None) -> None:
        for i in range(8):
            if below is None:
                self.weighted.append(self.own[i])
                continue
            ids, node = below.nodes[i]
            first_row = np.searchsorted(node, np.arange(len(ids)))
            parent = self.nodes[i][1][row_of[first_row]]
            inner = np.bincount(parent, below.weighted[i], len(self.own[i]))
            self.weighted.append(_HALF + np.logaddexp(self.own[i], inner))


def _levels(codes: np.ndarray, counts: np.ndarray, top: int) -> tuple[list[_Level], list[np.ndarray]]:
    """Levels from ``top`` down to DEPTH of sorted codes, weighed from below, and each level's row of the rows below it."""
    levels, rows = [_Level(codes, counts)], []
    for depth in range(DEPTH - 1, top - 1, -1):
        below = levels[0]
        # Drop the byte furthest back.
        keys = ((below.keys >> 16) << 8) | (below.keys & 255)
        unique, inverse = np.unique(keys, return_inverse=True)
        levels.insert(0, _Level(unique, np.bincount(inverse, below.counts, len(unique))))
        rows.insert(0, inverse)
    for k in range(len(levels) - 1, -1, -1):
        levels[k].weigh(levels[k + 1] if k + 1 < len(levels) else None, rows[k] if k < len(rows) else None)
    return levels, rows


def _kt(level: _Level, i: int) -> np.ndarray:
    return (level.ones[i] + 0.5) / (level.zeros[i] + level.ones[i] + 1.0)


def lower_part(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones, log weighted probability) of the nodes at depth 2 of sorted codes."""
    level = _levels(codes, counts, 2)[0][0]
    return tuple(np.concatenate(x) for x in ([n for n, _ in level.nodes], level.zeros, level.ones, level.weighted))


def upper_part(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the depth-2 nodes of one decision: what depths 0 and 1 say of a one bit, and the weight left for the depths below."""
    one = nodes >> 16  # the last byte
    keys, inverse = np.unique(one, return_inverse=True)
    a, b, inner = (np.bincount(inverse, x, len(keys)) for x in (zeros, ones, weighted))
    own = log_kt(a, b)
    mixed = _HALF + np.logaddexp(own, inner)
    root = log_kt(a.sum(), b.sum())
    root_weight = np.exp(_HALF + root - (_HALF + np.logaddexp(root, mixed.sum())))
    weight = np.exp(_HALF + own - mixed)
    said = root_weight * (b.sum() + 0.5) / (a.sum() + b.sum() + 1) + (1 - root_weight) * weight * (b + 0.5) / (a + b + 1)
    return said[inverse], ((1 - root_weight) * (1 - weight))[inverse]


def pair_scores(codes: np.ndarray, counts: np.ndarray, nodes: np.ndarray, said: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 probability of the byte of each sorted code, given what :func:`upper_part` says of the depth-2 ``nodes``."""
    levels, rows = _levels(codes, counts, 2)
    order = np.argsort(nodes)
    total = np.zeros(len(codes))
    for i in range(8):
        place = order[np.searchsorted(nodes, levels[0].nodes[i][0], sorter=order)]
        p, rest = said[place][levels[0].nodes[i][1]], left[place][levels[0].nodes[i][1]]
        for k, level in enumerate(levels):
            if k:
                p, rest = p[rows[k - 1]], rest[rows[k - 1]]
            node = level.nodes[i][1]
            weight = np.exp(_HALF + level.own[i] - level.weighted[i])[node] if k + 1 < len(levels) else 1.0
            p, rest = p + rest * weight * _kt(level, i)[node], rest * (1 - weight)
        bit = (codes >> (7 - i)) & 1
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


def held_out_column():
    """The fifth of the documents that no model learns from, by a checksum of their id."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def counted(rows: DataFrame) -> DataFrame:
    """(code, word, n): training counts of every pair of bytes that any text has, and of the words of training texts.

    ``rows`` has text and held_out.  One of ``code`` and ``word`` is null; the empty word stands for the end of a text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[pd.Series] = []
        words: Counter = Counter()
        gathered = 0
        for part in slices(batches):
            texts = [t.encode().lower() for t in part.column("text").to_pylist()]  # on bytes: A-Z only
            held = part.column("held_out").to_pylist()
            codes, starts, ends = pair_codes(texts)
            use = np.zeros(len(codes) + 1, "i4")
            learn = np.zeros(len(codes) + 1, "i4")
            for mark, chosen in ((use, np.ones(len(texts), bool)), (learn, ~np.array(held))):
                np.add.at(mark, starts[chosen], 1)
                np.add.at(mark, ends[chosen] + 1, -1)
            use, learn = np.cumsum(use[:-1]) > 0, np.cumsum(learn[:-1]) > 0
            ids, unique = pd.factorize(codes[use])
            pairs.append(pd.Series(np.bincount(ids, learn[use], len(unique)).astype("i8"), index=unique))
            gathered += len(unique)
            for text, out in zip(texts, held):
                if not out:
                    words.update(text.split())
                    words[b""] += 1
            if gathered > GATHERED or len(words) > GATHERED:
                yield from _count_rows(pairs, words)
                pairs, words, gathered = [], Counter(), 0
        yield from _count_rows(pairs, words)

    return rows.mapInArrow(count, "code long, word binary, n long").groupBy("code", "word").agg(F.sum("n").alias("n"))


def _count_rows(pairs: list[pd.Series], words: Counter) -> Iterator[pa.RecordBatch]:
    if pairs:
        joined = pd.concat(pairs)
        ids, unique = pd.factorize(joined.index.to_numpy())
        n = np.bincount(ids, joined.to_numpy(), len(unique)).astype("i8")
        for at in range(0, len(n), 200_000):
            part = slice(at, at + 200_000)
            size = len(n[part])
            yield pa.RecordBatch.from_arrays([pa.array(unique[part]), pa.nulls(size, pa.binary()), pa.array(n[part])], ["code", "word", "n"])
    found = list(words.items())
    for at in range(0, len(found), 200_000):
        part = found[at : at + 200_000]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["code", "word", "n"]
        )


def resolved(pairs: DataFrame) -> DataFrame:
    """(code, n, score): the log10 probability of every pair of ``pairs`` (code, n)."""
    pairs = pairs.withColumn("group", F.shiftright("code", 8 * (DEPTH - 1)))

    def lower(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("code")
        nodes, zeros, ones, weighted = lower_part(rows.column("code").to_numpy(), rows.column("n").to_numpy().astype("f8"))
        return pa.table({"node": nodes, "zeros": zeros, "ones": ones, "weighted": weighted})

    def upper(rows: pa.Table) -> pa.Table:
        said, left = upper_part(*(rows.column(c).to_numpy() for c in ("node", "zeros", "ones", "weighted")))
        return pa.table({"node": rows.column("node"), "said": said, "left": left})

    def score(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("code")
        codes, n = rows.column("code").to_numpy(), rows.column("n")
        found = pair_scores(codes, n.to_numpy().astype("f8"), *(above.column(c).to_numpy() for c in ("node", "said", "left")))
        return pa.table({"code": codes, "n": n, "score": found})

    below = cut(pairs.groupBy("group").applyInArrow(lower, "node long, zeros double, ones double, weighted double"))
    # 255 decisions, each with at most 65,536 nodes at depth 2.
    above = below.groupBy(F.col("node").bitwiseAND(F.lit(255)).alias("decision")).applyInArrow(upper, "node long, said double, left double")
    above = above.withColumn("group", F.shiftright("node", 8))
    return pairs.groupBy("group").cogroup(above.groupBy("group")).applyInArrow(score, "code long, n long, score double")


def _frequent(counts: DataFrame, most: int) -> int:
    """The smallest power of two so that at most ``most`` rows have a count of at least that; zero if all have room."""
    size = F.when(F.col("n") > 0, F.floor(F.log2(F.col("n").cast("double"))) + 1).otherwise(0)
    rows = {r.k: r.c for r in counts.groupBy(size.cast("int").alias("k")).agg(F.count("*").alias("c")).collect()}  # 64 at most
    total, least = 0, 65
    while least > 0 and total + rows.get(least - 1, 0) <= most:
        least -= 1
        total += rows.get(least, 0)
    return 0 if least == 0 else 1 << (least - 1)


# The tables of the run that a worker is on: (kind, path) and the table.
_TABLES: dict[str, tuple[str, object]] = {}


def _read(path: str, columns: list[str]) -> pa.Table:
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    names = sorted(f.path for f in where.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(n, columns=columns, filesystem=where) for n in names])


def _kept(kind: str, path: str, make) -> object:
    """A worker's table of a kind, read once; the one of an earlier run goes first."""
    if _TABLES.get(kind, ("",))[0] != path:
        _TABLES.pop(kind, None)
        _TABLES[kind] = path, make(path)
    return _TABLES[kind][1]


def _pair_table(path: str) -> tuple[pd.Index, np.ndarray]:
    rows = _read(path, ["code", "score"])
    return pd.Index(rows.column("code").to_numpy()), np.append(rows.column("score").to_numpy(), np.nan)


def _word_table(path: str) -> dict[bytes, int]:
    rows = _read(path, ["word", "n"])
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()))


def _store(df: DataFrame, spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return path


def score_documents(docs: DataFrame, table_pairs: int = TABLE_PAIRS, table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, n_bytes, base_score, score, bits_per_byte) of every row.

    ``score`` is the model's log10 probability of the text with A-Z in lower case, its end included, and ``bits_per_byte``
    the code length over bytes and end.  ``base_score`` is the word model's.  Null text counts as empty, a null doc_id as the
    empty string where folds are dealt; repeated rows are scored alike.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = key_and_text(docs).withColumn("held_out", held_out_column())
    counts = cut(counted(rows.select("text", "held_out")))
    pairs = cut(resolved(counts.where("code is not null").select("code", "n")))
    words = counts.where("word is not null").select("word", "n")
    train = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = int(train[0]), int(train[1])
    least_pair, least_word = _frequent(pairs, table_pairs), _frequent(words, table_words)
    pair_path = _store(pairs.where(F.col("n") >= least_pair).select("code", "score"), spark, "pairs")
    word_path = _store(words.where(F.col("n") >= least_word), spark, "words")
    scale = np.log10(total + 0.5 * (distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values = _kept("pairs", pair_path, _pair_table)
        known = _kept("words", word_path, _word_table)
        for part in slices(batches):
            texts = [t.encode().lower() for t in part.column("text").to_pylist()]
            codes, starts, ends = pair_codes(texts)
            ids, unique = pd.factorize(codes)
            each = values[index.get_indexer(unique)]
            rare = np.isnan(each)
            each[rare] = 0
            scored = each[ids]
            sums = np.add.reduceat(np.append(scored, 0), np.stack([starts, ends + 1], 1).ravel())[::2]
            out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base_score", "rare_pairs", "rare_words")}
            some_rare = rare.any()
            for k, text in enumerate(texts):
                tokens = text.split()
                tokens.append(b"")
                n = list(map(known.get, tokens))
                missing = Counter(t for t, c in zip(tokens, n) if c is None) if None in n else {}
                have = np.array([c for c in n if c is not None], "f8")
                out["n_tokens"].append(len(tokens))
                out["n_known"].append(len(have))
                out["base_score"].append(float((np.log10(have + 0.5) - scale).sum()))
                out["rare_words"].append([{"word": w, "k": c} for w, c in missing.items()])
                pairs_here = codes[starts[k] : ends[k] + 1][rare[ids[starts[k] : ends[k] + 1]]] if some_rare else ()
                out["rare_pairs"].append([{"code": c, "k": n} for c, n in Counter(np.asarray(pairs_here, "i8").tolist()).items()])
            kinds = {
                "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(),
                "rare_pairs": pa.list_(pa.struct([("code", pa.int64()), ("k", pa.int64())])),
                "rare_words": pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])),
            }
            given = [part.column(c) for c in ("row", "doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays(
                [*given, pa.array([len(t) for t in texts], pa.int64()), pa.array(sums), *[pa.array(out[c], t) for c, t in kinds.items()]],
                ["row", "doc_id", "held_out", "n_bytes", "score", *kinds],
            )

    schema = (
        "row long, doc_id long, held_out boolean, n_bytes long, score double, n_tokens long, n_known long, base_score double, "
        "rare_pairs array<struct<code:long,k:long>>, rare_words array<struct<word:binary,k:long>>"
    )
    numbered = rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id())
    first = cut(numbered.mapInArrow(score, schema))
    # What the workers' tables don't have: words and pairs below the bounds, and words that no training text has.
    rest_words = (
        first.select("row", F.explode("rare_words").alias("x")).select("row", "x.word", "x.k").join(words, "word", "left")
        .withColumn("c", F.coalesce("n", F.lit(0)))
        .groupBy("row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"),
            F.sum(F.col("k") * (F.log10(F.col("c") + 0.5) - F.lit(float(scale)))).alias("more_base"),
        )
    )
    rest_pairs = (
        first.select("row", F.explode("rare_pairs").alias("x")).select("row", "x.code", "x.k").join(pairs.select("code", F.col("score").alias("s")), "code")
        .groupBy("row").agg(F.sum(F.col("k") * F.col("s")).alias("more_score"))
    )
    joined = first.drop("rare_words", "rare_pairs").join(rest_words, "row", "left").join(rest_pairs, "row", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    score_column = F.col("score") + more("more_score")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), "n_bytes", (F.col("base_score") + more("more_base")).alias("base_score"),
        score_column.alias("score"), (-score_column / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
