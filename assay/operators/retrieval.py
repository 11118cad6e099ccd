"""Corpus search, passage cutting, similarity filter and adaptive top-k.

Data flow: claims give keyword queries; queries meet the corpus through index
terms; each claim keeps its best pages; pages are cut into passages next to
their claim; passages that are similar enough survive in page order; the first
``k`` of them are the evidence, with ``k`` taken from the claim's own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import text as tx
from assay.functions import vectors as vx
from assay.functions.uncertainty import with_budget
from assay.lexicons import HEDGE_WORDS, VAGUE_WORDS
from assay.session import cut, release, width

PAGES_PER_QUERY = 10
# Adds ``vector`` for the column ``text`` and keeps the other columns.
Encoder = Callable[[DataFrame], DataFrame]

PASSAGE_WORDS = 100
PASSAGES = "array<struct<page_id:bigint,chunk_no:int,text:string>>"
MIN_SIMILARITY = 0.25
FALLBACK_CHARS = 100
# Neighbouring pages that share the blocks of the impact-ordered index.
BLOCK_PAGES = 1024
# Postings of a slice of pages, at most and at least, queries that a task holds with their best pages, and those whose hits it returns at a time.
SLICE_POSTINGS, LEAST_POSTINGS = 4_000_000, 250_000
BLOCK_QUERIES, EMIT_QUERIES = 1_000_000, 10_000
# Stands for a null id among whole numbers.
LEAST_ID = -(1 << 63)
# In a page's score for a query, one matched term counts for more than any sum of term counts.
MATCHED = 1 << 40


def keyword_queries(claims: DataFrame, stopwords: Sequence[str], top: int = 5) -> DataFrame:
    """Add ``query``, the keyword query of each claim."""
    return claims.withColumn("query", tx.keywords(F.col("claim"), stopwords, top))


def postings(pages: DataFrame, text: str = "extract") -> DataFrame:
    """The inverted index ``(term, page_id, tf)``.

    Terms are counted inside each page's row, so indexing is one scan and
    no shuffle, whatever the size of the corpus.
    """
    entry = F.explode(tx.counted(tx.terms(F.col(text)))).alias("entry")
    return pages.select("page_id", entry).select(
        F.col("entry.term").alias("term"), "page_id", F.col("entry.n").cast("long").alias("tf")
    )


def write_index(pages: DataFrame, path: str, buckets: int = 256, text: str = "extract") -> DataFrame:
    """Write the index as a table partitioned by a hash bucket of the term and read it back.

    The rebalance hint lets adaptive execution split the bucket of a very
    common term over many files and merge small ones.  Searches that join on
    ``bucket`` and ``term`` read only the buckets they ask for.
    """
    table = postings(pages, text).withColumn("bucket", term_bucket(F.col("term"), buckets))
    table.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return pages.sparkSession.read.parquet(path)


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _best_pages(hits: DataFrame, group: str, limit: int) -> DataFrame:
    """Rank pages per group.  The constant bound makes Spark cut each partition
    to ``limit`` rows per group before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc("matched"), F.desc("tf_sum"), "page_id")
    return hits.withColumn("page_rank", F.row_number().over(order)).where(F.col("page_rank") <= limit)


def search_pages(
    queries: DataFrame,
    index: DataFrame,
    limit: int = PAGES_PER_QUERY,
    hot_pages: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Up to ``limit`` pages per claim: ``(claim_id, page_id, matched, tf_sum, page_rank)``.

    ``queries(claim_id, query)``; ``index(term, page_id, tf)``.  Pages are ranked
    by the number of query terms they contain, then by the sum of their counts,
    then by id.  Blank queries find nothing.

    Equal queries are ranked once.  The index is scanned once, for the terms asked
    for.  Queries meet slices of the pages, and only the best pages of each slice are
    shuffled: see :func:`sliced_hits`.  With ``hot_pages`` postings are joined with
    queries, but for terms in more pages than that: see :func:`_rank_with_hot_terms`.
    Pass ``buckets`` for an index written by :func:`write_index` so that unread
    buckets are pruned.
    """
    owners, wanted = _asked(queries)
    query_terms = wanted.select("query_id", F.explode("asked").alias("term"))

    terms_asked = query_terms.select("term").distinct()
    keys = ["term"]
    if buckets is not None:
        terms_asked = terms_asked.withColumn("bucket", term_bucket(F.col("term"), buckets))
        keys = ["bucket", "term"]
    read = cut(index.join(terms_asked, keys, "left_semi").select("term", "page_id", "tf"))

    if hot_pages is None:
        hits = sliced_hits(query_terms, read, limit)
    else:
        hot = read.groupBy("term").agg(F.count("*").alias("pages")).where(F.col("pages") > hot_pages)
        hot = cut(hot.select("term"))
        if hot.isEmpty():
            hits = _score(_meet(query_terms, read), "query_id")
        else:
            hits = _rank_with_hot_terms(query_terms, read, hot, limit)
    ranked = _best_pages(hits, "query_id", limit)
    return (
        owners.join(wanted.select("query_key", "query_id"), "query_key")
        .join(ranked, "query_id")
        .select("claim_id", "page_id", "matched", "tf_sum", "page_rank")
    )


def sliced_hits(
    query_terms: DataFrame, read: DataFrame, limit: int, slice_postings: int = SLICE_POSTINGS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """``(query_id, page_id, matched, tf_sum)``: each query's best ``limit`` pages of every group of slices of the pages.

    ``query_terms(query_id, term)``, ``read(term, page_id, tf)``.  A slice holds all postings of its pages, ``slice_postings`` about or
    less.  A cell is a group of slices and a block of queries: its task has the queries and their best pages so far in memory and goes through the slices.
    Postings are copied per block, queries and hits per group, and there are only as many groups as tasks are
    wanted: shuffled bytes don't grow with queries times pages, as they would with a join or with hits of each slice.
    """
    spark = read.sparkSession
    asked = cut(query_terms.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.collect_list("term").alias("terms")))
    slices, groups, blocks = cells(read.count(), asked.count(), 2 * spark.sparkContext.defaultParallelism, slice_postings, block_queries)
    part = F.pmod(F.xxhash64("page_id"), F.lit(slices)).cast("int").alias("slice")
    lists = cut(read.groupBy(part, "term").agg(F.collect_list(F.struct("page_id", "tf")).alias("entries")))
    release(spark)

    def cell(group: Column) -> Column:
        return (group * blocks + F.col("block")).cast("long").alias("cell")

    # A cell's rows are few bytes for its work, so cells are dealt out by number, not by size.
    every_block, every_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, groups))
    copied = lists.select("slice", "term", "entries", every_block.alias("block")).select(
        cell(F.col("slice") % groups), "slice", "term", F.col("entries.page_id").alias("ids"), F.col("entries.tf").alias("tfs")
    )
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    # A cell's queries come before its slices.
    placed = asked.select("query_id", "terms", block, every_group.alias("group")).select(
        cell(F.col("group")), F.lit(-1).alias("slice"), "query_id", "terms"
    )
    dealt = copied.unionByName(placed, allowMissingColumns=True).repartition(2 * groups * blocks, "cell").sortWithinPartitions("cell", "slice")
    kinds = {"query_id": asked.schema["query_id"].dataType, "page_id": read.schema["page_id"].dataType, "matched": T.LongType(), "tf_sum": T.LongType()}
    return dealt.mapInArrow(_ranked_cells(limit), T.StructType([T.StructField(c, t) for c, t in kinds.items()]))


def cells(
    postings: int, queries: int, tasks: int, slice_postings: int = SLICE_POSTINGS, block_queries: int = BLOCK_QUERIES
) -> tuple[int, int, int]:
    """Slices of the pages, groups of slices and blocks of queries, so that there are ``tasks`` cells or more.

    Blocks copy the postings, which are most of the bytes: queries are only split where a task could not hold them or slices would be very small.
    """
    slices = max(1, -(-postings // slice_postings), min(tasks, -(-postings // min(slice_postings, LEAST_POSTINGS))))
    blocks = max(1, -(-queries // block_queries), -(-tasks // slices))
    return slices, min(slices, -(-tasks // blocks)), blocks


def _ranked_cells(limit: int):
    """Ranks the pages of each cell's slices for the queries that come before their posting lists."""

    def index(lists: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(lists)
        terms = rows.column("term").combine_chunks()
        sizes = pc.list_value_length(rows.column("ids")).to_numpy()
        ids = pc.list_flatten(rows.column("ids")).combine_chunks()
        pages = pc.unique(ids)
        pages = pages.take(pc.array_sort_indices(pages, null_placement="at_start"))
        n = max(1, len(pages))
        # A page that is listed twice for a term counts twice.
        keys = np.repeat(np.arange(len(sizes), dtype="i8"), sizes) * n + pc.index_in(ids, value_set=pages).to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        keys, scores = keys[order], pc.list_flatten(rows.column("tfs")).to_numpy()[order].astype("i8") + MATCHED
        if len(keys):
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, scores = keys[starts], np.add.reduceat(scores, starts)
        cuts = np.searchsorted(keys, np.arange(len(sizes) + 1) * n)
        at = keys % n
        return terms, pages, n, [(at[a:b], scores[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def improve(indexed, asked: pa.Array, ends: list[int], scores: np.ndarray, places: np.ndarray) -> pa.Array:
        """Put the pages of a slice that are among the best of a query into its row of ``scores`` and ``places``."""
        terms, pages, n, lists_of = indexed
        wanted = pc.fill_null(pc.index_in(asked, value_set=terms), -1).to_numpy()
        # Ids of whole numbers order pages of different slices; a null comes first.
        ids = pc.fill_null(pages.cast(pa.int64()), LEAST_ID).to_numpy() if pa.types.is_integer(pages.type) else np.arange(len(pages))
        total, step, begin = np.zeros(n, "i8"), max(1, n // 1024), 0
        for number, end in enumerate(ends):
            total.fill(0)
            for term in wanted[begin:end].tolist():
                if term >= 0:
                    at, score = lists_of[term]
                    total[at] += score
            begin = end
            some = total[::step]
            # The last place so far, or among some pages, is a bound for all.
            least = max(1, scores[number, -1], int(np.partition(some, -limit)[-limit]) if len(some) >= limit else 1)
            best = np.flatnonzero(total >= least)
            if not len(best):
                continue
            best = best[np.argsort(-total[best], kind="stable")[:limit]]
            if scores[number, 0]:
                both, of = np.append(scores[number], total[best]), np.append(places[number], ids[best])
                first = np.lexsort((of, -both))[:limit]
                scores[number], places[number] = both[first], of[first]
            else:
                scores[number, : len(best)], places[number, : len(best)] = total[best], ids[best]
        return pages

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queries, lists, slice_, scores = None, [], [], None, None

        def score_slice():
            """The slice that has been read; its hits if they can't wait for those of the others."""
            nonlocal lists, queries, scores, places, asked, ends
            if not (lists and queries):
                lists = []
                return
            if scores is None:
                queries = [pa.Table.from_batches(queries).combine_chunks()]
                column = queries[0].column("terms").combine_chunks()
                asked, ends = pc.list_flatten(column), np.cumsum(pc.list_value_length(column).to_numpy()).tolist()
                scores, places = (np.zeros((len(ends), limit), "i8") for _ in range(2))
            pages = improve(index(lists), asked, ends, scores, places)
            lists = []
            if not pa.types.is_integer(pages.type):
                yield from hits(pages)
                scores[:] = 0

        def hits(pages: pa.Array | None = None):
            if scores is None:
                return
            for begin in range(0, len(scores), EMIT_QUERIES):
                owners, columns = np.nonzero(scores[begin : begin + EMIT_QUERIES])
                owners += begin
                found, value = places[owners, columns], scores[owners, columns]
                if pages is None:
                    named = pa.array(found, mask=found == LEAST_ID).cast(kind)
                else:
                    named = pages.take(pa.array(found))
                yield pa.RecordBatch.from_pydict({
                    "query_id": queries[0].column("query_id").combine_chunks().take(pa.array(owners)), "page_id": named,
                    "matched": pa.array(value // MATCHED), "tf_sum": pa.array(value % MATCHED),
                })

        places = asked = ends = kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            whole = pa.types.is_integer(kind)
            cell, of = batch.column("cell").to_numpy(), batch.column("slice").to_numpy()
            starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (of[1:] != of[:-1]))).tolist() if len(cell) else []
            for a, b in zip(starts, [*starts[1:], len(cell)]):
                if (cell[a], of[a]) != (current, slice_):
                    yield from score_slice()
                    if cell[a] != current:
                        if whole:
                            yield from hits()
                        queries, scores = [], None
                    current, slice_ = cell[a], of[a]
                (queries if of[a] < 0 else lists).append(batch.slice(a, b - a))
        if current is not None:
            yield from score_slice()
            if whole:
                yield from hits()

    return rank


def write_blocks(
    pages: DataFrame, path: str, buckets: int = 256, block: int = BLOCK_PAGES, text: str = "extract"
) -> DataFrame:
    """Write the impact-ordered index and read it back: ``(term, block, n, top_tf, top_page, entries, bucket)``.

    A block holds the postings of one term with one ``tf`` from ``block`` neighbouring pages of the input, in order of
    ``page_id``; ``top_tf`` and ``top_page`` are its first entry, and ``block`` orders the blocks of a term by falling
    count, then by first page.  Pages meet in a block within their task already, so blocks are shuffled, not
    postings, and no task holds all of a term.
    """
    block_rows(pages, buckets, block, text).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return pages.sparkSession.read.parquet(path)


def block_rows(pages: DataFrame, buckets: int, block: int, text: str = "extract") -> DataFrame:
    """The rows of :func:`write_blocks`, dealt out by bucket."""
    numbered = pages.select("page_id", F.col(text).alias("_text"), F.floor(F.monotonically_increasing_id() / block).alias("_group"))
    entry = F.explode(tx.counted(tx.terms(F.col("_text")))).alias("entry")
    rows = numbered.select("page_id", "_group", entry).select(
        F.col("entry.term").alias("term"), F.col("entry.n").cast("long").alias("tf"), "_group", "page_id"
    )
    bare = rows.groupBy("term", "tf", "_group").agg(F.sort_array(F.collect_list("page_id")).alias("ids")).select(
        "term", "tf", "ids", term_bucket(F.col("term"), buckets).alias("bucket")
    )
    # Bare ids are dealt out; blocks, several times as wide, are made where they are written.
    return bare.hint("rebalance", "bucket").select(
        "term",
        F.struct((-F.col("tf")).alias("minus_tf"), F.col("ids")[0].alias("top_page")).alias("block"),
        F.size("ids").cast("long").alias("n"),
        F.col("tf").alias("top_tf"),
        F.col("ids")[0].alias("top_page"),
        F.transform("ids", lambda i: F.struct(i.alias("page_id"), F.col("tf").alias("tf"))).alias("entries"),
        "bucket",
    )


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners ``(claim_id, query_key)`` and distinct queries ``(query_key, query_id, asked)``."""
    asked = (
        queries.select("claim_id", F.array_sort(F.array_distinct(tx.terms(F.col("query")))).alias("asked"))
        .where(F.size("asked") > 0)
        .withColumn("query_key", F.array_join("asked", " "))
    )
    wanted = asked.groupBy("query_key").agg(F.min("claim_id").alias("query_id"), F.first("asked").alias("asked"))
    return asked.select("claim_id", "query_key"), cut(wanted)


def surviving_blocks(terms: DataFrame, heads: DataFrame, floor: DataFrame) -> DataFrame:
    """``(query_id, term, block)`` of the blocks that may still hold one of a query's best pages.

    ``terms(query_id, term, pages, top_tf)`` with the length and largest count of each list,
    ``heads(term, block, top_tf, top_page)`` of all blocks, and ``floor(query_id, matched, tf_sum, page_id)``,
    the page that a query's last place goes to so far.  Queries without a floor keep all blocks.

    A page must match as many terms as the floor, ``m`` of ``L``.  One that lies in none of the
    ``L - m + 1`` shortest lists can't, so longer lists are only looked up, never gone through.  Where all terms
    must match, a block whose first count, with the largest counts of the other terms, stays behind the
    floor has nothing to offer, nor have the blocks after it.
    """
    of_query = Window.partitionBy("query_id")
    ranked = terms.withColumns(
        {
            "n_terms": F.count("*").over(of_query),
            "tops": F.sum("top_tf").over(of_query),
            "place": F.row_number().over(of_query.orderBy("pages", "term")),
        }
    ).join(floor, "query_id", "left")
    gone_through = ranked.where(F.col("matched").isNull() | (F.col("place") <= F.col("n_terms") - F.col("matched") + 1))
    lists = gone_through.select(
        "query_id",
        "term",
        # The count that a posting needs, given where all terms must match.
        F.when(F.col("matched") == F.col("n_terms"), F.col("tf_sum") - (F.col("tops") - F.col("top_tf"))).alias("need_tf"),
        F.col("page_id").alias("last_page"),
    )
    passes = F.col("need_tf").isNull() | (F.col("top_tf") > F.col("need_tf")) | (
        (F.col("top_tf") == F.col("need_tf")) & (F.col("top_page") <= F.col("last_page"))
    )
    return lists.join(heads, "term").where(passes).select("query_id", "term", "block")


def search_blocks(
    queries: DataFrame,
    blocks: DataFrame,
    limit: int = PAGES_PER_QUERY,
    buckets: int | None = None,
) -> DataFrame:
    """:func:`search_pages` on an index written by :func:`write_blocks`; same rows, no bound for common terms.

    The first blocks of each term, ``limit`` postings at least, give every query its first candidates.  Their whole scores give a floor, the
    best ``limit`` pages so far, and :func:`surviving_blocks` leaves those blocks that may hold a better page.
    Only their postings meet the query.  Counts of a candidate's other terms come by an equi-join on page and
    term, with lists that are read once for all queries.  The result is exact for any size of a block.
    """
    owners, wanted = _asked(queries)
    query_terms = cut(wanted.select("query_id", F.explode("asked").alias("term")))
    terms_asked = query_terms.select("term").distinct()
    keys = ["term"]
    if buckets is not None:
        terms_asked = terms_asked.withColumn("bucket", term_bucket(F.col("term"), buckets))
        keys = ["bucket", "term"]
    read = cut(blocks.join(terms_asked, keys, "left_semi").drop("bucket"))

    heads = read.select("term", "block", "top_tf", "top_page")
    lists = read.groupBy("term").agg(F.sum("n").alias("pages"), F.max("top_tf").alias("top_tf"))
    earlier = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = read.select("term", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    opening = cut(ahead.where(F.col("ahead") < limit).select("term", "block"))
    terms = cut(query_terms.join(lists, "term"))
    pages_of = read.select("term", F.inline("entries"))

    def scored(chosen: DataFrame) -> DataFrame:
        """Whole scores of all pages in the chosen ``(query_id, term, block)``."""
        met = chosen.join(read, ["term", "block"]).select("query_id", F.explode("entries.page_id").alias("page_id"))
        looked_up = met.distinct().join(terms.select("query_id", "term"), "query_id").join(pages_of, ["page_id", "term"])
        return _score(looked_up, "query_id")

    first = cut(scored(terms.select("query_id", "term").join(opening, "term")))
    best = cut(_best_pages(first, "query_id", limit))
    floor = best.where(F.col("page_rank") == limit).select("query_id", "matched", "tf_sum", "page_id")
    left = surviving_blocks(terms.select("query_id", "term", "pages", "top_tf"), heads, floor)
    # The first blocks have been scored.
    left = left.join(opening, ["term", "block"], "left_anti")
    hits = scored(cut(left)).unionByName(best.drop("page_rank")).distinct()
    ranked = _best_pages(hits, "query_id", limit)
    return (
        owners.join(wanted.select("query_key", "query_id"), "query_key")
        .join(ranked, "query_id")
        .select("claim_id", "page_id", "matched", "tf_sum", "page_rank")
    )


def _meet(query_terms: DataFrame, read: DataFrame) -> DataFrame:
    """Postings of each query's terms, laid out by query.

    No term has more than the hot bound of pages here, so the rows of one query are
    bounded.  How they meet is left to adaptive execution, which knows both sides'
    bytes; scoring and ranking both reuse the layout by query.
    """
    return query_terms.join(read, "term").repartition("query_id")


def _score(hits: DataFrame, group: str) -> DataFrame:
    """Number of query terms in each page and the sum of their counts."""
    return hits.groupBy(group, "page_id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf_sum"))


def _rank_with_hot_terms(query_terms: DataFrame, read: DataFrame, hot: DataFrame, limit: int) -> DataFrame:
    """Scores of every page that can be among the best ``limit`` of a query.

    A page either contains a rare term of the query or only hot ones.

    * Pages with a rare term come from the rare posting lists, whose length is
      bounded; the counts of their hot terms are added by an equi-join on
      (page, term).
    * Pages with hot terms only score the same for every query that has the same
      set of hot terms, so they are ranked once per set, not per query.  Scores
      only grow with further terms: a page outside the best ``limit`` of the set
      has ``limit`` pages ahead of it for the whole query too.

    Both parts together therefore hold the exact answer.
    """
    flagged = query_terms.join(hot.withColumn("is_hot", F.lit(True)), "term", "left")
    rare_terms = flagged.where(F.col("is_hot").isNull()).select("query_id", "term")
    hot_terms = flagged.where("is_hot").select("query_id", "term")
    hot_read = read.join(hot, "term", "left_semi")
    rare_read = read.join(hot, "term", "left_anti")

    rare_hits = _meet(rare_terms, rare_read).select("query_id", "page_id", "tf")
    hot_of_rare = (
        rare_hits.select("query_id", "page_id")
        .distinct()
        .join(hot_terms, "query_id")
        .join(hot_read, ["page_id", "term"])
        .select("query_id", "page_id", "tf")
    )
    with_rare = _score(rare_hits.unionByName(hot_of_rare), "query_id")

    sets = hot_terms.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("set_terms"))
    sets = sets.withColumn("set_key", F.array_join("set_terms", " "))
    set_terms = (
        sets.groupBy("set_key")
        .agg(F.first("set_terms").alias("set_terms"))
        .select("set_key", F.explode("set_terms").alias("term"))
    )
    set_hits = _score(set_terms.join(hot_read, "term"), "set_key")
    only_hot = (
        sets.select("query_id", "set_key")
        .join(_best_pages(set_hits, "set_key", limit), "set_key")
        .select("query_id", "page_id", "matched", "tf_sum")
    )

    # A page may be in both parts; its full score is the larger one.
    return (
        with_rare.unionByName(only_hot)
        .groupBy("query_id", "page_id")
        .agg(F.max(F.struct("matched", "tf_sum")).alias("score"))
        .select("query_id", "page_id", "score.matched", "score.tf_sum")
    )


def passages(pages: DataFrame, size: int = PASSAGE_WORDS, text: str = "extract") -> DataFrame:
    """``(page_id, chunk_no, text)``: consecutive passages of ``size`` words."""
    return pages.select("page_id", F.posexplode(tx.chunks(F.col(text), size)).alias("chunk_no", "text"))


def _sum_of_squares(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda total, c: total + c["n"] * c["n"])


def term_profile(text: Column) -> Column:
    """``struct<terms, ns, norm2>``: distinct terms of a text, their counts and the sum of the squares, for the similarity filter."""
    return tx.let(
        tx.counted(tx.terms(text)),
        lambda counts: F.struct(counts["term"].alias("terms"), counts["n"].alias("ns"), _sum_of_squares(counts).alias("norm2")),
    )


def profile_cosine(profile: Column, other: Column) -> Column:
    """Cosine of the term counts of two :func:`term_profile`, a claim's and a passage's; the sums are whole
    numbers, so it is exact to one rounding.

    Shared terms come from one hash lookup each; only for them are counts looked up.
    """

    def count(of: Column, term: Column) -> Column:
        return F.get(of["ns"], F.array_position(of["terms"], term).cast("int") - 1)

    product = F.aggregate(
        F.array_intersect(profile["terms"], other["terms"]),
        F.lit(0).cast("long"),
        lambda total, term: total + (count(profile, term) * count(other, term)).cast("long"),
    )
    scale = F.sqrt((profile["norm2"] * other["norm2"]).cast("double"))
    return tx.let(scale, lambda s: F.when(s > 0, product / s).otherwise(F.lit(0.0)))


def scored_passages(
    claims: DataFrame,
    candidates: DataFrame,
    pages: DataFrame,
    size: int = PASSAGE_WORDS,
    text: str = "extract",
) -> DataFrame:
    """Every passage of every candidate page with its similarity to the claim:
    ``(claim_id, page_id, page_rank, chunk_no, text, similarity)``."""
    pairs = _candidate_rows(claims, candidates, pages, size, text)
    # Compared inside the array: a later filter on the similarity cannot repeat the comparison.
    compared = F.transform(
        "chunks",
        lambda passage, i: F.struct(
            i.alias("chunk_no"), passage["text"].alias("text"),
            profile_cosine(F.col("profile"), passage["profile"]).alias("similarity"),
        ),
    )
    return pairs.select("claim_id", "page_id", "page_rank", F.inline(compared))


def similar_passages(scored: DataFrame, threshold: float = MIN_SIMILARITY) -> DataFrame:
    """The similarity filter."""
    return scored.where(F.col("similarity") >= threshold)


def dense_similar(
    pairs: DataFrame, threshold: float = MIN_SIMILARITY, left: str = "claim_vector", right: str = "passage_vector"
) -> DataFrame:
    """The same filter for pairs that carry dense vectors, adding ``similarity``."""
    scored = pairs.withColumn("similarity", vx.cosine(F.col(left), F.col(right)))
    return scored.where(F.col("similarity") >= threshold)


def _candidate_rows(claims, candidates, pages, size, text) -> DataFrame:
    """One row per claim and candidate page, with the page's passages: ``chunks``, each with ``text`` and ``profile``; ``repeated`` marks an id of several pages.

    Only pages that are a candidate of some claim are cut, and each page is cut, its terms
    are counted and it is shuffled once, however many claims it serves.  A page that very many claims
    share is a skewed key of the last join, which adaptive execution splits.
    """
    repeated = pages.groupBy("page_id").agg((F.count("*") > 1).alias("repeated"))
    used = candidates.select("page_id").distinct().join(repeated, "page_id")
    cut_pages = pages.join(used, "page_id").select(
        "page_id", "repeated", F.transform(tx.chunks(F.col(text), size), lambda c: F.struct(c.alias("text"), term_profile(c).alias("profile"))).alias("chunks")
    )
    # Few bytes of claims stand for much work, so they are spread by number, not by size.
    # A sort-merge join on the id uses the same partitioning.
    spread = claims.repartition(width(claims.sparkSession), "claim_id")
    profiles = spread.select(
        "claim_id", *[c for c in ("k",) if c in claims.columns], term_profile(F.col("claim")).alias("profile")
    )
    return profiles.join(candidates, "claim_id").join(cut_pages, "page_id")


def _first_similar(profile: Column, chunks: Column, page_id: Column, k: Column, threshold: float) -> Column:
    """The first ``k`` similar passages of one page.

    Once ``k`` are found the rest of the page is passed over without comparing.
    """

    def step(state: Column, passage: Column) -> Column:
        hit = F.struct(page_id.alias("page_id"), state["at"].alias("chunk_no"), passage["text"].alias("text"))
        similar = profile_cosine(profile, passage["profile"]) >= threshold
        kept = F.when(F.size(state["kept"]) >= k, state["kept"]).when(
            similar, F.concat(state["kept"], F.array(hit))
        ).otherwise(state["kept"])
        return F.struct((state["at"] + 1).alias("at"), kept.alias("kept"))

    nothing = F.array().cast(PASSAGES)
    return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), nothing.alias("kept")), step)["kept"]


def _kept_per_claim(
    claims: DataFrame, candidates: DataFrame, pages: DataFrame,
    size: int, threshold: float, k_max: int, text: str,
) -> DataFrame:
    """The first ``k`` similar passages per claim, in page order, with counts.

    Each pair row keeps at most the numbers of its claim's ``k`` passages before the shuffle by
    claim; no later page can push an earlier passage out, so this is exact and a
    claim brings together at most ``limit`` short rows.  Texts follow once the passages are chosen.
    """
    pairs = _candidate_rows(claims, candidates, pages, size, text)
    bound = F.least("k", F.lit(k_max))
    kept = _first_similar(F.col("profile"), F.col("chunks"), F.col("page_id"), bound, threshold)
    # Most kept passages are behind a claim's k: texts are fetched for those that aren't. Where an id repeats its rows carry them.
    bare = F.transform(kept, lambda e: F.struct(e["page_id"].alias("page_id"), e["chunk_no"].alias("chunk_no"), F.when(F.col("repeated"), e["text"]).alias("text")))
    slim = pairs.select("claim_id", "page_rank", bound.alias("k"), F.size("chunks").alias("n_passages"), bare.alias("kept"))
    ordered = F.sort_array(F.collect_list(F.struct("page_rank", "kept")))
    grouped = slim.groupBy("claim_id").agg(
        F.count("*").alias("n_candidates"),
        F.sum("n_passages").alias("n_passages"),
        F.first("k").alias("k"),
        ordered.alias("by_page"),
    )
    flat = F.flatten(F.transform("by_page", lambda p: p["kept"]))
    chosen = cut(grouped.select("claim_id", "n_candidates", "n_passages", F.slice(flat, F.lit(1), F.col("k")).alias("evidence")))
    release(chosen.sparkSession)
    place = chosen.select("claim_id", F.posexplode("evidence").alias("place", "e")).select("claim_id", "place", "e.*")
    carried, wanted = place.where(F.col("text").isNotNull()), place.where(F.col("text").isNull()).drop("text")
    used = pages.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    chunks = used.select("page_id", tx.chunks(F.col(text), size).alias("chunks"))
    fetched = wanted.join(chunks, "page_id").select("claim_id", "place", "page_id", "chunk_no", F.get("chunks", F.col("chunk_no")).alias("text"))
    texts = carried.unionByName(fetched).groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("place", "page_id", "chunk_no", "text"))).alias("texts"))
    evidence = F.transform("texts", lambda e: F.struct(e["page_id"].alias("page_id"), e["chunk_no"].alias("chunk_no"), e["text"].alias("text")))
    return chosen.drop("evidence").join(texts, "claim_id", "left").select(
        "claim_id", "n_candidates", "n_passages", F.coalesce(evidence, F.array().cast(PASSAGES)).alias("evidence")
    )


def encoded_passages(candidates: DataFrame, pages: DataFrame, encode: Encoder, size: int = PASSAGE_WORDS, text: str = "extract") -> DataFrame:
    """``(page_id, chunk_no, text, vector)``: the passages of all candidate pages.

    A page is cut and its passages are encoded once, however many claims it is a candidate of.
    """
    used = candidates.select("page_id").distinct()
    cut_pages = passages(pages.join(used, "page_id", "left_semi"), size, text)
    # Models are slow: passages are dealt out by number, and the vectors are stored, as later steps read them twice.
    return cut(encode(cut_pages.repartition(width(pages.sparkSession), "page_id", "chunk_no")).select("page_id", "chunk_no", "text", "vector"))


def _encoded_kept_per_claim(
    claims: DataFrame, candidates: DataFrame, pages: DataFrame, encode: Encoder,
    size: int, threshold: float, k_max: int, text: str,
) -> DataFrame:
    """The result of ``_kept_per_claim`` with similarities of encoded vectors.

    Vectors meet by page and are gone after the filter; the cut to a claim's ``k`` passages is made
    before the shuffle by claim, and only passages that are kept are joined with their text.
    """
    stored = encoded_passages(candidates, pages, encode, size, text)
    asked = claims.select("claim_id", F.least("k", F.lit(k_max)).alias("k"), F.coalesce("claim", F.lit("")).alias("text"))
    own = cut(encode(asked).select("claim_id", "k", F.col("vector").alias("claim_vector")))
    pairs = own.join(candidates.select("claim_id", "page_id", "page_rank"), "claim_id").join(
        stored.select("page_id", "chunk_no", F.col("vector").alias("passage_vector")), "page_id"
    )
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("page_rank", "chunk_no"))
    similar = dense_similar(pairs, threshold).select("claim_id", "k", "page_id", "page_rank", "chunk_no").withColumn("place", place)
    first = similar.where((F.col("place") <= k_max) & (F.col("place") <= F.col("k")))
    texts = first.join(stored.select("page_id", "chunk_no", "text"), ["page_id", "chunk_no"])
    evidence = texts.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("place", "page_id", "chunk_no", "text"))).alias("evidence"))
    sizes = stored.groupBy("page_id").agg(F.count("*").alias("n"))
    counts = candidates.join(sizes, "page_id", "left").groupBy("claim_id").agg(
        F.count("*").alias("n_candidates"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_passages")
    )
    return counts.join(evidence, "claim_id", "left").select(
        "claim_id", "n_candidates", "n_passages",
        F.transform("evidence", lambda e: F.struct(e["page_id"].alias("page_id"), e["chunk_no"].alias("chunk_no"), e["text"].alias("text"))).alias("evidence"),
    )


def adaptive_passages(
    claims: DataFrame, candidates: DataFrame, pages: DataFrame,
    size: int = PASSAGE_WORDS, threshold: float = MIN_SIMILARITY, k_max: int = 5, text: str = "extract",
) -> DataFrame:
    """Adaptive top-k in long form: ``(claim_id, rank, page_id, chunk_no, text)``.

    ``claims(claim_id, claim, k)``; passages are taken in page order, then chunk
    order, not by similarity.
    """
    kept = _kept_per_claim(claims, candidates, pages, size, threshold, k_max, text)
    return kept.select("claim_id", F.posexplode("evidence").alias("pos", "e")).select(
        "claim_id", (F.col("pos") + 1).alias("rank"), "e.page_id", "e.chunk_no", "e.text"
    )


def fallback_queries(claims: DataFrame, candidates: DataFrame, chars: int = FALLBACK_CHARS) -> DataFrame:
    """Second-chance queries, the first ``chars`` characters of the claim, for
    claims whose first search found nothing."""
    missed = claims.join(candidates.select("claim_id").distinct(), "claim_id", "left_anti")
    return missed.withColumn("query", F.substring("claim", 1, chars))


def retrieve(
    claims: DataFrame,
    pages: DataFrame,
    index: DataFrame | None = None,
    *,
    stopwords: Sequence[str],
    hedge: Sequence[str] = HEDGE_WORDS,
    vague: Sequence[str] = VAGUE_WORDS,
    k_min: int = 1,
    k_max: int = 5,
    limit: int = PAGES_PER_QUERY,
    size: int = PASSAGE_WORDS,
    threshold: float = MIN_SIMILARITY,
    hot_pages: int | None = None,
    buckets: int | None = None,
    text: str = "extract",
    encode: Encoder | None = None,
) -> DataFrame:
    """Evidence for every claim: ``(claim_id, claim, k_used, passages, n_candidates,
    n_passages, n_kept, used_fallback)``; ``n_kept`` counts the evidence passages.

    The result depends on the claim text alone, so copies of a claim are retrieved
    once and joined back.  A claim without evidence, a null one too, keeps its row
    with an empty list; the counts tell "nothing found" from "all filtered out".

    Passages are compared by their term counts, or with ``encode`` by vectors: it adds ``vector`` for
    the column ``text`` and keeps the others, like :func:`assay.operators.features.hashed_vectors`.
    """
    index = index if index is not None else postings(pages, text)
    distinct = claims.groupBy("claim").agg(F.min("claim_id").alias("claim_id"))
    scored = cut(keyword_queries(with_budget(distinct, hedge, vague, k_min, k_max), stopwords))

    search = {"limit": limit, "hot_pages": hot_pages, "buckets": buckets}
    found = cut(search_pages(scored, index, **search).withColumn("used_fallback", F.lit(False)), spread=True)
    release(claims.sparkSession)
    again = cut(fallback_queries(scored, found).select("claim_id", "query"))
    if not again.isEmpty():
        second = search_pages(again, index, **search).withColumn("used_fallback", F.lit(True))
        found = cut(found.unionByName(second), spread=True)

    if encode is None:
        kept = _kept_per_claim(scored, found, pages, size, threshold, k_max, text)
    else:
        kept = _encoded_kept_per_claim(scored, found, pages, encode, size, threshold, k_max, text)
    flags = again.select("claim_id", F.lit(True).alias("used_fallback"))
    nothing = F.array().cast("array<string>")
    per_text = (
        scored.join(kept, "claim_id", "left")
        .join(flags, "claim_id", "left")
        .select(
            "claim",
            F.col("k").alias("k_used"),
            F.coalesce(F.transform("evidence", lambda e: e["text"]), nothing).alias("passages"),
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_candidates", "n_passages")],
            F.coalesce(F.size("evidence"), F.lit(0)).alias("n_kept"),
            F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"),
        )
    )
    asked = claims.select("claim_id", "claim").alias("asked")
    joined = asked.join(per_text.withColumnRenamed("claim", "found_for"), F.expr("asked.claim <=> found_for"), "left")
    return joined.select(
        "claim_id", "claim", "k_used", "passages", "n_candidates", "n_passages", "n_kept", "used_fallback"
    )
