"""Nearest vectors by cosine over coarse cells, exact for any number of probed cells.

Vectors are stored by the nearest of a few coarse centres, each cell with its radius.  A query first
looks through the cells nearest to it; the k-th best it finds there is a bound, and of the other cells
only those that may hold something as near (distance to the centre less the radius) are looked
through as well.  On unit vectors the squared distance is 2 - 2 cosine, so both orders are one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.hashing import digest
from assay.functions.vectors import dot
from assay.session import cut

# Rows that the centres are fitted on at most: they steer the cost, not the result.
FIT_ROWS = 100_000

# Room for rounding in the bounds.
SLACK = 1e-6

# Vectors of a block that one task compares, and comparisons made at once.
BLOCK_ROWS, COMPARED = 50_000, 4_000_000


@dataclass
class DenseIndex:
    """``stored``: (id, cell, unit); ``cells``: (cell, center, radius, size), a row for each of at most ``count`` cells."""

    stored: DataFrame
    cells: DataFrame
    count: int


def unit_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, unit)``; rows without a vector, with a null or infinite component or of length zero point nowhere and are left out."""
    given = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), given.alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).where("norm > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def build_index(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int = 16, seed: int = 42, fit_rows: int = FIT_ROWS) -> DenseIndex:
    """Store every vector by its cell below ``path``; the centres come from at most ``fit_rows`` rows, chosen by a hash of the id.

    Without vectors the index is empty, and a search finds nothing.
    """
    from pyspark.ml.clustering import KMeans

    spark, units = vectors.sparkSession, unit_vectors(vectors, key, vector)
    sample = units.orderBy(digest(F.lit("cells"), F.lit(seed), F.col("id"))).limit(fit_rows)
    if sample.isEmpty():
        return DenseIndex(units.withColumn("cell", F.lit(0)), spark.createDataFrame([], "cell int, center array<double>, radius double, size long"), 0)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="x", predictionCol="cell").fit(sample.select(array_to_vector("unit").alias("x")))
    centers = [[float(v) for v in c] for c in model.clusterCenters()]
    found = model.transform(units.withColumn("x", array_to_vector("unit"))).select("id", "cell", "unit")
    found.write.partitionBy("cell").parquet(path)
    stored = spark.read.schema("id long, unit array<double>, cell int").parquet(path)
    table = spark.createDataFrame(list(enumerate(centers)), "cell int, center array<double>")
    spread = stored.join(F.broadcast(table), "cell")  # ``cells`` rows
    radii = spread.groupBy("cell").agg(F.max(_distance(F.col("unit"), F.col("center"))).alias("radius"), F.count("*").alias("size"))
    return DenseIndex(stored, table.join(radii, "cell"), len(centers))


def _distance(a: Column, b: Column) -> Column:
    apart = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x))


def _looked_up(asked: DataFrame, index: DenseIndex, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, cosine): the best k of the asked (query_id, cell, unit), ties to the smaller id.

    Cells are cut into blocks of at most about ``block_rows`` vectors, and a task compares a block with all that ask for its cell:
    pairs are no rows, only the nearest of a block are.
    """
    cores = asked.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-index.stored.count() // block_rows), -(-2 * cores // max(index.count, 1)))
    place = (F.col("cell") * blocks + F.col("block")).cast("long").alias("place")
    other = index.stored.where(F.col("id").isNotNull()).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).select(place, "id", "unit")
    asking = asked.where(F.col("query_id").isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(place, "query_id", "unit")
    # Few bytes for much work: dealt out by number.
    left, right = (rows.repartition(2 * blocks * max(index.count, 1), "place").groupBy("place") for rows in (asking, other))
    kind = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", T.LongType()), T.StructField("cosine", T.DoubleType())])
    met = left.cogroup(right).applyInArrow(_nearest(k), kind)
    return _best(met.select("query_id", "id", F.round("cosine", 9).alias("cosine")), k)


def _nearest(k: int):
    """Compares all asking vectors with all of a block and leaves those that may be among the best ``k``, with their cosines."""

    def matrix(rows: pa.Table) -> np.ndarray:
        return pc.list_flatten(rows.column("unit")).to_numpy().reshape(rows.num_rows, -1)

    def compare(asking: pa.Table, block: pa.Table) -> pa.Table:
        owners, places, cosines = [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0)]
        if asking.num_rows and block.num_rows:
            a, b = matrix(asking), matrix(block)
            own, ids, n = asking.column("query_id").to_numpy(), block.column("id").to_numpy(), block.num_rows
            step = max(1, COMPARED // n)
            for at in range(0, len(a), step):
                near = a[at : at + step] @ b.T
                near[own[at : at + step, None] == ids[None, :]] = -np.inf
                least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf)
                for q, (row, bound) in enumerate(zip(near, least), at):
                    found = np.flatnonzero((row >= bound - SLACK) & (row > -np.inf))
                    # The cosine is summed from left to right, as Spark does.
                    exact, part = np.zeros(len(found)), b[found]
                    for x in range(b.shape[1]):
                        exact += a[q, x] * part[:, x]
                    order = np.lexsort((ids[found], -exact))
                    found, exact = found[order], exact[order]
                    # Of equal cosines, as many copies have, the k smallest ids do.
                    number = np.arange(len(found))
                    same = np.maximum.accumulate(np.where(np.append(True, exact[1:] != exact[:-1]), number, 0)) if len(found) else number
                    keep = number - same < k
                    owners.append(np.full(int(keep.sum()), q))
                    places.append(found[keep])
                    cosines.append(exact[keep])
        rows, columns, values = (np.concatenate(x) for x in (owners, places, cosines))
        return pa.table({"query_id": asking.column("query_id").take(pa.array(rows)), "id": block.column("id").take(pa.array(columns)), "cosine": values})

    return compare


def _best(rows: DataFrame, k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")))
    return ranked.where(F.col("rank") <= k).drop("rank")


def search(queries: DataFrame, index: DenseIndex, k: int = 10, probes: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, cosine)``: the k nearest stored vectors of each query, itself left out.

    The result is that of comparing with all rows; ``probes`` only decides how much is read before bounds prune the rest.
    """
    asked = unit_vectors(queries, key, vector).withColumnRenamed("id", "query_id")
    each = F.explode(F.sequence(F.lit(0), F.lit(max(index.count - 1, 0)))).alias("cell")
    placed = asked.select("query_id", "unit", each).join(F.broadcast(index.cells), "cell")  # at most ``count`` rows
    placed = placed.select("query_id", "unit", "cell", _distance(F.col("unit"), F.col("center")).alias("d"), "radius")
    near = Window.partitionBy("query_id").orderBy("d", "cell")
    placed = placed.withColumn("turn", F.row_number().over(near))
    first = cut(_looked_up(placed.where(F.col("turn") <= probes).select("query_id", "cell", "unit"), index, k))
    # The k-th best so far; a query with fewer looks everywhere.
    bound = first.groupBy("query_id").agg(F.min("cosine").alias("worst"), F.count("*").alias("n"))
    left = placed.where(F.col("turn") > probes).join(bound, "query_id", "left")
    reach = F.sqrt(F.greatest(2.0 - 2.0 * F.col("worst"), F.lit(0.0))) + SLACK
    open_ = F.coalesce(F.col("n") < k, F.lit(True)) | (F.col("d") - F.col("radius") <= reach)
    more = _looked_up(left.where(open_).select("query_id", "cell", "unit"), index, k)
    final = first.union(more).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")))
    return final.where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")
