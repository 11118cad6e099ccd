"""Centroid clustering of integer vectors over a vector-approximation file.

Every vector has a short approximation: for each dimension, the number of the cell its component lies in.  A round scans
approximations only: tables of each cell's least and greatest distance to each centroid add up to an interval for every
centroid, and where one interval lies below all others the nearest centroid is known.  Where several overlap, the one in
front is compared with each of the others by the least difference of the two distances within the vector's cells, a much
narrower interval, as both distances grow together.  Full vectors are fetched by a join,
on the stored side without a shuffle, only where intervals overlap or where a vector moves and the sums of its old and new
cluster change.  All arithmetic is on integers, so the result depends on nothing but the vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import cut, scratch_path, width

# Components are below this size, so that squared distances and their differences fit 64 bits.
LARGEST = 1 << 26

# Bits of a cell number.
CELL_BITS = 6
CELLS = 1 << CELL_BITS

# Rows whose bounds are added up at once.
STEP = 2048

STATE = "row long, cells binary, cluster int"


def integer_vectors(vectors: DataFrame, dimensions: int = 64, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors with exactly ``dimensions`` components, none null, NaN or infinite; x: floor(scale * component).

    A component of 2^26 or more after scaling ends the job with an error: distances would not fit a long.
    """
    given = F.col(vector).cast("array<double>")
    finite = F.forall(given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), given.alias("v")).where((F.size("v") == dimensions) & finite)
    fits = F.forall("v", lambda c: F.abs(c * scale) < LARGEST)
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for integer distances")).cast("array<double>"))
    return kept.select("vec_id", F.transform(checked, lambda c: F.floor(c * F.lit(float(scale))).cast("int")).alias("x"))


def first_centroids(kept: DataFrame, count: int, seed: int) -> np.ndarray:
    """The ``count`` vectors (or all, if fewer) with the smallest hashes of seed and id, in that order; equal ids by components, null ids last."""
    text = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    order = [F.asc_nulls_last(F.sha2(text, 256)), F.asc("x")]
    return np.array([r.x for r in kept.orderBy(*order).limit(count).collect()], "i8")


@dataclass(frozen=True)
class Grid:
    """Cells of each dimension: ``least`` and ``greatest`` (dimensions by cells) are the integers that a cell spans."""

    least: np.ndarray
    greatest: np.ndarray

    @staticmethod
    def of(kept: DataFrame, dimensions: int) -> "Grid":
        """Cells of about equally many vectors in each dimension, by approximate quantiles; the outer ends are exact."""
        inner = [i / CELLS for i in range(1, CELLS)]
        row = kept.agg(*[
            F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.percentile_approx(c, inner, 1000).alias("cuts")).alias(f"d{i}")
            for i, c in enumerate(F.col("x")[i] for i in range(dimensions))
        ]).first()
        cuts = np.array([d.cuts for d in row], "i8")
        low, high = (np.array([[d[end]] for d in row], "i8") for end in ("low", "high"))
        return Grid(np.hstack([low, np.minimum(cuts + 1, high)]), np.hstack([np.maximum(cuts, low), high]))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers of vectors, packed bit by bit."""
        out = np.empty((*x.shape, 1), "u1")
        for d in range(x.shape[1]):
            out[:, d, 0] = np.searchsorted(self.greatest[d, :-1], x[:, d])
        return np.packbits(np.unpackbits(out, axis=2)[:, :, -CELL_BITS:].reshape(len(x), -1), axis=1)

    def bounds(self, centroids: np.ndarray) -> np.ndarray:
        """Least and greatest squared distance in each dimension of each cell to each centroid: dimension, cell, 2 * centroid."""
        c = centroids.T[:, None, :]
        least, greatest = self.least[:, :, None], self.greatest[:, :, None]
        near = np.maximum(np.maximum(least - c, c - greatest), 0)
        far = np.maximum(np.abs(c - least), np.abs(c - greatest))
        return np.concatenate([near * near, far * far], axis=2)


def unpacked(cells: np.ndarray, dimensions: int) -> np.ndarray:
    bits = np.unpackbits(cells, axis=1)[:, : dimensions * CELL_BITS].reshape(-1, CELL_BITS)
    return (bits @ (1 << np.arange(CELL_BITS)[::-1]).astype("u1")).reshape(-1, dimensions)


def candidates(grid: Grid, sums: np.ndarray, centroids: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be the nearest of the vectors (rows) with these cell numbers; ``sums`` are the grid's bounds."""
    k, dimensions = centroids.shape
    total = np.zeros((len(cells), 2 * k), "i8")
    for d in range(dimensions):
        total += sums[d][cells[:, d]]
    least, greatest = total[:, :k], total[:, k:]
    # No centroid whose least distance is above another's greatest can be the nearest.
    left = least <= greatest.min(axis=1, keepdims=True)
    several = np.flatnonzero(left.sum(axis=1) > 1)
    front = (least + greatest)[several].argmin(axis=1)
    each = np.arange(dimensions)
    for f in np.unique(front).tolist():
        rows = several[front == f]
        low, high = grid.least[each, cells[rows]], grid.greatest[each, cells[rows]]
        # |x - c|^2 - |x - front|^2 is linear in x, so it is least at an end of each cell.
        apart = centroids - centroids[f]
        difference = (centroids**2 - centroids[f] ** 2).sum(axis=1) - (low + high) @ apart.T - (high - low) @ np.abs(apart).T
        left[rows] &= difference <= 0
    return left


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(-1, dimensions)


def _bounded(state: DataFrame, grid: Grid, centroids: np.ndarray) -> DataFrame:
    """(row, cells, cluster, nearest, open) of every approximation.

    ``nearest`` is the centroid that the intervals leave, null where they leave several; those are the bits of ``open``.
    """
    dimensions = centroids.shape[1]
    # Sizes are given by dimensions, cells and centroids.
    sent = state.sparkSession.sparkContext.broadcast((grid, grid.bounds(centroids), centroids))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                cells = unpacked(np.frombuffer(b"".join(part.column("cells").to_pylist()), "u1").reshape(part.num_rows, -1), dimensions)
                left = candidates(*sent.value, cells)
                one = left.sum(axis=1) == 1
                nearest = pa.array(np.where(one, left.argmax(axis=1), -1).astype("i4"), mask=~one)
                bits = np.packbits(left, axis=1, bitorder="little")
                marks = pa.array([None if sure else b.tobytes() for sure, b in zip(one, bits)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("cells"), part.column("cluster"), nearest, marks], ["row", "cells", "cluster", "nearest", "open"])

    return state.mapInArrow(bound, f"{STATE}, nearest int, open binary")


def _settled(fetched: DataFrame, centroids: np.ndarray, schema: str) -> DataFrame:
    """Rows with their full vector ``x``: ``nearest`` chosen among the open centroids, ties to the smaller number, and ``distance``."""
    k, dimensions = centroids.shape
    sent = fetched.sparkSession.sparkContext.broadcast(centroids)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = _vectors(part.column("x"), dimensions)
                nearest = part.column("nearest").fill_null(-1).to_numpy(zero_copy_only=False).astype("i8")
                distance = np.zeros(len(x), "i8")
                sure = np.flatnonzero(nearest >= 0)
                distance[sure] = ((x[sure] - c[nearest[sure]]) ** 2).sum(axis=1)
                rest = np.flatnonzero(nearest < 0)
                if len(rest):
                    marks = np.frombuffer(b"".join(part.column("open").take(pa.array(rest)).to_pylist()), "u1").reshape(len(rest), -1)
                    is_open = np.unpackbits(marks, axis=1, bitorder="little")[:, :k].astype(bool)
                    least, chosen = np.full(len(rest), np.iinfo("i8").max), np.full(len(rest), -1, "i8")
                    for j in range(k):
                        at_j = np.flatnonzero(is_open[:, j])
                        d = ((x[rest[at_j]] - c[j]) ** 2).sum(axis=1)
                        nearer = d < least[at_j]
                        least[at_j[nearer]], chosen[at_j[nearer]] = d[nearer], j
                    nearest[rest], distance[rest] = chosen, least
                columns = {n: part.column(n) for n in part.schema.names}
                columns |= {"nearest": pa.array(nearest.astype("i4")), "distance": pa.array(distance)}
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return fetched.mapInArrow(settle, schema)


def _moved(settled: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much the sums (by cluster and dimension) and counts of clusters change; the task adds up what it has first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.hstack([_vectors(batch.column("x"), dimensions), np.ones((batch.num_rows, 1), "i8")])
            for name, sign in (("nearest", 1), ("cluster", -1)):
                of = batch.column(name).fill_null(-1).to_numpy(zero_copy_only=False)
                for j in np.unique(of[of >= 0]).tolist():
                    sums[j] = sums.get(j, 0) + sign * x[of == j].sum(axis=0)
        flat = [(j, d, int(v)) for j, row in sums.items() for d, v in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["j", "d", "s"])

    changed = settled.where("cluster IS NULL OR cluster <> nearest").select("cluster", "nearest", "x")
    rows = changed.mapInArrow(add, "j int, d int, s long").groupBy("j", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    k = 1 + max((r.j for r in rows), default=-1)
    out = np.zeros((k, dimensions + 1), object)
    for r in rows:
        out[r.j, r.d] = int(r.s)
    return out[:, :dimensions], out[:, dimensions]


class VectorFile:
    """Full vectors stored in buckets of ``row``, and their approximations."""

    def __init__(self, kept: DataFrame, dimensions: int):
        self.spark, self.dimensions = kept.sparkSession, dimensions
        self.grid = Grid.of(kept, dimensions)
        self.name = f"vectors_{uuid.uuid4().hex}"
        numbered = cut(kept.withColumn("row", F.monotonically_increasing_id()))
        buckets = width(self.spark)
        # One bucket to a task; tables in buckets are joined without moving them.
        writer = numbered.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row").format("parquet")
        writer.option("path", scratch_path(self.spark, "vectors")).saveAsTable(self.name)
        grid = self.grid

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [b.tobytes() for b in grid.cells(_vectors(batch.column("x"), dimensions))] if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cells, pa.binary()), pa.nulls(batch.num_rows, pa.int32())], ["row", "cells", "cluster"])

        self.state = cut(numbered.select("row", "x").mapInArrow(approximate, STATE))

    def fetch(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with the stored columns of their vectors."""
        return rows.join(self.spark.table(self.name).select("row", *columns), "row")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def rounds(file: VectorFile, centroids: np.ndarray, count: int) -> np.ndarray:
    """Centroids after ``count`` rounds of assigning all vectors and moving every non-empty centroid to floor(sum / count)."""
    k, dimensions = centroids.shape
    sums, members = np.zeros((k, dimensions), object), np.zeros(k, object)
    for _ in range(count):
        seen = cut(_bounded(file.state, file.grid, centroids))
        # Null-safe: vectors without a cluster so far move as well.
        wanted = F.col("nearest").isNull() | ~F.col("nearest").eqNullSafe(F.col("cluster"))
        settled = cut(_settled(file.fetch(seen.where(wanted), "x"), centroids, f"{STATE}, nearest int, x array<int>"))
        more, count_more = _moved(settled, dimensions)
        sums[: len(more)] += more
        members[: len(more)] += count_more
        centroids = centroids.copy()
        for j in np.flatnonzero(members > 0):
            centroids[j] = [int(s) // int(members[j]) for s in sums[j]]
        keep = ["row", "cells", F.col("nearest").alias("cluster")]
        file.state = seen.where(~wanted).select(*keep).union(settled.select(*keep))
    return centroids


def cluster(
    vectors: DataFrame, count: int = 40, steps: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Vectors of another length, or with a null, NaN or infinite component, are left out; see ``integer_vectors``.  A null vec_id
    stays null and comes last when centroids start; equal ids and repeated rows are vectors of their own.  With fewer than ``count`` vectors
    there are as many centroids.  Equal distances go to the smaller number, an empty cluster keeps its centroid and has no
    rows.  No vectors give no rows.  Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    kept = cut(integer_vectors(vectors, dimensions, scale, key, vector))
    centroids = first_centroids(kept, count, seed)
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], empty)
    file = VectorFile(kept, dimensions)
    try:
        centroids = rounds(file, centroids, steps)
        # Last, every vector's distance is asked for, so all are fetched; most need one distance only.
        seen = _bounded(file.state, file.grid, centroids).select("row", "nearest", "open")
        out = cut(_settled(file.fetch(seen, "vec_id", "x"), centroids, "vec_id long, nearest int, distance long"))
    finally:
        file.close()
    # One row a cluster.
    inertias = {r.nearest: int(r.s) for r in out.groupBy("nearest").agg(F.sum("distance").alias("s")).collect()}
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("nearest") + 1)
    total: Column = F.lit(sum(inertias.values())).cast("long")
    return out.select(
        "vec_id", F.col("nearest").alias("cluster"), "distance", of([inertias.get(j, 0) for j in range(len(names))]).cast("long").alias("cluster_inertia"),
        total.alias("inertia"), of(names).alias("centroid_sha256"),
    )
