"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.session import cut, lasting, passing


# Links that one task thins out.
TASK_LINKS = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As few links as connect the same nodes: every node of a partition with the smallest one it is connected to there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node in ``links``; ``root`` is the smallest node reachable.

    First every task replaces the links it has by as few that connect the same nodes, so a dense group of n nodes comes down
    from up to n * n links to about n for each task.  Then alternating star steps: each node passes its neighbours to its smallest one, until nothing changes.  The number of
    rounds grows with the logarithm of a component's size.  Every step is a grouping and a join of the links, written to
    the shared folder; only the last table stays there.
    """
    with passing(links.sparkSession):
        edges = lasting(_stars(links, a, b))
    # At rest every edge leads to its root.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _stars(links: DataFrame, a: str, b: str) -> DataFrame:
    given = cut(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v"))
    tasks = -(-given.count() // TASK_LINKS)
    edges = cut(given.repartition(max(1, tasks)).mapInArrow(_forest, "u long, v long").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        # Large star: larger neighbours go to the smallest of all neighbours and the node itself.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        # Small star: the node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
    return edges
