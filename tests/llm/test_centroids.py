"""Centroid clustering against plain integer arithmetic over all distances."""

from hashlib import sha256
from math import isfinite

import numpy as np
import pytest

from assay.llm import centroids
from assay.llm.centroids import Grid, cluster, unpacked


def plain(rows, dimensions=64, count=40, steps=5):
    kept = [(i, np.floor(256 * np.array(v, "f8")).astype("i8")) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and isfinite(c) for c in v)]
    if not kept:
        return []
    x = np.array([v for _, v in kept])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, sha256(f"2:{kept[k][0]}".encode()).hexdigest(), x[k].tolist()))
    c = x[order[:count]].copy()
    for step in range(steps + 1):
        all_distances = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        of, distance = all_distances.argmin(axis=1), all_distances.min(axis=1)
        if step < steps:
            for j in range(len(c)):
                if (of == j).any():
                    c[j] = x[of == j].sum(axis=0) // (of == j).sum()
    names = [sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return [(i, int(j), int(d), int(distance[of == j].sum()), int(distance.sum()), names[j]) for (i, _), j, d in zip(kept, of, distance)]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def table(spark, rows):
    """With further columns whose names the operator uses itself."""
    schema = "vec_id long, embedding array<float>, row string, x int, cluster int, cells binary"
    return spark.createDataFrame([(*r, "a", 1, 2, None) for r in rows], schema).repartition(3)


def test_given_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert in_order(cluster(vectors).collect()) == in_order(plain([(r.vec_id, r.embedding) for r in vectors.collect()]))


def test_odd_vectors(spark):
    """Nulls, wrong lengths, infinite components, copies, equal and null ids, ties and negative values."""
    rng = np.random.default_rng(4)
    good = [(i, [float(v) for v in np.float32(rng.normal(0, 2, 4).round(1))]) for i in range(60)]
    rows = [*good, good[3], good[3], (3, good[7][1]), (None, good[9][1]), (None, good[10][1]), (70, None), (71, []), (72, [1.0] * 5), (73, [1.0, None, 1.0, 1.0]),
            (74, [1.0, float("nan"), 0.0, 0.0]), (75, [float("inf"), 0.0, 0.0, 0.0]), *[(80 + i, [0.0] * 4) for i in range(30)]]
    for count in (1, 7, 40):
        got = cluster(table(spark, rows), count=count, dimensions=4).collect()
        assert in_order(got) == in_order(plain(rows, 4, count))


def test_all_equal_few_and_none(spark):
    rows = [(i, [1.5, -2.5]) for i in range(12)]
    assert in_order(cluster(table(spark, rows), dimensions=2).collect()) == in_order(plain(rows, 2))
    few = [(1, [0.0, 1.0]), (2, [5.0, 1.0])]
    assert in_order(cluster(table(spark, few), dimensions=2).collect()) == in_order(plain(few, 2))
    assert cluster(table(spark, few), dimensions=3).count() == 0
    assert cluster(table(spark, []), dimensions=3).count() == 0


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        cluster(table(spark, [(1, [1e30, 0.0])]), dimensions=2).count()


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, c = rng.integers(-500, 500, (400, 6)), rng.integers(-500, 500, (9, 6))
    cuts = np.quantile(x, np.arange(1, centroids.CELLS) / centroids.CELLS, axis=0).astype("i8").T
    grid = Grid(np.hstack([x.min(axis=0)[:, None], cuts + 1]), np.hstack([cuts, x.max(axis=0)[:, None]]))
    cells, sums = unpacked(grid.cells(x), 6), grid.bounds(c)
    total = sum(sums[d][cells[:, d]] for d in range(6))
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (total[:, :9] <= exact).all() and (exact <= total[:, 9:]).all()
    left = centroids.candidates(grid, sums, c, cells)
    # All centroids at the least distance stay, and few others do.
    assert left[exact == exact.min(axis=1, keepdims=True)].all() and left.sum() < 1.5 * len(x)


def test_stored_vectors_are_not_shuffled(spark, sf_dir):
    kept = centroids.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    file = centroids.VectorFile(kept, 64)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    plan = file.fetch(file.state.where("row % 7 = 0"), "x")
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(threshold, before)
    file.close()
    assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 1


def test_few_vectors_are_fetched(spark):
    """Where clusters lie apart, the intervals settle nearly all vectors."""
    rng = np.random.default_rng(1)
    centers = rng.integers(-20, 20, (8, 16))
    rows = [(i, [float(v) for v in centers[i % 8] + rng.normal(0, 0.05, 16)]) for i in range(800)]
    kept = centroids.integer_vectors(table(spark, rows), 16)
    file = centroids.VectorFile(kept.cache(), 16)
    last = centroids.rounds(file, np.floor(256 * centers).astype("i8"), 2)
    seen = centroids._bounded(file.state, file.grid, last)
    opened = seen.where("nearest IS NULL").count()
    file.close()
    assert opened < 80
