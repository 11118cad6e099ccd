"""Dense search against all comparisons."""

import numpy as np
import pytest

from assay.operators import dense
from assay.session import scratch_path


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def plain(rows, queries, k):
    kept = [(i, np.array(v) / np.sqrt(sum(x * x for x in v))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in kept:
        if i in queries:
            scored = sorted((-round(float(q @ u), 7), j) for j, u in kept if j != i)[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def found(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.cosine, 7)))
    return out


@pytest.mark.parametrize("probes", [1, 3])
def test_equals_all_comparisons(spark, probes):
    """Copies, a vector of length zero, missing components; clusters and vectors far from all centres."""
    rng = np.random.default_rng(probes)
    centers = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(0, 0.2 if i % 7 else 2.0, 8)]) for i in range(240)]
    rows += [(300, rows[4][1]), (301, [2 * x for x in rows[4][1]]), (302, [0.0] * 8), (303, None), (304, [None] * 8), (305, [float("nan")] * 8)]
    vectors = table(spark, rows)
    index = dense.build_index(vectors, scratch_path(spark, "dense"), cells=6)
    asked = {i for i, _ in rows if i % 20 == 0} | {4, 300, 302}
    got = found(dense.search(vectors.where(vectors.vec_id.isin(sorted(asked))), index, k=5, probes=probes))
    want = plain(rows, asked, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [c for _, c in got[q]] == pytest.approx([c for _, c in want[q]], abs=2e-7)
    assert got[4][0][1] == got[4][1][1] == 1.0 and {i for i, _ in got[4][:2]} == {300, 301}


def test_cells_that_can_not_help_are_not_read(spark):
    rng = np.random.default_rng(2)
    centers = np.eye(8) * 10
    rows = [(i, [float(x) for x in centers[i % 8] + rng.normal(0, 0.3, 8)]) for i in range(400)]
    vectors = table(spark, rows)
    index = dense.build_index(vectors, scratch_path(spark, "dense"), cells=8)
    result = dense.search(vectors.where("vec_id < 16"), index, k=5, probes=1)
    assert result.count() == 80
    assert sum(r["size"] for r in index.cells.collect()) == 400


def test_few_rows(spark):
    vectors = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])
    index = dense.build_index(vectors, scratch_path(spark, "dense"), cells=2)
    assert {q: [i for i, _ in r] for q, r in found(dense.search(vectors, index, k=10, probes=1)).items()} == {1: [3, 2], 2: [3, 1], 3: [1, 2]}


def test_no_vectors(spark):
    nothing = table(spark, [(1, None)])
    index = dense.build_index(nothing, scratch_path(spark, "dense"))
    assert dense.search(table(spark, [(2, [1.0, 0.0])]), index).count() == 0


def test_pairs_are_no_rows(spark):
    """A task leaves the nearest of its block: as many copies as there are, a query with k = 3 gets a few rows of each, the smallest ids first."""
    vectors = table(spark, [(i, [1.0, 0.0]) for i in range(400)] + [(1000 + i, [1.0, i / 100]) for i in range(400)])
    index = dense.build_index(vectors, scratch_path(spark, "dense"), cells=2)
    asked = dense.unit_vectors(vectors.where("vec_id IN (5, 1007)"), "vec_id", "embedding").withColumnRenamed("id", "query_id")
    asked = asked.crossJoin(index.cells.select("cell"))
    best = dense._looked_up(asked, index, 3, block_rows=100)
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    got = {}
    for r in best.collect():
        got.setdefault(r.query_id, []).append((-r.cosine, r.id))
    assert sorted(got[5]) == [(-1.0, 0), (-1.0, 1), (-1.0, 2)]
    assert {i for _, i in got[1007]} < {1005, 1006, 1008, 1009}
