"""The inverted-file index: recall and work of approximate search, exactness, pruning, odd input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkmill.functions import vector
from chunkmill.operators import search, vector_index
from chunkmill.operators.vector_index import VectorIndex
from chunkmill.plans import views

SF = "/root/testdata/sf0.1"
POINTS, ASKED = "id string, vector array<double>", "query_id long, query_vector array<double>"
rows_of = lambda df: sorted((r["query_id"], r["id"], r["score"], r["raw_rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Indexes with a byte for two and for one component over all chunks, the queries whose id is divisible by 20, and the exact answer."""
    points, queries = views.chunks(spark, SF).select("id", "vector"), views.queries(spark, SF)
    at = tmp_path_factory.mktemp("index")
    return VectorIndex.build(points, f"{at}/two"), VectorIndex.build(points, f"{at}/one", dims=1), queries, rows_of(search.knn(points, queries, 15))


def test_approximate_search_finds_most_and_scores_few(spark, stored):
    index, _, queries, exact = stored
    index = VectorIndex.open(spark, index.folder)
    found = rows_of(index.approximate(queries, 15))
    pairs = {(q, i) for q, i, *_ in exact}
    assert len(found) == len(exact) and len(pairs & {(q, i) for q, i, *_ in found}) >= 0.9 * len(exact)
    assert index._estimated(queries, 15).count() <= 0.1 * queries.count() * index.sizes.sum()
    assert {x[:3] for x in found if x[:2] in pairs} <= {x[:3] for x in exact}


def test_exact_search_reads_survivors(stored):
    """Both code widths give the exact answer; a byte for each component leaves few vectors to read."""
    wide, narrow, queries, exact = stored
    assert rows_of(wide.exact(queries, 15)) == rows_of(narrow.exact(queries, 15)) == exact
    assert narrow._survivors(queries, 15).count() <= 0.05 * queries.count() * narrow.sizes.sum()


def test_codes_are_read_without_vectors(stored):
    """Only the last scan, that of the survivors' vectors, has the vectors in its schema."""
    plan = stored[1]._survivors(stored[2], 15)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/one/cells" in line]
    assert scans and not any("vector" in s for s in scans)


def test_one_query_reads_its_cells_alone(stored):
    index, _, queries, exact = stored
    first = queries.orderBy("query_id").first()
    found = index.one([float(x) for x in first["query_vector"]], 15, probes=len(index.sizes))
    assert [(r["id"], r["score"]) for r in found.collect()] == [(i, s) for q, i, s, _ in sorted(exact, key=lambda x: x[3]) if q == first["query_id"]]
    plan = index.one([float(x) for x in first["query_vector"]], 15, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "isnotnull(cell" not in plan.split("PartitionFilters")[1][:12]


def test_clusters_are_pruned(spark, tmp_path):
    """Where vectors lie in clusters, exact search asks few cells and approximate search probes few."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    x = np.repeat(centres, 30, axis=0) + rng.normal(size=(1200, 24)) * 0.05
    points = spark.createDataFrame([(f"p{k:04d}", v.tolist()) for k, v in enumerate(x)], POINTS)
    queries = spark.createDataFrame([(k, x[k * 20].tolist()) for k in range(60)], ASKED)
    index = VectorIndex.build(points, str(tmp_path / "index"), cells=40)
    assert rows_of(index.exact(queries, 10)) == rows_of(search.knn(points, queries, 10))
    assert index._survivors(queries, 10).count() <= 60 * 1200 * 0.1 and index.probes <= 4


def test_blocks_and_copies(spark, tmp_path, monkeypatch):
    """A third of the points are copies of one vector; cells and queries are cut into blocks; more are asked for than there are."""
    monkeypatch.setattr(vector_index, "CODES_BLOCK", 16)
    monkeypatch.setattr(vector_index, "QUERIES_BLOCK", 4)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 6))
    x[:50] = x[0]
    points = spark.createDataFrame([(f"p{k:03d}", v.tolist()) for k, v in enumerate(x)], POINTS)
    queries = spark.createDataFrame([(k, x[k * 7].tolist()) for k in range(20)], ASKED)
    index = VectorIndex.build(points, str(tmp_path / "index"), cells=3)
    for k in (1, 5, 60, 400):
        want = rows_of(search.knn(points, queries, k))
        assert rows_of(index.exact(queries, k)) == want
        assert rows_of(search.knn_arrow(points, queries, k)) == want


def test_queries_pass_by_many_lots_of_points(spark, monkeypatch):
    monkeypatch.setattr(vector, "POINT_BYTES", 500)
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(f"p{k}", rng.normal(size=5).tolist()) for k in range(80)] + [("none", None)], POINTS).repartition(3)
    queries = spark.createDataFrame([(k, rng.normal(size=5).tolist()) for k in range(30)], ASKED)
    assert rows_of(search.knn_arrow(points, queries, 7)) == rows_of(search.knn(points.where("vector is not null"), queries, 7))


def test_scores_of_a_lot_are_bounded(spark, monkeypatch):
    """A lot of 80 points and 30 queries are 2400 scores; a task holds 400 of them, and the ranks are the same."""
    best = vector._best

    def bounded(scores, k):
        assert scores.size <= 400
        return best(scores, k)

    monkeypatch.setattr(vector, "_best", bounded)
    monkeypatch.setattr(vector, "SCORES", 400, raising=False)
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(f"p{k}", rng.normal(size=5).tolist()) for k in range(80)], POINTS).coalesce(1)
    queries = spark.createDataFrame([(k, rng.normal(size=5).tolist()) for k in range(30)], ASKED).coalesce(1)
    assert rows_of(search.knn_arrow(points, queries, 7)) == rows_of(search.knn(points, queries, 7))


def test_vectors_that_cannot_be_compared(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [None, 1.0]), ("e", [math.inf, 1.0]), ("f", [3.0, 4.0]), ("g", [1e300, 1e300]), ("h", [-5.0, 0.0])]
    index = VectorIndex.build(spark.createDataFrame(rows, POINTS), str(tmp_path / "index"))
    assert index.sizes.sum() == 3
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], ASKED)
    assert [(q, i) for q, i, *_ in rows_of(index.exact(queries, 2))] == [(q, i) for q, i, *_ in rows_of(index.approximate(queries, 2))] == [(1, "a"), (1, "f")]
    assert VectorIndex.build(spark.createDataFrame([], POINTS), str(tmp_path / "none")) is None
    assert rows_of(index.exact(queries.limit(0), 2)) == []
