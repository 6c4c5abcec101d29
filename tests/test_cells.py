import numpy as np
import pytest

from loreloom.operators.cells import cells_topk, indexed, looked_at, pruned_topk, skipped, train_cells
from loreloom.operators.topk import cosine_topk

VECTORS = "chunk_id bigint, owner string, embedding array<float>"
QUERIES = "query_id string, owner string, vector array<double>"


def rows_of(n, dimensions=16, clusters=12, spread=0.25, seed=2):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((clusters, dimensions))
    points = centres[random.integers(clusters, size=n)] + spread * random.standard_normal((n, dimensions))
    return points.astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def data(spark):
    points = rows_of(1540)
    points, asked = points[:1500], points[1500:]
    rows = [(i, "ada" if i % 3 else "bob", p.tolist()) for i, p in enumerate(points)]
    rows += [(2000, "ada", None), (2001, "ada", [0.0] * 16), (2002, "bob", points[0].tolist()), (2003, "bob", points[0].tolist()),
             (2004, "cyd", points[5].tolist()), (2005, "cyd", points[6].tolist())]
    queries = [(f"q{i}", ["ada", "bob", "cyd", "nobody"][i % 4], p.tolist()) for i, p in enumerate(asked)]
    queries += [("null", "ada", None), ("zero", "ada", [0.0] * 16), ("same", "bob", points[0].tolist())]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(4)
    cells = train_cells(vectors)
    return vectors, spark.createDataFrame(queries, QUERIES), cells, indexed(vectors, cells)


def hits(rows):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.distance, 7)) for r in rows.collect())


def test_pruned_search_is_exact(data):
    vectors, queries, cells, index = data
    assert hits(pruned_topk(queries, index, cells)) == hits(cosine_topk(queries, vectors))
    assert hits(pruned_topk(queries, index, cells, 700)) == hits(cosine_topk(queries, vectors, 700))
    assert hits(pruned_topk(queries, index, cells, 0)) == []


def test_pruned_search_skips_most_of_clustered_rows(data):
    _, queries, cells, index = data
    counts = [r for r in skipped(queries, index, cells).collect() if r.rows > 100]
    assert sum(r.scored for r in counts) < 0.6 * sum(r["rows"] for r in counts)


def test_queries_in_several_passes(data):
    vectors, queries, cells, index = data
    assert hits(pruned_topk(queries, index, cells, broadcast_bytes=20_000)) == hits(cosine_topk(queries, vectors))


def test_nothing_can_be_skipped_when_all_rows_are_alike_far(spark):
    """Rows at right angles to each other and to the query: every one could be the k-th best."""
    rows = [(i, "ada", np.eye(32)[i].tolist()) for i in range(31)]
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = spark.createDataFrame([("q", "ada", np.eye(32)[31].tolist())], QUERIES)
    cells = train_cells(vectors, cells=4)
    index = indexed(vectors, cells)
    assert hits(pruned_topk(queries, index, cells)) == hits(cosine_topk(queries, vectors))
    assert [(r["rows"], r.scored) for r in skipped(queries, index, cells).collect()] == [(31, 31)]


def test_approximate_search_finds_nearly_all_and_looks_at_few(data):
    vectors, queries, cells, index = data
    exact, found = hits(cosine_topk(queries, vectors)), hits(cells_topk(queries, index, cells))
    assert len(found) == len(exact)
    true = {(q, c): d for q, _, c, d in exact}
    assert sum((q, c) in true for q, _, c, _ in found) >= 0.9 * len(exact)
    assert all(abs(true[q, c] - d) < 1e-6 for q, _, c, d in found if (q, c) in true)
    counts = [r for r in looked_at(queries, index, cells).collect() if r.rows > 100]
    assert sum(r.looked for r in counts) <= 0.3 * sum(r["rows"] for r in counts)


def test_a_limit_of_its_own_for_each_query(spark, data):
    vectors, queries, cells, index = data
    limited = queries.limit(4).selectExpr("*", "cast(rand(1) * 7 as int) as k")
    limited = spark.createDataFrame(limited.collect(), limited.schema)
    assert hits(pruned_topk(limited, index, cells)) == hits(cosine_topk(limited, vectors))


def test_other_dimensions_are_an_error(spark, data):
    vectors, queries, cells, index = data
    with pytest.raises(Exception, match="dimensions"):
        indexed(spark.createDataFrame([(1, "ada", [1.0, 2.0])], VECTORS), cells)
    with pytest.raises(Exception, match="dimensions"):
        pruned_topk(spark.createDataFrame([("q", "ada", [1.0])], QUERIES), index, cells).collect()
    with pytest.raises(ValueError):
        train_cells(spark.createDataFrame([], VECTORS))


def test_the_share_grows_where_vectors_do_not_cluster(spark):
    def share(points):
        return train_cells(spark.createDataFrame([(i, "ada", p.tolist()) for i, p in enumerate(points)], VECTORS)).share

    assert share(rows_of(800, clusters=20, spread=0.05)) < 0.2 < 0.5 < share(rows_of(800, dimensions=48, clusters=1, spread=1.0))
