import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.functions import vectors as V
from loreloom.functions.embedding import HashingEmbedder, ModelEmbedder
from loreloom.operators.topk import approximate_topk, cosine_topk, nearest

Q = "query_id string, owner string, vector array<double>"
C = "chunk_id bigint, owner string, embedding array<float>"


def brute(queries, chunks, k):
    out = {}
    for qid, owner, vector in queries:
        scored = []
        for cid, chunk_owner, embedding in chunks:
            if owner != chunk_owner or embedding is None or not any(embedding):
                continue
            a, b = np.array(vector), np.array(embedding, dtype=np.float32).astype(float)
            scored.append((round(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), 9) + 0.0, cid))
        out[qid] = [cid for _, cid in sorted(scored)[:k]]
    return out


def collected(hits):
    out = {}
    for row in hits.orderBy("query_id", "rank").collect():
        out.setdefault(row.query_id, []).append(row.chunk_id)
    return out


def data(owners=3, chunks=200, queries=12, dims=8, seed=5):
    rng = np.random.default_rng(seed)
    # The first owner holds most rows; some vectors repeat and some are missing or zero.
    owner = lambda i: f"o{0 if i % 3 else i % owners}"
    c = [(i, owner(i), rng.integers(-3, 4, dims).astype(float).tolist()) for i in range(chunks)]
    c[3] = (3, c[3][1], None)
    c[4] = (4, c[4][1], [0.0] * dims)
    c += [(1000 + i, o, v) for i, (_, o, v) in enumerate(c[:40])]
    q = [(f"q{i}", owner(i), rng.integers(-3, 4, dims).astype(float).tolist()) for i in range(queries)]
    return q, c


@pytest.mark.parametrize("k", [5, 50])
@pytest.mark.parametrize("cells", [None, (16384, 2048), (16, 4), (7, 1)])
def test_topk_equals_brute_force(spark, cells, k):
    q, c = data()
    sizes = {"cell_vectors": cells[0], "cell_queries": cells[1], "broadcast_bytes": 0} if cells else {}
    hits = cosine_topk(spark.createDataFrame(q, Q), spark.createDataFrame(c, C).repartition(5), k, **sizes)
    assert collected(hits) == {k: v for k, v in brute(q, c, k).items() if v}


def test_few_queries_go_to_the_vectors(spark):
    q, c = data()
    hits = cosine_topk(spark.createDataFrame(q, Q), spark.createDataFrame(c, C), 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and "WindowGroupLimit" in plan
    # The owners asked for are a filter on the scan.
    assert "Filter" in plan and "= o0" in plan


def test_several_keys_and_null_keys(spark):
    q = [("q1", "a", 1, [1.0, 0.0]), ("q2", "a", 2, [1.0, 0.0]), ("q3", None, 1, [1.0, 0.0])]
    c = [(1, "a", 1, [1.0, 0.0]), (2, "a", 2, [1.0, 0.0]), (3, "b", 1, [1.0, 0.0])]
    hits = cosine_topk(spark.createDataFrame(q, "query_id string, owner string, part int, vector array<double>"),
                       spark.createDataFrame(c, "chunk_id long, owner string, part int, embedding array<float>"), 3,
                       on=("owner", "part"))
    assert collected(hits) == {"q1": [1], "q2": [2]}


def test_topk_of_identical_vectors_takes_lowest_ids(spark):
    c = [(i, "a", [1.0, 1.0]) for i in range(50)]
    hits = cosine_topk(spark.createDataFrame([("q", "a", [2.0, 2.0])], Q), spark.createDataFrame(c, C), 4,
                       cell_vectors=9, broadcast_bytes=0)
    assert collected(hits) == {"q": [0, 1, 2, 3]}
    assert {r.distance for r in hits.collect()} == {0.0}


def test_limits_per_query(spark):
    q = spark.createDataFrame([("z", "a", [1.0], 0), ("one", "a", [1.0], 1), ("all", "a", [1.0], 99),
                               ("neg", "a", [1.0], -1), ("none", "a", [1.0], None)], Q + ", k int")
    c = spark.createDataFrame([(i, "a", [1.0]) for i in range(30)], C)
    got = {k: len(v) for k, v in collected(cosine_topk(q, c, 5)).items()}
    assert got == {"one": 1, "all": 30, "none": 5}


def test_zero_vectors(spark):
    q = spark.createDataFrame([("q", "a", [1.0, 0.0])], Q)
    c = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", [-1.0, 0.0])], C)
    assert collected(cosine_topk(q, c, 5)) == {"q": [2]}
    both = cosine_topk(q, c, 5, include_zero=True)
    assert collected(both) == {"q": [2, 1]}
    scores = both.orderBy("rank").select(V.similarity_from_distance(F.col("distance"))).collect()
    assert [s[0] for s in scores] == [0.0, 1.0]


def test_owner_isolation(spark):
    q = spark.createDataFrame([("q", "ada", [0.1] * 384)], Q)
    c = spark.createDataFrame([(1, "ada", [0.1] * 384), (2, "grace", [0.1] * 384)], C)
    row, = cosine_topk(q, c, 2).collect()
    assert row.chunk_id == 1 and row.distance == pytest.approx(0, abs=1e-4)


def test_mixed_dimensions_are_refused(spark):
    q = spark.createDataFrame([("q", "a", [1.0])], Q)
    with pytest.raises(Exception, match="dimensions"):
        cosine_topk(q, spark.createDataFrame([(1, "a", [1.0, 2.0])], C)).collect()


def test_plan_has_no_cartesian_product(spark):
    q, c = data()
    hits = cosine_topk(spark.createDataFrame(q, Q), spark.createDataFrame(c, C), 5, cell_vectors=16, broadcast_bytes=0)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_nearest_uses_a_bounded_heap(spark):
    _, c = data()
    chunks = spark.createDataFrame(c, C).filter("owner = 'o0'")
    vector = [1.0, 2.0, 0.0, -1.0, 0.5, 0.0, 1.0, 1.0]
    top = nearest(chunks, vector, 5)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    assert [r.chunk_id for r in top.collect()] == brute([("q", "o0", vector)], c, 5)["q"]


def test_approximate_finds_identical_vectors_and_right_distances(spark):
    q, c = data(chunks=300)
    queries, chunks = spark.createDataFrame(q, Q), spark.createDataFrame(c, C)
    exact = {(r.query_id, r.chunk_id): r.distance for r in cosine_topk(queries, chunks, 20).collect()}
    found = approximate_topk(queries, chunks, 5, dimensions=8, tables=10, bits=3).collect()
    assert found and all(exact.get((r.query_id, r.chunk_id), r.distance) == r.distance for r in found)
    hits = sum((r.query_id, r.chunk_id) in exact for r in found)
    assert hits >= 0.8 * len(found)
    same = approximate_topk(spark.createDataFrame([("q", "a", [1.0, 2.0])], Q),
                            spark.createDataFrame([(1, "a", [2.0, 4.0]), (2, "b", [2.0, 4.0])], C), dimensions=2)
    assert [(r.chunk_id, r.distance) for r in same.collect()] == [(1, 0.0)]
    with pytest.raises(Exception, match="dimensions"):
        approximate_topk(spark.createDataFrame([("q", "a", [1.0])], Q),
                         spark.createDataFrame([(1, "a", [2.0])], C), dimensions=2).collect()


def test_approximate_recall_and_whole_lists(spark):
    rng = np.random.default_rng(3)
    c = [(i, f"o{i % 4}", rng.standard_normal(64).tolist()) for i in range(600)] + [(900, "few", [1.0] * 64), (901, "few", [-1.0] * 64)]
    q = [(f"q{i}", f"o{i % 4}", rng.standard_normal(64).tolist()) for i in range(60)] + [("few", "few", [1.0] * 63 + [2.0])]
    exact = brute(q, c, 5)
    got = collected(approximate_topk(spark.createDataFrame(q, Q), spark.createDataFrame(c, C), 5, dimensions=64))
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in exact.items()} and got["few"] == [900, 901]
    assert sum(len(set(got[i]) & set(exact[i])) for i in exact) >= 0.9 * sum(map(len, exact.values()))
    # So many tables of so many bits leave most queries without k candidates.
    got = collected(approximate_topk(spark.createDataFrame(q, Q), spark.createDataFrame(c, C), 5, dimensions=64, tables=1, bits=12))
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in exact.items()}


def test_scalar_vector_functions(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])],
                                 "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0) and got[1] == 1.0 and math.isnan(got[2])
    units = [r[0] for r in rows.select(V.l2_normalize(F.col("a"))).collect()]
    assert units[0] == pytest.approx([0.6, 0.8]) and units[2] == [0.0, 0.0]
    distances = [None, float("nan"), -1e-17, 0.0, 0.5, 1.0, 2.0]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(distances)], "i int, d double").orderBy("i")
    got = [r[0] for r in d.select(V.similarity_from_distance(F.col("d"))).collect()]
    assert got == [0.0 if x is None else max(0.0, min(1.0, 1.0 - x)) for x in distances]


def test_hashing_embedder(spark):
    rows = spark.createDataFrame([(0, "a b a"), (1, "A B a"), (2, ""), (3, None), (4, "b")], "i int, t string").orderBy("i")
    got = [r[0] for r in rows.select(HashingEmbedder(16).embed(F.col("t"))).collect()]
    assert got[0] == got[1] and len(got[0]) == 16 and got[2] == [0.0] * 16 and got[3] is None
    assert np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-6)
    assert sorted(abs(x) for x in got[4])[-1] == 1.0


def test_model_embedder_normalises_and_checks_dimensions(spark):
    rows = spark.createDataFrame([("ab",), (None,), ("abc",)], "t string").coalesce(1)
    load = lambda: (lambda texts: np.array([[len(t), 0.0] for t in texts]))
    assert [r[0] for r in rows.select(ModelEmbedder(load, 2).embed(F.col("t"))).collect()] == [[1.0, 0.0], None, [1.0, 0.0]]
    with pytest.raises(Exception, match="3-d"):
        rows.select(ModelEmbedder(load, 3).embed(F.col("t"))).collect()


def test_scorer_settles_in_double_precision_what_single_leaves_open():
    """text_search_topk: vectors that single precision can't tell apart, copies, and vectors without direction."""
    import pyarrow as pa

    from loreloom.operators.topk import _cell_scorer

    rng = np.random.default_rng(3)
    base = rng.normal(size=384)
    near = base + rng.normal(size=(300, 384)) * np.geomspace(1e-4, 1e-2, 300)[:, None]
    vectors = np.concatenate([near, near[:50], rng.normal(size=(200, 384)), np.zeros((2, 384)), np.full((1, 384), np.nan)])
    ids = rng.permutation(len(vectors))
    asked = np.concatenate([[base, near[7]], np.zeros((1, 384))])
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64()), ("k", pa.int32())])
    table = pa.table({"chunk_id": ids, "embedding": pa.array(list(vectors), pa.list_(pa.float64()))})
    queries = pa.table({"query_id": [0, 1, 2], "vector": pa.array(list(asked), pa.list_(pa.float64())), "k": pa.array([40, 3, 5], pa.int32())})
    with np.errstate(invalid="ignore"):
        unit, own = (x / np.linalg.norm(x, axis=1)[:, None] for x in (vectors, asked))
        true = np.round(1 - own @ unit.T, 9) + 0.0
    for include_zero in (False, True):
        found = _cell_scorer(schema, include_zero)(queries, table).to_pylist()
        for q, k in enumerate((40, 3, 5)):
            best = sorted((np.inf if np.isnan(d) else d, i) for d, i in zip(true[q], ids.tolist(), strict=True))
            best = [(d, i) for d, i in best if include_zero or np.isfinite(d)][:k]
            got = [(r["distance"], r["chunk_id"]) for r in found if r["query_id"] == q]
            assert [i for _, i in got] == [i for _, i in best]
            assert [d for d, _ in got if d == d] == pytest.approx([d for d, _ in best if np.isfinite(d)], abs=2e-9)


def test_scorer_keeps_vectors_in_single_precision():
    """Python memory of text_search_topk, fallback_answer and record_exchange: no copy of a cell in double precision."""
    import tracemalloc

    import pyarrow as pa

    from loreloom.operators.topk import _cell_scorer

    n, dims = 8192, 384
    flat = np.random.default_rng(1).normal(size=n * dims).astype(np.float32)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(flat))
    table = pa.table({"chunk_id": np.arange(n), "embedding": vectors})
    queries = pa.table({"query_id": np.arange(64), "vector": vectors.slice(0, 64), "k": pa.array(np.full(64, 5), pa.int32())})
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64()), ("k", pa.int32())])
    tracemalloc.start()
    found = _cell_scorer(schema, False)(queries, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 64 * 5 and peak < 2 * flat.nbytes
