import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loreloom.llm import sharding
from loreloom.llm.sharding import communication_matrix, hypergeometric, shard_documents, shuffle_into_shards, write_shards


@pytest.mark.parametrize(("good", "bad", "draws"), [(5, 7, 4), (40, 60, 30), (3, 2, 5), (0, 4, 2), (4, 0, 2), (1000, 9000, 500)])
def test_hypergeometric_law(good, bad, draws):
    rng = random.Random(1)
    got = np.array([hypergeometric(rng, good, bad, draws) for _ in range(4000)])
    wanted = np.random.default_rng(1).hypergeometric(good, bad, draws, 40_000)
    assert got.min() >= max(0, draws - bad) and got.max() <= min(good, draws)
    assert abs(got.mean() - wanted.mean()) <= 4 * wanted.std() / 4000**0.5 + 1e-9
    assert abs(got.std() - wanted.std()) <= 0.06 * wanted.std() + 1e-9


def test_large_numbers():
    rng = random.Random(2)
    got = [hypergeometric(rng, 10**9, 23 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(got) - 10**6 / 24) < 100 and 100 < np.std(got) < 300


def test_matrix_sums():
    matrix = communication_matrix([5, 0, 17, 9], [8, 8, 8, 7], random.Random(3))
    assert [sum(r) for r in matrix] == [5, 0, 17, 9] and [sum(c) for c in zip(*matrix)] == [8, 8, 8, 7]


@pytest.mark.parametrize("slot_rows", [65_536, 3])
def test_shards_and_slots(spark, slot_rows):
    rows = spark.range(1000).selectExpr("id % 7 AS same", "id", "'x' AS slot", "1 AS _n", "2 AS _part", "3 AS row").repartition(6)
    got = shuffle_into_shards(rows, 7, 5, slot_rows=slot_rows).collect()
    assert sorted(r.id for r in got) == list(range(1000))
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


@pytest.mark.parametrize(("partitions", "most"), [(1, 4), (40, 4), (3, 1000), (1, 1000)])
def test_parts_are_bounded_in_rows(spark, monkeypatch, partitions, most):
    """One large input partition is several parts, many small ones share a part; all rows arrive, equal ones too."""
    drawn = []
    real = sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda counts, *rest: drawn.extend(counts) or real(counts, *rest))
    rows = spark.range(3000).selectExpr("CAST(NULL AS string) AS text").coalesce(1).repartition(partitions)
    got = shuffle_into_shards(rows, 5, slot_rows=100, most_parts=most).collect()
    assert sum(drawn) == len(got) == 3000 and set(Counter(r.shard for r in got).values()) == {600}
    assert len(drawn) <= max(2 * most, partitions) + partitions and max(drawn) <= 2 * max(100, 3000 // most)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(600)) for s in range(5))


def test_every_place_is_as_likely(spark):
    """Over many seeds a row is in each shard equally often, and two rows share a shard as often as by chance."""
    rows = spark.range(60).repartition(3)
    shared, hits, runs = 0, Counter(), 40
    for seed in range(runs):
        got = {r.id: r.shard for r in shuffle_into_shards(rows, 4, seed, slot_rows=5).collect()}
        hits.update((i, s) for i, s in got.items())
        shared += sum(got[i] == got[i + 1] for i in range(59))
    assert max(hits.values()) < 25
    assert abs(shared / (runs * 59) - 14 / 59) < 0.04


def test_documents(spark, tmp_path):
    rows = [(i, "é" * (i % 5), 1) for i in range(100)] + [(None, None, 2), (3, "ééé", 1), (5, "long" * 200_000, 1)]
    placed = shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string, shard int"))
    got = placed.collect()
    as_key = lambda i, s, c: (-1 if i is None else i, s, c)
    assert sorted(as_key(r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(
        as_key(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert dict(placed.dtypes)["slot"] == "bigint" and dict(placed.dtypes)["shard"] == "int"
    write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_few_rows_and_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert [(r.shard, r.slot) for r in shuffle_into_shards(spark.range(1), 5).collect()] == [(0, 0)]
