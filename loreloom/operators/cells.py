"""Trained cells over vectors: approximate top-k with product codes, and exact top-k that skips by the triangle inequality.

k-means centres, learnt from a bounded sample, part the unit vectors into cells. ``indexed`` stores each vector once, with
its cell, its distance to the centre (``radius``) and a product code of what the centre leaves over. Both searches send the
queries to the rows, as ``cosine_topk`` does; only rows of cells that a query may need are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom import constants as K
from loreloom.functions.vectors import DISTANCE_DECIMALS
from loreloom.operators.sizing import broadcast_if_bounded
from loreloom.operators.topk import BROADCAST_BYTES, _best, _limit_column, _matrix
from loreloom.sources.tables import stored

#: Vectors that the centres and codes are learnt from, drawn by a hash of their ids.
SAMPLE = 16_384
CODEWORDS = 256
#: A query looks at the codes of as many times k rows at least.
LEAST = 3
#: Neighbours in the sample that the cells a query looks at are to hold.
HELD = 0.97
#: Share of a key's rows that give the exact search its first bound.
FIRST = 0.1
#: Rounding of distances and of float vectors must not prune a hit.
SLACK = 1e-6


@dataclass
class Cells:
    centres: np.ndarray    # cells x dimensions
    codewords: np.ndarray  # parts x CODEWORDS x dimensions of a part
    share: float           # of a key's rows, what a query looks at
    rerank: int            # candidates that are compared exactly, in multiples of k


def _kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=k)
        empty = counts == 0
        centres = np.where(empty[:, None], points[random.integers(len(points), size=k)], sums / np.maximum(counts, 1)[:, None])
    return centres


def _units(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1)[:, None]
    return vectors / np.where(size > 0, size, 1.0)


def _needed(points: np.ndarray, centres: np.ndarray, cell: np.ndarray, coded: np.ndarray, queries: int = 256, k: int = 10) -> tuple[float, int]:
    """What holds HELD of the ``k`` nearest of a query: the share of rows in its nearest cells, small where vectors cluster and
    near 1 where they don't, and how many times k of the best by code. Queries are sampled points, and points between two of
    them, which are in no cluster."""
    shares, depths = [], []
    for asked in (points[:queries], _units(points[:queries] + points[::-1][:queries])):
        near = asked @ points.T
        itself = near > 1 - 1e-9
        near[itself] = -np.inf
        most = min(k, len(points) - 1)
        if most < 1:
            return 1.0, LEAST
        best = np.argpartition(-near, most - 1, axis=1)[:, :most]
        order = np.argsort(-(asked @ centres.T - (centres**2).sum(axis=1) / 2), axis=1)
        size = np.bincount(cell, minlength=len(centres))[order]
        before = np.empty(order.shape)
        np.put_along_axis(before, order, (np.cumsum(size, axis=1) - size) / len(points), axis=1)
        shares.append(float(np.quantile(np.take_along_axis(before, cell[best], axis=1), HELD)))
        by_code = np.where(itself, -np.inf, asked @ coded.T)
        place = np.argsort(np.argsort(-by_code, axis=1), axis=1)
        depths.append(float(np.quantile(np.take_along_axis(place, best, axis=1), HELD)))
    return min(1.0, max(shares) + 1 / len(points)), max(LEAST, math.ceil((max(depths) + 1) / most))


def train_cells(vectors: DataFrame, cells: int | None = None, parts: int | None = None, sample: int = SAMPLE, seed: int = 5) -> Cells:
    """Centres, codewords, share and depth from ``sample`` vectors at most; by default about as many cells as the root of the sample.
    Null and zero vectors are not used; without any vector there is nothing to learn, an error."""
    drawn = vectors.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).orderBy(
        F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow()
    if drawn.num_rows == 0:
        raise ValueError("cells can't be learnt without vectors")
    points = _units(_matrix(drawn["embedding"]))
    k = min(cells or max(1, math.isqrt(len(points))), len(points))
    centres = _kmeans(points, k, seed)
    cell = np.argmax(points @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
    left = points - centres[cell]
    dimensions = points.shape[1]
    parts = parts or next(p for p in range(max(1, dimensions // 4), 0, -1) if dimensions % p == 0)
    blocks = np.split(left, parts, axis=1)
    codewords = np.stack([_kmeans(b, min(CODEWORDS, len(b)), seed + i) for i, b in enumerate(blocks)])
    coded = centres[cell] + np.hstack([w[np.argmax(b @ w.T - (w**2).sum(axis=1) / 2, axis=1)] for b, w in zip(blocks, codewords, strict=True)])
    return Cells(centres, codewords, *_needed(points, centres, cell, coded))


def indexed(vectors: DataFrame, cells: Cells, on: tuple[str, ...] = ("owner",)) -> DataFrame:
    """(chunk_id, *on, cell, radius, code, embedding), stored and sorted by key, cell and radius, so that a scan can skip row
    groups. Null and zero vectors, which have no distance, are left out; one of another length is an error."""
    centres, codewords = cells.centres, cells.codewords
    rows = vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", *on, "embedding")
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType()),
                        T.StructField("code", T.BinaryType()), rows.schema["embedding"]])

    def run(batches):
        half = (centres**2).sum(axis=1) / 2
        for batch in batches:
            matrix = _matrix(pa.chunked_array([batch.column("embedding")]))
            if not len(matrix):
                continue
            if matrix.shape[1] != centres.shape[1]:
                raise ValueError(f"cells have {centres.shape[1]} dimensions, a vector has {matrix.shape[1]}")
            some = np.linalg.norm(matrix, axis=1) > 0
            batch, points = batch.filter(pa.array(some)), _units(matrix[some])
            cell = np.argmax(points @ centres.T - half, axis=1)
            left = points - centres[cell]
            code = np.stack([np.argmax(part @ words.T - (words**2).sum(axis=1) / 2, axis=1).astype(np.uint8)
                             for part, words in zip(np.split(left, len(codewords), axis=1), codewords, strict=True)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(cell, pa.int32()), pa.array(np.linalg.norm(left, axis=1)),
                 pa.array([c.tobytes() for c in code], pa.binary()), batch.column("embedding")], names=out.fieldNames())

    return stored(rows.mapInArrow(run, out).repartition(*on, "cell").sortWithinPartitions(*on, "cell", "radius"), "cells")


def _asked(queries: DataFrame, k: int, on: tuple[str, ...]) -> DataFrame:
    usable = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)
    return stored(queries.withColumn("k", _limit_column(queries, k)).filter(usable & (F.col("k") > 0)).select(
        "query_id", *on, "vector", "k"), "cell-queries")


def _cell_distances(asked: DataFrame, cells: Cells) -> DataFrame:
    """(query_id, *on, k, cell, apart) for every query and cell: a bounded number of rows for each query."""
    centres = cells.centres
    kept = [f for f in asked.schema.fields if f.name != "vector"]

    def run(batches):
        for batch in batches:
            points = _matrix(pa.chunked_array([batch.column("vector")]))
            if not len(points):
                continue
            if points.shape[1] != centres.shape[1]:
                raise ValueError(f"cells have {centres.shape[1]} dimensions, a query has {points.shape[1]}")
            apart = np.linalg.norm(_units(points)[:, None, :] - centres, axis=2)
            place = pa.array(np.repeat(np.arange(len(points)), len(centres)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name).take(place) for f in kept] + [pa.array(np.tile(np.arange(len(centres), dtype=np.int32), len(points))),
                                                                     pa.array(apart.ravel())],
                names=[*[f.name for f in kept], "cell", "apart"])

    return asked.mapInArrow(run, T.StructType([*kept, T.StructField("cell", T.IntegerType()), T.StructField("apart", T.DoubleType())]))


def _nearest_cells(asked: DataFrame, index: DataFrame, cells: Cells, on: tuple[str, ...], share: float | None) -> DataFrame:
    """(query_id, cell): for each query its nearest cells, until they hold ``share`` of the key's rows and LEAST times k."""
    sizes = stored(index.groupBy(*on, "cell").agg(F.count("*").alias("n")), "cell-sizes")
    total = sizes.groupBy(*on).agg(F.sum("n").alias("total"))
    before = Window.partitionBy("query_id", *on).orderBy("apart", "cell").rowsBetween(Window.unboundedPreceding, -1)
    held = _cell_distances(asked, cells).join(sizes, [*on, "cell"]).join(total, list(on))
    need = F.greatest(F.col("k") * LEAST, F.ceil(F.col("total") * F.lit(cells.share if share is None else share)))
    return held.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("_before") < need).select(
        "query_id", *on, "cell", "apart")


def _groups(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each distinct key of a batch with the places of its rows."""
    if not batch.num_rows:
        return
    codes = np.zeros(batch.num_rows, np.int64)
    for name in names:
        coded = batch.column(name).dictionary_encode(null_encoding="encode")
        codes = codes * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for places in np.split(order, starts[1:]):
        yield tuple(batch.column(name)[int(places[0])].as_py() for name in names), places


def _scan(asked: DataFrame, index: DataFrame, on: tuple[str, ...], columns: list[str],
          score: Callable[[np.ndarray, pa.Table, pa.RecordBatch], np.ndarray], keep: int, broadcast_bytes: int) -> DataFrame:
    """(query_id, chunk_id, distance, k): rows of the cells in ``asked`` with the distance that ``score`` gives (infinite: none),
    the k * ``keep`` best of each query and task. ``asked`` is stored and measured; beyond ``broadcast_bytes`` it goes
    in several pieces, each a pass over the index."""
    names = [*on, "cell"]
    size = asked.agg(F.sum(F.size("vector") * 8 + 96)).first()[0] or 0
    turns = max(1, -(-int(size) // broadcast_bytes))
    out = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("chunk_id", index.schema["chunk_id"].dataType),
                        T.StructField("distance", T.DoubleType()), T.StructField("k", T.IntegerType())])
    spark = index.sparkSession
    passes = []
    for turn in range(turns):
        part = asked if turns == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn)
        table = part.toArrow()
        shared = spark.sparkContext.broadcast(table)
        wanted = part.select("cell").distinct()
        few = [r[0] for r in wanted.limit(1001).collect()]
        rows = index.filter(F.col("cell").isin(few)) if len(few) <= 1000 else index

        def run(batches, shared=shared):
            table = shared.value
            by_key: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[table[n].to_pylist() for n in names], strict=True)):
                by_key.setdefault(key, []).append(i)
            own = {key: (table.take(pa.array(at)), _units(_matrix(table["vector"].take(pa.array(at))))) for key, at in by_key.items()}
            best: pa.Table | None = None
            for batch in batches:
                found = []
                for key, places in _groups(batch, names):
                    if key not in own:
                        continue
                    queries, points = own[key]
                    part = batch.take(pa.array(places))
                    distance = score(points, queries, part)
                    most = min(int(max(queries["k"].to_pylist())) * keep, distance.shape[1])
                    worst = np.partition(distance, most - 1, axis=1)[:, most - 1]
                    query, row = np.nonzero((distance <= worst[:, None]) & np.isfinite(distance))
                    found.append(pa.table({"query_id": queries["query_id"].take(pa.array(query)), "chunk_id": part.column("chunk_id").take(pa.array(row)),
                                           "distance": distance[query, row], "k": queries["k"].take(pa.array(query))}))
                if found:
                    best = _kept_best(pa.concat_tables([best, *found] if best is not None else found), keep)
            if best is not None:
                yield from best.to_batches()

        passes.append(rows.select("chunk_id", *names, *columns).mapInArrow(run, out))
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    return hits


def _kept_best(hits: pa.Table, keep: int) -> pa.Table:
    """Of each query the k * ``keep`` best, and all that tie with the last of them."""
    hits = hits.sort_by([("query_id", "ascending"), ("distance", "ascending")]).combine_chunks()
    query = hits["query_id"].combine_chunks()
    query = pa.concat_arrays(query.chunks) if isinstance(query, pa.ChunkedArray) else query
    codes = query.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.searchsorted(codes, np.arange(codes.max(initial=-1) + 1))
    distance, k = hits["distance"].to_numpy(), hits["k"].to_numpy() * keep
    last = np.minimum(first[codes] + k - 1, np.append(first[1:], len(codes))[codes] - 1)
    return hits.filter(pa.array(distance <= distance[last]))


def _exact(points: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
    rows = _units(_matrix(pa.chunked_array([part.column("embedding")])))
    return np.round(1.0 - points @ rows.T, DISTANCE_DECIMALS) + 0.0


def cells_topk(queries: DataFrame, index: DataFrame, cells: Cells, k: int = K.DEFAULT_LIMIT, *, on: tuple[str, ...] = ("owner",),
               share: float | None = None, rerank: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Approximate k nearest: query_id, chunk_id, distance, rank as ``cosine_topk``, distances exact.

    A query looks at the product codes of its nearest cells, which hold ``share`` of its key's rows (by default the share that
    training found to be needed); the best k * ``rerank`` by code (again as training found) are compared exactly. A query whose key has k rows gets k hits. Null and zero vectors have none."""
    asked, rerank = _asked(queries, k, on), rerank or cells.rerank
    probes = stored(_nearest_cells(asked, index, cells, on, share).join(asked, ["query_id", *on]), "probes")
    centres, codewords = cells.centres, cells.codewords

    def by_code(points, queries, part):
        code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, len(codewords))
        near = (points @ centres[part.column("cell")[0].as_py()])[:, None]
        for i, block in enumerate(np.split(points, len(codewords), axis=1)):
            near = near + (block @ codewords[i].T)[:, code[:, i]]
        return 1.0 - near

    coded = _scan(probes, index, on, ["code"], by_code, rerank, broadcast_bytes)
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    chosen = stored(coded.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= F.col("k") * rerank).select(
        "query_id", "chunk_id", "k"), "by-code")
    near = broadcast_if_bounded(chosen).join(index.select("chunk_id", "embedding"), "chunk_id").join(
        broadcast_if_bounded(asked.select("query_id", "vector")), "query_id")

    @F.arrow_udf("double")
    def distance(vector: pa.Array, embedding: pa.Array) -> pa.Array:
        if not len(vector):
            return pa.array([], pa.float64())
        left, right = (_units(_matrix(pa.chunked_array([x]))) for x in (vector, embedding))
        return pa.array(np.round(1.0 - (left * right).sum(axis=1), DISTANCE_DECIMALS) + 0.0)

    return _best(near.select("query_id", "chunk_id", distance("vector", "embedding").alias("distance"), "k"),
                 None if "k" in queries.columns else max(0, k))


def looked_at(queries: DataFrame, index: DataFrame, cells: Cells, k: int = K.DEFAULT_LIMIT, *, on: tuple[str, ...] = ("owner",),
              share: float | None = None) -> DataFrame:
    """(query_id, rows, looked): rows of the query's key, and those whose codes ``cells_topk`` looks at."""
    asked = _asked(queries, k, on)
    sizes = index.groupBy(*on, "cell").agg(F.count("*").alias("n"))
    probed = _nearest_cells(asked, index, cells, on, share).join(sizes, [*on, "cell"]).groupBy("query_id").agg(F.sum("n").alias("looked"))
    return asked.join(sizes.groupBy(*on).agg(F.sum("n").alias("rows")), list(on)).select("query_id", "rows").join(probed, "query_id")


def _bounds(asked: DataFrame, index: DataFrame, cells: Cells, on: tuple[str, ...], share: float | None, broadcast_bytes: int) -> DataFrame:
    """(query_id, *on, vector, k, cell, low, high): the radii at which a cell can hold a row as near as the k-th best of the query's
    nearest cells; cells that hold no such radius are left out.

    On unit vectors the cosine distance d is a chord of length sqrt(2 d), and lengths keep the triangle inequality: a row
    within that length b of the query is between apart - b and apart + b from its centre."""
    probes = stored(_nearest_cells(asked, index, cells, on, share).join(asked, ["query_id", *on]), "pivot-probes")
    first = _scan(probes, index, on, ["embedding"], lambda points, queries, part: _exact(points, part), 1, broadcast_bytes)
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    kth = first.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == F.col("k")).select(
        "query_id", F.sqrt(F.greatest(F.lit(0.0), F.col("distance") + F.lit(SLACK)) * 2).alias("bound"))
    held = index.groupBy(*on, "cell").agg(F.min("radius").alias("least"), F.max("radius").alias("most"))
    near = _cell_distances(asked, cells).join(held, [*on, "cell"]).join(kth, "query_id", "left")
    # Fewer than k rows there: no bound yet, all rows are asked for.
    bound = F.coalesce("bound", F.lit(4.0)) + F.lit(SLACK)
    near = near.withColumns({"low": F.col("apart") - bound, "high": F.col("apart") + bound}).filter(
        (F.col("most") >= F.col("low")) & (F.col("least") <= F.col("high")))
    return stored(near.select("query_id", *on, "cell", "low", "high").join(asked, ["query_id", *on]), "pivot-bounds")


def pruned_topk(queries: DataFrame, index: DataFrame, cells: Cells, k: int = K.DEFAULT_LIMIT, *, on: tuple[str, ...] = ("owner",),
                share: float = FIRST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact k nearest, the rows of ``cosine_topk``: rows that the triangle inequality rules out are not scored.

    The k-th best of a query's nearest cells bounds how far a hit can be; from the stored radii follows which rows of the other
    cells can be that near. Where nothing can be ruled out all rows are scored."""
    asked = _asked(queries, k, on)

    def within(points, queries, part):
        radius = part.column("radius").to_numpy()
        low, high = queries["low"].to_numpy(), queries["high"].to_numpy()
        possible = (radius >= low[:, None]) & (radius <= high[:, None])
        some = possible.any(axis=0)
        out = np.full(possible.shape, np.inf)
        if some.any():
            out[:, some] = _exact(points, part.filter(pa.array(some)))
        return np.where(possible, out, np.inf)

    hits = _scan(_bounds(asked, index, cells, on, share, broadcast_bytes), index, on, ["radius", "embedding"], within, 1, broadcast_bytes)
    return _best(hits, None if "k" in queries.columns else max(0, k))


def skipped(queries: DataFrame, index: DataFrame, cells: Cells, k: int = K.DEFAULT_LIMIT, *, on: tuple[str, ...] = ("owner",),
            share: float = FIRST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rows, scored): rows of the query's key, and those that ``pruned_topk`` can't rule out."""
    asked = _asked(queries, k, on)
    bounds = _bounds(asked, index, cells, on, share, broadcast_bytes).select("query_id", *on, "cell", "low", "high")
    rows = index.groupBy(*on).agg(F.count("*").alias("rows"))
    hit = index.select(*on, "cell", "radius").join(broadcast_if_bounded(bounds), [*on, "cell"]).filter(
        F.col("radius").between(F.col("low"), F.col("high"))).groupBy("query_id").agg(F.count("*").alias("scored"))
    return asked.join(rows, list(on)).select("query_id", "rows").join(hit, "query_id", "left").na.fill(0, ["scored"])
