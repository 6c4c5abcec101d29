"""Exact and approximate cosine top-k for a whole batch of queries.

Few query vectors, the normal case, are sent to the vectors: every task scores its part of the scan
against the queries of each row's key and returns its own k best per query, so vectors are never
shuffled. Queries too many for that meet the vectors of their key (an owner) in cells of bounded size: each side is
split into parts, every pair of parts is one cell, and a cell returns only its own k best
per query. Pairs are never rows; a hot owner becomes many tasks; nothing is dropped,
because the k best of a query are among the k best of the parts it visited.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loreloom import constants as K
from loreloom.functions.vectors import DISTANCE_DECIMALS, cosine_distance, has_dimensions
from loreloom.operators.sizing import small_frame
from loreloom.sources.tables import stored

CELL_VECTORS = 16384
CELL_QUERIES = 16384
# Query vectors that are sent to every task: bytes, checked before.
BROADCAST_BYTES = 32 << 20
# Keys that are named in a filter, which the scan can use to skip files.
FILTER_KEYS = 1000
_SCORE_ROWS = 256
# Pairs of vectors compared in double precision at once.
_PAIRS = 8192


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as they are stored, a row each."""
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    if len(array) == 0:
        return np.zeros((0, 0))
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), lengths[0])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _raw(column).astype(np.float64)


def _directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, unit vectors in single precision); double precision is only ever held for a block of rows."""
    norms, units = np.empty(len(vectors)), np.empty(vectors.shape, np.float32)
    for start in range(0, len(vectors), _SCORE_ROWS):
        rows = slice(start, start + _SCORE_ROWS)
        block = vectors[rows].astype(np.float64)
        norms[rows] = np.linalg.norm(block, axis=1)
        units[rows] = block / norms[rows, None]
    return norms, units


def _cell_scorer(schema: pa.Schema, include_zero: bool):
    """The k best of each query: single precision rules out what can't be among them by its error bound, the rest has its distance in
    double precision."""
    def score(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or vectors.num_rows == 0:
            return schema.empty_table()
        place_of = np.empty(vectors.num_rows, np.int64)
        place_of[pc.sort_indices(vectors["chunk_id"]).to_numpy()] = np.arange(vectors.num_rows)
        left, right = _raw(queries["vector"]), _raw(vectors["embedding"])
        if left.shape[1] != right.shape[1]:
            raise ValueError(f"query has {left.shape[1]} dimensions, chunk has {right.shape[1]}")
        limits = queries["k"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            (left_norm, left_unit), (right_norm, right_unit) = _directions(left), _directions(right)
        # Both ends of a comparison may be off by the error of a product of unit vectors, and distances are rounded.
        margin = np.float32(2.02 * (left.shape[1] + 4) * 2.0 ** -24 + 4 * 10.0 ** -DISTANCE_DECIMALS)
        hit_query, hit_vector, hit_distance = [], [], []
        for start in range(0, len(left), _SCORE_ROWS):
            block = left_unit[start:start + _SCORE_ROWS]
            with np.errstate(invalid="ignore"):
                likeness = block @ right_unit.T
            # A vector without direction has no distance (NaN): last place, or out.
            np.copyto(likeness, np.float32(-np.inf), where=np.isnan(likeness))
            kept = min(int(limits[start:start + len(block)].max(initial=0)), likeness.shape[1])
            if kept == 0:
                continue
            worst = np.partition(likeness, likeness.shape[1] - kept, axis=1)[:, likeness.shape[1] - kept] - margin
            near = likeness >= worst[:, None]
            if not include_zero:
                near &= np.isfinite(likeness)
            query, vector = np.nonzero(near)
            value = np.full(len(query), np.inf)
            known = np.flatnonzero(np.isfinite(likeness[query, vector]))
            for some in np.array_split(known, len(known) // _PAIRS + 1):
                q, v = query[some] + start, vector[some]
                exact = np.einsum("ij,ij->i", left[q].astype(np.float64) / left_norm[q, None], right[v].astype(np.float64) / right_norm[v, None])
                value[some] = np.round(1.0 - exact, DISTANCE_DECIMALS) + 0.0
            # Ties are broken by id.
            order = np.lexsort((place_of[vector], value, query))
            query, vector, value = query[order], vector[order], value[order]
            first = np.searchsorted(query, np.arange(len(block)))
            place = np.arange(len(query)) - first[query]
            keep = place < limits[start + query]
            hit_query.append(query[keep] + start)
            hit_vector.append(vector[keep])
            hit_distance.append(value[keep])
        if not hit_query:
            return schema.empty_table()
        taken = queries.select(["query_id", "k"]).take(pa.array(np.concatenate(hit_query)))
        found = vectors.select(["chunk_id"]).take(pa.array(np.concatenate(hit_vector)))
        distance = np.concatenate(hit_distance)
        columns = {
            "query_id": taken["query_id"],
            "chunk_id": found["chunk_id"],
            "distance": pa.array(np.where(np.isinf(distance), np.nan, distance)),
            "k": taken["k"],
        }
        return pa.table([columns[field.name].cast(field.type) for field in schema], schema=schema)

    return score


def _limit_column(queries: DataFrame, k: int) -> Column:
    """Per-query ``k`` column when there is one, else the constant. Below 0 is 0."""
    limit = F.coalesce(F.col("k").cast("int"), F.lit(k)) if "k" in queries.columns else F.lit(k)
    return F.greatest(F.lit(0), limit)


def _best(hits: DataFrame, constant: int | None = None) -> DataFrame:
    """``constant``: a k that holds for all queries, which lets Spark cut each map partition before the shuffle."""
    best_first = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    ranked = hits.withColumn("rank", F.row_number().over(best_first))
    if constant is not None:
        ranked = ranked.filter(F.col("rank") <= constant)
    return ranked.filter(F.col("rank") <= F.col("k")).drop("k")


def _hit_type(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
        T.StructField("distance", T.DoubleType()),
        T.StructField("k", T.IntegerType()),
    ])


def _score_on_scan(queries: pa.Table, vectors: DataFrame, on: list[str], out: T.StructType, include_zero: bool) -> DataFrame:
    """k best of every query in every partition of ``vectors``, which are scanned where they are."""
    schema = to_arrow_schema(out)
    score = _cell_scorer(schema, include_zero)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(queries)

    def run(batches):
        asked: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*[shared.value[c].to_pylist() for c in on], strict=True)):
            asked.setdefault(key, []).append(i)
        own = {key: shared.value.take(pa.array(rows)) for key, rows in asked.items()}
        best: dict[tuple, pa.Table] = {}
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in on], strict=True)):
                if key in own:
                    rows.setdefault(key, []).append(i)
            for key, at in rows.items():
                found = score(own[key], pa.Table.from_batches([batch.take(pa.array(at))]))
                best[key] = _kept(pa.concat_tables([best[key], found])) if key in best else found
        for table in best.values():
            yield from table.to_batches()

    return vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", *on, "embedding").mapInArrow(run, out)


def _kept(hits: pa.Table) -> pa.Table:
    """The k best hits of each query."""
    # A distance that isn't a number is the last; null sorts after all.
    hits = hits.sort_by([("query_id", "ascending"), ("distance", "ascending"), ("chunk_id", "ascending")])
    query = hits["query_id"].combine_chunks()
    if isinstance(query, pa.ChunkedArray):
        query = pa.concat_arrays(query.chunks)
    codes = query.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.searchsorted(codes, np.arange(codes.max(initial=-1) + 1))
    place = np.arange(len(codes)) - first[codes]
    return hits.filter(pa.array(place < hits["k"].to_numpy()))


def _of_keys(vectors: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Vectors of the keys asked for: a filter the scan can use when they are few, else a semi-join."""
    few = keys.limit(FILTER_KEYS + 1).collect()
    if len(on) == 1 and len(few) <= FILTER_KEYS:
        return vectors.filter(F.col(on[0]).isin([r[0] for r in few if r[0] is not None]))
    return vectors.join(keys, on, "left_semi")


def _hot_keys(queries: DataFrame, vectors: DataFrame, on: list[str], cell_vectors: int,
              cell_queries: int) -> DataFrame:
    """Keys that need more than one cell, with the number of parts of either side."""
    def parts(rows: DataFrame, per_cell: int, name: str) -> DataFrame:
        return rows.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(per_cell)).cast("int").alias(name))

    both = parts(queries, cell_queries, "_q_parts").join(parts(vectors, cell_vectors, "_v_parts"), on)
    return both.filter((F.col("_q_parts") > 1) | (F.col("_v_parts") > 1))


def _score_in_cells(queries: DataFrame, vectors: DataFrame, on: list[str], include_zero: bool,
                    cell_vectors: int, cell_queries: int) -> DataFrame:
    hot = small_frame(_hot_keys(queries, vectors, on, cell_vectors, cell_queries))
    queries = queries.filter(F.col("vector").isNotNull())
    vectors = vectors.filter(F.col("embedding").isNotNull())
    cell = [*on, "_q", "_v"]

    def split(rows: DataFrame, identifier: str, own: str, own_parts: str, other: str, other_parts: str):
        if hot is None:
            return rows.withColumns({own: F.lit(0), other: F.lit(0)})
        sized = rows.join(hot, on, "left").na.fill(1, ["_q_parts", "_v_parts"])
        return sized.withColumn(own, F.pmod(F.xxhash64(identifier), F.col(own_parts)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)))

    left = split(queries, "query_id", "_q", "_q_parts", "_v", "_v_parts").select(*cell, "query_id", "vector", "k")
    right = split(vectors, "chunk_id", "_v", "_v_parts", "_q", "_q_parts").select(*cell, "chunk_id", "embedding")
    out = _hit_type(queries, vectors)
    return (
        left.groupBy(*cell).cogroup(right.groupBy(*cell))
        .applyInArrow(_cell_scorer(to_arrow_schema(out), include_zero), out)
    )


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = K.DEFAULT_LIMIT, *,
                on: tuple[str, ...] = ("owner",), include_zero: bool = False,
                cell_vectors: int = CELL_VECTORS, cell_queries: int = CELL_QUERIES,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact k nearest vectors of every query among the rows sharing its ``on`` key.

    ``queries``: query_id, *on, vector and optionally k, of any size. ``vectors``: chunk_id, *on, embedding.
    Returns query_id, chunk_id, distance, rank; ties are ordered by chunk_id. The queries are stored and
    measured first; up to ``broadcast_bytes`` of them go to the vectors, and only the keys they name are scanned.
    """
    keys = list(on)
    asked = stored(
        queries.withColumn("k", _limit_column(queries, k)).select("query_id", *keys, "vector", "k")
        .filter(F.col("vector").isNotNull()), "queries")
    constant = None if "k" in queries.columns else max(0, k)
    of_keys = _of_keys(vectors.select("chunk_id", *keys, "embedding"), asked.select(*keys).distinct(), keys)
    measured = asked.agg(F.sum(F.size("vector") * 8 + F.coalesce(F.length(F.col("query_id").cast("string")), F.lit(0)) + 64)).first()[0]
    if (measured or 0) <= broadcast_bytes:
        hits = _score_on_scan(asked.toArrow(), of_keys, keys, _hit_type(asked, vectors), include_zero)
    else:
        hits = _score_in_cells(asked, of_keys, keys, include_zero, cell_vectors, cell_queries)
    return _best(hits, constant)


def nearest(vectors: DataFrame, vector: list[float], k: int = K.DEFAULT_LIMIT, *,
            include_zero: bool = False) -> DataFrame:
    """k nearest rows to one literal vector: chunk_id, distance. Plans as TakeOrderedAndProject."""
    literal = F.lit([float(x) for x in vector])
    scored = (
        vectors.filter(F.col("embedding").isNotNull())
        .withColumn("distance", F.round(cosine_distance(F.col("embedding"), literal), DISTANCE_DECIMALS) + 0.0)
    )
    if not include_zero:
        scored = scored.filter(~F.isnan("distance"))
    return scored.orderBy("distance", "chunk_id").limit(k)


def hyperplanes(dimensions: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """(dimensions, tables * bits) of +1 and -1: the first hexadecimal digit of the md5 of 'seed|table|bit|dimension'
    is below 8 for +1, so that SQL can build the same planes."""
    def sign(*place):
        return 1.0 if hashlib.md5("|".join(map(str, place)).encode()).hexdigest()[0] < "8" else -1.0

    return np.array([[sign(seed, t, b, d) for t in range(tables) for b in range(bits)] for d in range(dimensions)])


def _signatures(dimensions: int, tables: int, bits: int, seed: int):
    @F.arrow_udf(T.ArrayType(T.LongType(), False))
    def signature(column: pa.Array) -> pa.Array:
        planes = hyperplanes(dimensions, tables, bits, seed)
        side = (_matrix(pa.chunked_array([column])) @ planes > 0) if len(column) else np.zeros((0, tables * bits))
        codes = side.reshape(len(column), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
        offsets = pa.array(np.arange(len(column) + 1, dtype=np.int32) * tables)
        return pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int64).ravel()))

    return signature


def approximate_topk(queries: DataFrame, vectors: DataFrame, k: int = K.DEFAULT_LIMIT, *,
                     dimensions: int, on: tuple[str, ...] = ("owner",), tables: int = 6, bits: int = 4,
                     seed: int = 17, include_zero: bool = False) -> DataFrame:
    """Approximate k nearest: a query meets the vectors of which a hyperplane signature is one of its own, or differs
    from it in one bit.

    Same columns as ``cosine_topk``; candidates are scored exactly, so every distance is right
    and only recall is approximate: no query gets fewer than k hits while its key has that many, as those
    with fewer candidates are searched exactly. More ``bits`` mean smaller cells, more ``tables`` better recall:
    let an owner's vectors be several thousand per 2**bits cells. Null vectors are left out; one of another
    length than ``dimensions`` is an error, as in ``cosine_topk``.
    """
    signature = _signatures(dimensions, tables, bits, seed)

    def hashed(rows: DataFrame, column: str) -> DataFrame:
        wrong = F.raise_error(F.concat(F.lit(f"vectors of {dimensions} dimensions are asked for, one has "), F.size(column).cast("string")))
        checked = F.when(has_dimensions(F.col(column), dimensions), F.col(column)).otherwise(wrong)
        kept = rows.filter(F.col(column).isNotNull()).withColumn(column, checked)
        return kept.select("*", F.posexplode(signature(column)).alias("_table", "_signature"))

    vectors = vectors.select("chunk_id", *on, "embedding")
    asked = stored(queries.withColumn("k", _limit_column(queries, k)).select("query_id", *on, "vector", "k"), "approximate-queries")
    near = F.array(F.col("_signature"), *[F.col("_signature").bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
    hits = _score_in_cells(
        hashed(asked, "vector").withColumn("_signature", F.explode(near)), hashed(vectors, "embedding"),
        [*on, "_table", "_signature"], include_zero, CELL_VECTORS, CELL_QUERIES,
    )
    best = stored(_best(hits.dropDuplicates(["query_id", "chunk_id"]), None if "k" in queries.columns else max(0, k)), "approximate-hits")
    found = best.groupBy("query_id").agg(F.count("*").alias("_found"))
    short = stored(asked.join(found, "query_id", "left").filter(F.coalesce("_found", F.lit(0)) < F.col("k")).drop("_found"), "short-queries")
    if short.limit(1).count() == 0:
        return best
    return best.join(short.select("query_id"), "query_id", "left_anti").unionByName(
        cosine_topk(short, vectors, k, on=on, include_zero=include_zero))
