"""Chunk search for batches of queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.embedding import Embedder, HashingEmbedder
from loreloom.functions.text import is_blank, strip
from loreloom.functions.vectors import similarity_from_distance
from loreloom.operators.chunking import with_document
from loreloom.operators.sizing import broadcast_if_bounded
from loreloom.operators.topk import approximate_topk, cosine_topk
from loreloom.operators.validation import search_error, search_limit, search_query, whole_number
from loreloom.sources.tables import stored

# About 50 bytes each.
HIT_BROADCAST_ROWS = 1_000_000


def embed_queries(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """query_id, owner, query text -> the same with ``vector``; blank queries find nothing."""
    asked = queries.filter(~is_blank(F.col("query"))).withColumn("query", strip(F.col("query")))
    return asked.withColumn("vector", (embedder or HashingEmbedder()).embed(F.col("query")))


def with_owner(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks written by ``ingest`` carry their owner; others get it from their document."""
    if "owner" in chunks.columns:
        return chunks
    owners = documents.select(F.col("id").alias("document_id"), "owner")
    return chunks.join(owners, "document_id")


def search_chunks(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = K.DEFAULT_LIMIT,
                  *, approximate: dict | None = None, include_zero: bool = False) -> DataFrame:
    """k nearest chunks of the query's owner, with raw cosine ``distance``.

    ``queries``: query_id, owner, vector, optionally k. Only ids and vectors are scored. The
    winners are stored, so that their number is known when text and titles are joined to them: a
    few are broadcast to the chunk scan, and chunk text is shuffled only for very many.
    """
    owned = with_owner(chunks.select(*[c for c in ("id", "document_id", "owner", "embedding")
                                       if c in chunks.columns]), documents)
    vectors = owned.select(F.col("id").alias("chunk_id"), "owner", "embedding")
    if approximate:
        hits = approximate_topk(queries, vectors, k, include_zero=include_zero, **approximate)
    else:
        hits = cosine_topk(queries, vectors, k, include_zero=include_zero)
    hits = broadcast_if_bounded(stored(hits, "hits"), HIT_BROADCAST_ROWS)
    texts = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "content")
    return with_document(texts.join(hits, "chunk_id"), documents).select(
        "query_id", "owner", "rank", "document_id", "document_title", "chunk_id", "chunk_index",
        "content", "distance",
    )


def semantic_search(queries: DataFrame, chunks: DataFrame, documents: DataFrame,
                    k: int = K.DEFAULT_LIMIT, **options) -> DataFrame:
    """The same hits with ``similarity_score`` in [0, 1] instead of the distance."""
    return search_chunks(queries, chunks, documents, k, **options).withColumn(
        "similarity_score", similarity_from_distance(F.col("distance"))
    ).drop("distance")


def search_requests(requests: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries ready for ``semantic_search``, refused requests with ``error``).

    ``requests``: query_id, owner and the text columns body_query, body_q, url_query, url_q,
    body_limit, url_limit.
    """
    resolved = requests.select(
        "query_id", "owner",
        search_query(F.col("body_query"), F.col("body_q"), F.col("url_query"), F.col("url_q")).alias("query"),
        search_limit(F.col("body_limit"), F.col("url_limit")).alias("_limit"),
    ).withColumn("error", search_error(F.col("query"), F.col("_limit")))
    good = resolved.filter(F.col("error").isNull()).withColumn("k", F.least(whole_number(F.col("_limit")), F.lit(K.MAX_LIMIT)))
    return (
        embed_queries(good.drop("error", "_limit"), embedder),
        resolved.filter(F.col("error").isNotNull()).drop("_limit"),
    )
