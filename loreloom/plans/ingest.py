"""Documents to text, chunks, vectors and graph payloads."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.embedding import Embedder, HashingEmbedder
from loreloom.functions.text import prefix
from loreloom.operators import graph
from loreloom.operators.chunking import chunk_documents, chunk_id, replace_chunks
from loreloom.operators.generate import capitalised_phrases
from loreloom.operators.validation import ERROR, document_error, split_valid
from loreloom.sources.extraction import extract_text
from loreloom.sources.tables import stored


@dataclass
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    payloads: DataFrame


def process_documents(documents: DataFrame, as_of: Column, decoders: dict | None = None) -> DataFrame:
    """Document rows after processing: text, status, error and time stamps.

    A failed document keeps its raw_text, extracted_at and chunks of earlier runs.
    """
    found = extract_text(documents, decoders)
    # A normalised text without words cannot exist, so no text means no chunks.
    error = F.coalesce(F.col("error"), F.when(F.col("text").isNull(), K.NO_CHUNKS))
    failed = error.isNotNull()

    def on_success(new: Column, column: str, kind: str) -> Column:
        old = F.col(column) if column in found.columns else F.lit(None).cast(kind)
        return F.when(failed, old).otherwise(new)

    return found.withColumns({
        "raw_text": on_success(F.col("text"), "raw_text", "string"),
        "extracted_at": on_success(as_of, "extracted_at", "timestamp"),
        "source_checksum": on_success(F.sha2(F.col("text"), 256), "source_checksum", "string"),
        "processing_status": F.when(failed, "failed").otherwise("completed"),
        "processing_error": F.when(failed, prefix(error, K.ERROR_CHARS)).otherwise(""),
        "updated_at": as_of,
    }).drop("text", "error")


def stored_processing(documents: DataFrame, as_of: Column, decoders: dict | None = None) -> DataFrame:
    """``process_documents``, computed once and stored without the files' bytes."""
    return stored(process_documents(documents, as_of, decoders).drop("content"), "processed")


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    return chunks.withColumn("embedding", (embedder or HashingEmbedder()).embed(F.col("content")))


def ingest(documents: DataFrame, as_of: Column, embedder: Embedder | None = None,
           extractor: Callable[[Column], Column] | None = capitalised_phrases, decoders: dict | None = None,
           size: int | None = None, overlap: int | None = None, processed: bool = False) -> Ingested:
    """Process documents and derive their chunks, vectors and graph payloads.

    All three results are narrow over the input: no shuffle until a caller writes or merges them. ``extractor=None``
    leaves the payloads empty. ``processed``: the documents went through ``stored_processing``, so that files are
    decoded once for all three.
    """
    done = documents if processed else process_documents(documents, as_of, decoders)
    good = done.filter(F.col("processing_status") == "completed")
    chunks = embed_chunks(
        chunk_documents(good, "raw_text", size, overlap, keep=("owner",))
        .withColumns({"id": chunk_id(F.col("document_id"), F.col("chunk_index")), "created_at": as_of}),
        embedder,
    )
    if extractor is None:
        payload = F.lit('{"nodes":[],"edges":[]}')
    else:
        payload = extractor(F.col("raw_text"))
    payloads = good.select(F.col("id").alias("document_id"), "owner", payload.alias("payload"))
    return Ingested(done.drop("content"), chunks, payloads)


@dataclass
class Accepted:
    """What an upload batch leads to; ``refused`` rows have an ``error`` and went no further."""

    refused: DataFrame
    ingested: Ingested
    graph: "Graph"


def ingest_uploads(uploads: DataFrame, as_of: Column, nodes: DataFrame | None = None, links: DataFrame | None = None,
                   edges: DataFrame | None = None, allowed: tuple[str, ...] = K.UPLOAD_TYPES, strict: bool = False,
                   embedder: Embedder | None = None, extractor: Callable[[Column], Column] | None = capitalised_phrases,
                   decoders: dict | None = None, size: int | None = None, overlap: int | None = None,
                   checked: bool = True) -> Accepted:
    """The whole chain for uploads: validate, process, chunk, embed, and merge what was extracted into the graph.

    Files are decoded once and models are asked once: processed rows and payloads are stored in between. ``checked``
    is false for rows that passed before and are processed again."""
    error = document_error(F.col("file_type"), F.col("file_name"), F.col("file_size"), F.col("raw_text"), F.col("source_url"), allowed)
    good, refused = split_valid(uploads, error if checked else F.lit(None).cast(ERROR))
    done = stored_processing(good, as_of, decoders)
    result = ingest(done, as_of, embedder, extractor, None, size, overlap, processed=True)
    return Accepted(refused, result, upsert_graph(result.payloads, as_of, nodes, links, edges, strict))


@dataclass
class Graph:
    nodes: DataFrame
    links: DataFrame
    edges: DataFrame


def upsert_graph(payloads: DataFrame, as_of: Column, nodes: DataFrame | None = None, links: DataFrame | None = None,
                 edges: DataFrame | None = None, strict: bool = False) -> Graph:
    """Graph tables after the payloads. Payloads are parsed and stored first: a model is asked once per
    document, and the three tables read the same reply, each its nested columns only. The node table is stored too: its
    readers, links, titles of edges and positions, need not upsert it again; so are the first mentions that nodes and edges
    both start from."""
    payloads = stored(graph.parsed(payloads), "payloads", "zstd")
    first = stored(graph.first_nodes(payloads, strict), "first-nodes", "zstd")
    after = stored(graph.upsert_nodes(payloads, as_of, nodes, strict, first), "graph-nodes", "zstd")
    once = nodes is None and links is None and not strict and graph.each_once(payloads)
    return Graph(
        after,
        graph.link_nodes(payloads, links, strict, None if nodes is None else after, once=once),
        graph.upsert_edges(payloads, as_of, nodes, edges, strict, first),
    )


def reprocess(old_chunks: DataFrame, documents: DataFrame, as_of: Column, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after reprocessing ``documents``; failures leave old chunks in place."""
    result = ingest(documents, as_of, extractor=None, **options)
    good = result.documents.filter(F.col("processing_status") == "completed")
    return result.documents, replace_chunks(old_chunks, result.chunks, good)
