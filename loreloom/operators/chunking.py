"""Chunk rows and their upkeep."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions.text import chunk_texts
from loreloom.operators.sizing import small_frame


def chunk_documents(documents: DataFrame, text: str = "raw_text", size: int | None = None,
                    overlap: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """document_id, *keep, chunk_index (0-based), content. No shuffle: one narrow stage."""
    return documents.select(
        F.col("id").alias("document_id"), *keep,
        F.posexplode(chunk_texts(F.col(text), size, overlap)).alias("chunk_index", "content"),
    )


def chunk_id(document_id, chunk_index):
    """Key of a chunk, derived from its natural key so that re-runs give the same id."""
    return F.concat_ws("-", document_id.cast("string"), chunk_index.cast("string"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def with_chunk_count(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunk_counts(chunks).withColumnRenamed("document_id", "id")
    return documents.join(counts, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def with_document(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds owner and document_title; chunks of unknown documents drop out."""
    parents = documents.select(
        F.col("id").alias("document_id"), "owner", F.col("title").alias("document_title")
    )
    return chunks.drop("owner", "document_title").join(parents, "document_id")


def replace_chunks(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks after ``documents`` (id) were reprocessed into ``new``; others keep theirs."""
    touched = small_frame(documents.select(F.col("id").alias("document_id")).distinct())
    kept = old if touched is None else old.join(touched, "document_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values occurring more than once; empty when the key is unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")
