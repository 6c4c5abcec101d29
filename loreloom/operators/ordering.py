"""The orders of the list views. Ids break every tie.

A list belongs to its owner: instead of sorting all owners' rows into one order, each row gets its 1-based
``position`` in its owner's list. Owners are numbered in buckets (days, first letters), so one with very many rows
is many tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.operators.sizing import exact_rank, id_range


def _days_back(at: str) -> Column:
    """Grows from newer to older; rows without a time come last."""
    return F.coalesce(-F.floor(F.unix_seconds(at) / 86_400), F.lit(2**62)).cast("bigint")


def _newest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    return exact_rank(rows, keys, _days_back(at), [F.desc(at), F.col("id")], "position",
                      F.struct(F.coalesce(-F.unix_micros(at), F.lit(2**62)), id_range(F.col("id"))))


def pinned_first(entries: DataFrame) -> DataFrame:
    unpinned = ~F.coalesce("is_pinned", F.lit(False))
    return exact_rank(entries, ["owner"], F.struct(unpinned.alias("a"), _days_back("updated_at").alias("b")),
                      [unpinned, F.desc("updated_at"), F.col("id")], "position",
                      F.struct(F.coalesce(-F.unix_micros("updated_at"), F.lit(2**62)), id_range(F.col("id"))))


def newest_first(documents: DataFrame) -> DataFrame:
    return _newest(documents, ["owner"], "created_at")


def by_activity(conversations: DataFrame) -> DataFrame:
    return _newest(conversations, ["owner"], "updated_at")


def chronological(messages: DataFrame, name: str = "position", bucket_seconds: int = 3600) -> DataFrame:
    """Positions of messages in their conversation, oldest first."""
    return exact_rank(messages, ["conversation_id"], F.floor(F.unix_seconds("created_at") / F.lit(bucket_seconds)),
                      [F.col("created_at"), F.col("id")], name, F.struct(F.unix_micros("created_at"), id_range(F.col("id"))))


def alphabetical(nodes: DataFrame) -> DataFrame:
    """Node ids are texts; very many nodes of one owner with one title would be one bucket, which types bound."""
    return exact_rank(nodes, ["owner"], F.substring("title", 1, 2), [F.col("title"), F.col("id")], "position", F.col("title"))


def in_document_order(chunks: DataFrame) -> DataFrame:
    """Positions of chunks in their document are their indices, from 1."""
    return chunks.withColumn("position", (F.col("chunk_index") + 1).cast("bigint"))


def newest_per(rows: DataFrame, keys: list[str], n: int, by: str = "updated_at", tie: str = "id",
               rank: str = "rank") -> DataFrame:
    """Newest ``n`` rows per key, with their rank. Spark keeps at most n rows per key and
    map partition before it shuffles, so a hot key stays small."""
    window = Window.partitionBy(*keys).orderBy(F.desc(by), tie)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
