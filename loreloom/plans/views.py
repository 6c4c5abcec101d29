"""List, search and roll-up views."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions import prompts
from loreloom.functions.text import day_of, enum_label, prefix, relationship_label
from loreloom.operators.chunking import with_chunk_count
from loreloom.operators.filters import facet_filter, keyword_filter, memory_filter, parse_tri_state
from loreloom.operators.generate import Generator, generate
from loreloom.operators.graph import edges_with_titles
from loreloom.operators.maintain import goal_progress
from loreloom.operators.ordering import alphabetical, newest_first, newest_per, pinned_first
from loreloom.operators.sizing import attach_pages, broadcast_if_bounded, exact_rank, id_range, ordered_list, page_of_rank
from loreloom.sources.tables import stored

DOCUMENT_LIST = [
    "id", "owner", "title", "file", "file_type", "source_url", "raw_text_preview", "processing_status",
    "processing_error", "extracted_at", "chunk_count", "created_at", "updated_at",
]
LINK_PAGE_ROWS = 1000


def list_documents(documents: DataFrame, chunks: DataFrame, ordered: bool = True) -> DataFrame:
    """With ``position`` in the owner's list, newest first, unless ``ordered`` is false."""
    listed = with_chunk_count(
        documents.withColumn("raw_text_preview", prefix(F.coalesce("raw_text", F.lit("")), K.PREVIEW_CHARS)), chunks
    ).select(*[c for c in DOCUMENT_LIST if c in documents.columns or c in ("raw_text_preview", "chunk_count")])
    return newest_first(listed) if ordered else listed


def search_memory(entries: DataFrame, query: str | None = "", category: str | None = "",
                  pinned: str | None = None, ordered: bool = True) -> DataFrame:
    """``pinned`` is the request text: true/1, false/0, anything else means both. ``position`` is the place among
    what the owner's search found, unless ``ordered`` is false."""
    found = memory_filter(entries, query, category, parse_tri_state(pinned))
    return pinned_first(found) if ordered else found


def graph_data(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their position by title, edges with both titles and a readable relationship)."""
    titled = edges_with_titles(edges, nodes).withColumn(
        "relationship_label", relationship_label(F.col("relationship_type"))
    )
    return alphabetical(nodes), titled


def dashboard_summary(owners: DataFrame, documents: DataFrame, chunks: DataFrame, memories: DataFrame,
                      tasks: DataFrame) -> DataFrame:
    """One row per owner (column id), with zeros where there is nothing.

    Every table is counted per owner on its own scan, then the small counts are added up.
    ``chunks`` may carry their owner; otherwise they are first counted per document.
    """
    def counters(rows: DataFrame, **counts: Column) -> DataFrame:
        names = ["documents", "completed_documents", "memories", "pending_tasks", "chunks"]
        grouped = rows.groupBy("owner").agg(*[c.alias(n) for n, c in counts.items()])
        return grouped.select("owner", *[F.col(n) if n in counts else F.lit(0).alias(n) for n in names])

    if "owner" in chunks.columns:
        chunk_counters = counters(chunks, chunks=F.count("*"))
    else:
        per_document = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
        owned = per_document.join(documents.select(F.col("id").alias("document_id"), "owner"), "document_id")
        chunk_counters = counters(owned, chunks=F.sum("n"))
    parts = [
        counters(documents, documents=F.count("*"),
                 completed_documents=F.count_if(F.col("processing_status") == "completed")),
        counters(memories, memories=F.count("*")),
        counters(tasks, pending_tasks=F.count_if(F.col("status") == "pending")),
        chunk_counters,
    ]
    stacked = owners.select(F.col("id").alias("owner"), *[F.lit(0).alias(n) for n in parts[0].columns[1:]])
    stacked = stacked.withColumn("_known", F.lit(1))
    for part in parts:
        stacked = stacked.unionByName(part.withColumn("_known", F.lit(0)))
    totals = stacked.groupBy("owner").agg(
        *[F.sum(n).alias(n) for n in parts[0].columns[1:]], F.max("_known").alias("_known")
    )
    return totals.filter("_known = 1").drop("_known")


def daily_digest(owners: DataFrame, documents: DataFrame, memories: DataFrame, model: Generator | None = None,
                 n: int = K.DIGEST_ITEMS) -> DataFrame:
    """Titles of each owner's n newest documents and memories, the prompt made of them, the summary."""
    def titles(rows: DataFrame, name: str) -> DataFrame:
        newest = newest_per(rows.select("id", "owner", "title", "updated_at"), ["owner"], n)
        listed = F.array_join(ordered_list(F.col("title"), F.col("rank")), ", ")
        return newest.groupBy("owner").agg(listed.alias(name))

    digest = (
        owners.select(F.col("id").alias("owner"))
        .join(titles(documents, "recent_documents"), "owner", "left")
        .join(titles(memories, "recent_memories"), "owner", "left")
        .na.fill("", ["recent_documents", "recent_memories"])
    )
    prompt = prompts.digest_prompt(F.col("recent_documents"), F.col("recent_memories"))
    return digest.withColumn("prompt", prompt).withColumn("summary", generate(F.col("prompt"), model))


def notes_view(notes: DataFrame, links: DataFrame, page_rows: int = LINK_PAGE_ROWS) -> DataFrame:
    """Notes with the ids of their related documents, in pages 0, 1, ... of ``page_rows`` ids in order."""
    numbered = exact_rank(links.select("note_id", "document_id").distinct(), ["note_id"], id_range(F.col("document_id")),
                          [F.col("document_id")], "seq")
    pages = (
        numbered.groupBy("note_id", page_of_rank(F.col("seq"), page_rows).alias("page"))
        .agg(ordered_list(F.col("document_id"), F.col("seq")).alias("related_documents"))
        .withColumnRenamed("note_id", "id")
    )
    return attach_pages(notes, pages, links.select(F.col("note_id").alias("id")), "related_documents")


def tasks_view(tasks: DataFrame) -> DataFrame:
    return tasks.withColumns({
        "status_label": enum_label(F.col("status"), K.TASK_STATUSES),
        "priority_label": enum_label(F.col("priority"), K.TASK_PRIORITIES),
        "due_day": day_of(F.col("due_date")),
    })


def goals_view(goals: DataFrame) -> DataFrame:
    return goals.withColumn("progress", goal_progress(F.col("progress"), F.col("is_completed")))


def _names(users: DataFrame, *fields: str) -> DataFrame:
    """Owners' names, stored and measured: when they are few, the big table isn't shuffled to get them."""
    return broadcast_if_bounded(stored(users.select(F.col("id").alias("owner"), *fields), "names"))


def search_documents_by_keyword(documents: DataFrame, chunks: DataFrame, users: DataFrame, query: str,
                                equal: dict | None = None, since=None, until=None) -> DataFrame:
    """Terms over title, owner name and URL, then facets; with chunk counts."""
    names = _names(users, "username")
    found = keyword_filter(documents.join(names, "owner"), query, ["title", "username", "source_url"])
    return with_chunk_count(facet_filter(found, equal, since, until), chunks)


def search_chunks_by_keyword(chunks: DataFrame, documents: DataFrame, query: str, since=None,
                             until=None) -> DataFrame:
    """Terms over the document title and the chunk text."""
    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    joined = facet_filter(chunks, None, since, until).join(titles, "document_id")
    return keyword_filter(joined, query, ["document_title", "content"])


def search_memory_by_keyword(entries: DataFrame, users: DataFrame, query: str,
                             equal: dict | None = None) -> DataFrame:
    """Terms over title, content, owner name and owner email."""
    names = _names(users, "username", "email")
    return keyword_filter(facet_filter(entries, equal).join(names, "owner"), query,
                          ["title", "content", "email", "username"])
