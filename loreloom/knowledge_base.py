"""One owner's view of stored tables: every request a user can make, as a filtered batch query.

Every table but ``users`` has a folder for each owner, and a request reads and writes its owner's folders only.
"""

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.embedding import Embedder
from loreloom.operators.chunking import replace_chunks
from loreloom.operators.filters import owned_by, owned_row
from loreloom.operators.generate import Generator
from loreloom.operators.graph import node_detail
from loreloom.operators.maintain import (
    FOREIGN_KEYS, cascade_delete, new_goals, new_memory_entries, new_notes, new_tasks, partial_update, replace_links, toggled_status,
)
from loreloom.plans import chat, views
from loreloom.plans.ingest import ingest_uploads
from loreloom.plans.search import embed_queries, search_chunks, semantic_search
from loreloom.schemas import TABLES
from loreloom.sources.tables import append_table, conform, read_table, replace_owner, stored, with_new_ids


OWNERS_IN_A_FILTER = 1000


def _now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def _dependents(name: str) -> list[str]:
    """A table and all that its foreign keys reach."""
    found = [name]
    for parent in found:
        found += [child for child, _ in FOREIGN_KEYS.get(parent, []) if child not in found]
    return found


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None,
                 model: Generator | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.embedder = embedder
        self.model = model

    @classmethod
    def create(cls, spark: SparkSession, root: str, **options) -> "KnowledgeBase":
        """Lay down empty tables below ``root``."""
        for name, schema in TABLES.items():
            writer = spark.createDataFrame([], schema).write.mode("errorifexists")
            (writer.partitionBy("owner") if "owner" in schema.names else writer).parquet(f"{root.rstrip('/')}/{name}")
        return cls(spark, root, **options)

    def table(self, name: str, owner: str | None = None) -> DataFrame:
        rows = read_table(self.spark, self.root, name)
        return rows if owner is None else owned_by(rows, owner)

    # Documents and search.

    def documents(self, owner: str) -> DataFrame:
        return views.list_documents(self.table("documents", owner), self.table("document_chunks", owner)) \
            .orderBy("position")

    def document(self, owner: str, document_id: int) -> DataFrame:
        return owned_row(self.documents(owner), owner, document_id)

    def _question(self, owner: str, text: str | None, limit: int) -> DataFrame:
        if limit < 0:
            raise ValueError("limit must not be negative")
        row = [("q", owner, text, min(limit, K.MAX_LIMIT))]
        asked = self.spark.createDataFrame(row, "query_id string, owner string, query string, k int")
        return embed_queries(asked, self.embedder)

    def search_documents(self, owner: str, text: str | None, limit: int = K.DEFAULT_LIMIT) -> DataFrame:
        """Nearest chunks with ``distance``; a blank text finds nothing."""
        hits = search_chunks(self._question(owner, text, limit), self.table("document_chunks", owner),
                             self.table("documents", owner))
        return hits.drop("query_id").orderBy("rank")

    def search(self, owner: str, text: str, limit: int = K.DEFAULT_LIMIT) -> DataFrame:
        """Nearest chunks with ``similarity_score``."""
        if not (text or "").strip() or not 1 <= limit <= K.MAX_LIMIT:
            raise ValueError(f"a query and a limit of 1 to {K.MAX_LIMIT} are needed")
        hits = semantic_search(self._question(owner, text, limit), self.table("document_chunks", owner),
                               self.table("documents", owner))
        return hits.drop("query_id").orderBy("rank")

    # Chat.

    def conversations(self, owner: str) -> DataFrame:
        return chat.list_conversations(self.table("conversations", owner)).orderBy("position")

    def conversation(self, owner: str, conversation_id: int) -> DataFrame:
        talk = owned_row(self.table("conversations"), owner, conversation_id)
        said = self.table("messages", owner).filter(F.col("conversation_id") == conversation_id)
        said = said.join(talk.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
        sources = chat.message_sources(said, self.table("message_chunks", owner), self.table("document_chunks", owner),
                                       self.table("documents", owner))
        return chat.conversation_detail(talk, said, sources).orderBy("page")

    def answer(self, exchanges: DataFrame) -> DataFrame:
        """Answers to exchanges (exchange_id, owner, conversation_id, message), without storing them.

        Those naming a conversation that is not their owner's come back with ``status`` not_found and no answer."""
        resolved = stored(chat.resolve_conversations(exchanges, self.table("conversations")), "resolved")
        owners = [r[0] for r in resolved.select("owner").distinct().limit(OWNERS_IN_A_FILTER + 1).collect()]
        tables = {name: self.table(name) for name in ("messages", "document_chunks", "documents")}
        if len(owners) <= OWNERS_IN_A_FILTER:  # names the folders to read
            tables = {name: rows.filter(F.col("owner").isin(owners)) for name, rows in tables.items()}
        asked = resolved.filter(F.col("status") != "not_found")
        answered = chat.answer(chat.chat_context(asked, tables["messages"], tables["document_chunks"], tables["documents"], self.embedder),
                               self.model)
        return answered.unionByName(resolved.filter(F.col("status") == "not_found"), allowMissingColumns=True)

    def chat(self, owner: str, message: str, conversation_id: int | None = None, as_of: Column | None = None) -> DataFrame:
        """Ask, answer and store: one row with conversation_id and answer, or with ``error``."""
        asked = self.spark.createDataFrame([(1, owner, conversation_id, message)],
                                           "exchange_id long, owner string, conversation_id long, message string")
        own = {name: self.table(name, owner) for name in (
            "conversations", "messages", "message_chunks", "document_chunks", "documents", "memory_entries")}
        done = chat.chat_requests(asked, *own.values(), _now(as_of), self.model, self.embedder, self._new_ids())
        said = stored(done.recorded.exchanges.select("conversation_id", "answer").unionByName(
            done.refused.select("conversation_id", F.col("error.message").alias("error")), allowMissingColumns=True), "said")
        if said.filter("error IS NULL").limit(1).count():
            replace_owner({"conversations": done.recorded.conversations, "messages": done.recorded.messages,
                           "message_chunks": done.recorded.message_chunks,
                           "memory_entries": own["memory_entries"].unionByName(done.memories, allowMissingColumns=True)}, self.root, owner)
        return said

    # What a user writes.

    def _new_ids(self) -> DataFrame:
        """An id that all new ones are to follow: made of the time, so that no other owner's rows have to be looked
        at."""
        start = time.time_ns() // 1000 << 12
        return self.spark.range(start, start + 1)

    def add(self, owner: str, name: str, rows: DataFrame, as_of: Column | None = None) -> DataFrame:
        """New rows of ``memory_entries``, ``tasks``, ``goals`` or ``notes``; returns them with their ids. Notes the
        form refuses raise."""
        stamp, ids = _now(as_of), self._new_ids()
        if name == "notes":
            new, refused = new_notes(rows, F.lit(owner), stamp, ids)
            if refused.limit(1).count():
                raise ValueError("a note needs a title and a content")
        else:
            new = {"memory_entries": new_memory_entries, "tasks": new_tasks, "goals": new_goals}[name](
                rows, F.lit(owner), stamp, existing=ids)
        new = stored(conform(new, TABLES[name]), f"new-{name}")
        append_table(new, self.root, name)
        return new

    def patch(self, owner: str, name: str, patches: DataFrame, as_of: Column | None = None) -> None:
        """Apply ``patches`` (id, fields, the new values) to the owner's rows of a table."""
        rows = self.table(name, owner)
        columns = [c for c in patches.columns if c in rows.columns and c not in ("id", "owner")]
        replace_owner({name: partial_update(rows, patches.withColumn("owner", F.lit(owner)), columns, _now(as_of))}, self.root, owner)

    def toggle_task(self, owner: str, task_id: int, as_of: Column | None = None) -> None:
        rows, chosen = self.table("tasks", owner), F.col("id") == task_id
        replace_owner({"tasks": rows.withColumns({
            "status": F.when(chosen, toggled_status(F.col("status"))).otherwise(F.col("status")),
            "updated_at": F.when(chosen, _now(as_of)).otherwise(F.col("updated_at"))})}, self.root, owner)

    def relate(self, owner: str, note_id: int, document_ids: list[int]) -> None:
        """A note's related documents become these; documents of others are left out."""
        given = self.spark.createDataFrame([(note_id, d) for d in document_ids], "note_id long, document_id long")
        own = self.table("documents", owner).select(F.col("id").alias("document_id"))
        mine = owned_row(self.table("notes"), owner, note_id).select(F.col("id").alias("note_id"))
        new = given.join(own, "document_id", "left_semi").join(mine, "note_id", "left_semi").distinct()
        links = self.table("note_documents", owner)
        replace_owner({"note_documents": replace_links(links, conform(new, TABLES["note_documents"]), mine, "note_id")}, self.root, owner)

    def delete(self, owner: str, name: str, ids: list) -> None:
        """Delete the owner's rows with these ids and all that depends on them."""
        names = _dependents(name)
        tables = {n: self.table(n, owner) for n in names}
        wanted = tables[name].select("id").filter(F.col("id").isin(list(ids)))
        replace_owner(cascade_delete(tables, name, stored(wanted, "deleted")), self.root, owner)

    def upload(self, owner: str, uploads: DataFrame, as_of: Column | None = None, **options) -> DataFrame:
        """Validate, process and store uploads (title, file_type, file_name, file_size, raw_text, source_url,
        content); returns the refused rows with their ``error``."""
        stamp = _now(as_of)
        rows = with_new_ids(uploads.withColumns({"owner": F.lit(owner), "created_at": stamp, "updated_at": stamp}), self._new_ids())
        return self._ingest(owner, rows, stamp, options)

    def reprocess(self, owner: str, document_ids: list[int], as_of: Column | None = None, **options) -> DataFrame:
        """Process stored documents again; failures keep their chunks."""
        rows = self.table("documents", owner).filter(F.col("id").isin(list(document_ids))).withColumns({
            "file_name": F.col("file"), "file_size": F.lit(None).cast("long")})
        return self._ingest(owner, rows, _now(as_of), options, checked=False)

    def _ingest(self, owner: str, rows: DataFrame, stamp: Column, options: dict, checked: bool = True) -> DataFrame:
        own = {name: self.table(name, owner) for name in ("documents", "document_chunks", "nodes", "node_documents", "edges")}
        done = ingest_uploads(rows, stamp, own["nodes"], own["node_documents"], own["edges"], embedder=self.embedder, checked=checked, **options)
        documents = done.ingested.documents
        ids = documents.select("id")
        good = documents.filter(F.col("processing_status") == "completed")
        replace_owner({
            "documents": own["documents"].join(ids, "id", "left_anti").unionByName(conform(documents, TABLES["documents"])),
            "document_chunks": replace_chunks(own["document_chunks"], conform(done.ingested.chunks, TABLES["document_chunks"]), good),
            "nodes": done.graph.nodes, "node_documents": done.graph.links, "edges": done.graph.edges,
        }, self.root, owner)
        return done.refused

    # Memory.

    def memories(self, owner: str, query: str = "", category: str = "", pinned: str | None = None) -> DataFrame:
        return views.search_memory(self.table("memory_entries", owner), query, category, pinned).orderBy("position")

    def memory(self, owner: str, entry_id: int) -> DataFrame:
        return owned_row(self.table("memory_entries"), owner, entry_id)

    # Graph.

    def graph(self, owner: str) -> tuple[DataFrame, DataFrame]:
        nodes, edges = views.graph_data(self.table("nodes", owner), self.table("edges", owner))
        return nodes.orderBy("position"), edges

    def node(self, owner: str, node_id: str) -> DataFrame:
        links = self.table("node_documents", owner).filter(F.col("node_id") == node_id)
        return node_detail(owned_row(self.table("nodes"), owner, node_id), links, self.table("documents", owner))

    # Roll-ups and productivity.

    def _owner_row(self, owner: str) -> DataFrame:
        return self.spark.createDataFrame([(owner,)], "id string")

    def dashboard(self, owner: str) -> DataFrame:
        return views.dashboard_summary(
            self._owner_row(owner), self.table("documents", owner), self.table("document_chunks", owner),
            self.table("memory_entries", owner), self.table("tasks", owner))

    def digest(self, owner: str) -> DataFrame:
        return views.daily_digest(self._owner_row(owner), self.table("documents", owner),
                                  self.table("memory_entries", owner), self.model)

    def notes(self, owner: str) -> DataFrame:
        return views.notes_view(self.table("notes", owner), self.table("note_documents", owner))

    def tasks(self, owner: str) -> DataFrame:
        return views.tasks_view(self.table("tasks", owner))

    def goals(self, owner: str) -> DataFrame:
        return views.goals_view(self.table("goals", owner))
