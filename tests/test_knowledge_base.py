import pytest
from pyspark.sql import functions as F

from loreloom.functions.embedding import HashingEmbedder
from loreloom.knowledge_base import KnowledgeBase
from loreloom.operators.generate import capitalised_phrases
from loreloom.operators.maintain import new_goals, new_memory_entries, new_notes, new_tasks
from loreloom.plans.chat import record_exchanges
from loreloom.plans.ingest import ingest, upsert_graph
from loreloom.sources.tables import append_table


@pytest.fixture(scope="module")
def kb(spark, as_of, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("kb") / "tables")
    base = KnowledgeBase.create(spark, root, embedder=HashingEmbedder(32))
    docs = spark.createDataFrame([
        (1, "ada", "Ada Notes", "note", "Ada Lovelace wrote about Engines"), (2, "grace", "Hers", "note", "secret text"),
        (3, "ada", "Blank", "note", " "),
    ], "id bigint, owner string, title string, file_type string, raw_text string") \
        .withColumns({"created_at": as_of, "updated_at": as_of})
    result = ingest(docs, as_of, base.embedder, capitalised_phrases)
    graph = upsert_graph(result.payloads, as_of)
    one = spark.createDataFrame([(1, "t", "c")], "id bigint, title string, content string")
    written = {
        "documents": result.documents, "document_chunks": result.chunks, "nodes": graph.nodes,
        "node_documents": graph.links.withColumn("owner", F.lit("ada")), "edges": graph.edges,
        "memory_entries": new_memory_entries(one, F.lit("ada"), as_of), "tasks": new_tasks(one, F.lit("ada"), as_of),
        "goals": new_goals(one, F.lit("ada"), as_of), "notes": new_notes(one, F.lit("ada"), as_of)[0],
        "note_documents": spark.createDataFrame([(1, 3, "ada")], "note_id bigint, document_id bigint, owner string"),
        "conversations": spark.createDataFrame([(5, "ada", "Talk")], "id bigint, owner string, title string"),
    }
    for name, rows in written.items():
        append_table(rows, root, name)
    return base


def test_documents_and_search(kb):
    assert {(r.id, r.processing_status, r.chunk_count) for r in kb.documents("ada").collect()} == {
        (1, "completed", 1), (3, "failed", 0)}
    assert kb.document("ada", 1).count() == 1 and kb.document("ada", 2).count() == 0
    assert [r.document_title for r in kb.search("ada", "wrote engines", 2).collect()] == ["Ada Notes"]
    assert [r.document_id for r in kb.search_documents("grace", "text", 99).collect()] == [2]
    assert kb.search_documents("ada", "  ").count() == 0
    for bad in (("", 5), ("x", 0), ("x", 21)):
        with pytest.raises(ValueError):
            kb.search("ada", *bad)


def test_chat_round_trip(kb, spark, as_of):
    asks = spark.createDataFrame([(1, "ada", 5, "Who wrote about Engines"), (2, "grace", 5, "not mine")],
                                 "exchange_id bigint, owner string, conversation_id bigint, message string")
    answered = kb.answer(asks).withColumns({"user_message_id": F.lit(1), "assistant_message_id": F.lit(2)})
    assert {(r.exchange_id, r.status, r.answer is None) for r in answered.collect()} == {(1, "existing", False), (2, "not_found", True)}
    row, = answered.filter("status = 'existing'").collect()
    assert row.exchange_id == 1 and "[S1] Ada Notes" in row.answer
    after = record_exchanges(answered, kb.table("conversations"), kb.table("messages"), kb.table("message_chunks"), as_of)
    assert [r.exchange_id for r in after.refused.collect()] == [2]
    append_table(after.messages, kb.root, "messages")
    append_table(after.message_chunks, kb.root, "message_chunks")
    talk, = kb.conversation("ada", 5).collect()
    assert [(m.role, [s.document_title for s in m.sources]) for m in talk.messages] == [
        ("user", []), ("assistant", ["Ada Notes"])]
    assert kb.conversation("grace", 5).count() == 0
    assert [r.id for r in kb.conversations("ada").collect()] == [5]


def test_other_views(kb):
    nodes, edges = kb.graph("ada")
    assert [r.title for r in nodes.collect()] == ["Ada Lovelace", "Engines"]
    assert [(r.source_title, r.target_title) for r in edges.collect()] == [("Ada Lovelace", "Engines")]
    node = nodes.first()
    assert [d.title for d in kb.node("ada", node.id).first().source_documents] == ["Ada Notes"]
    assert kb.node("grace", node.id).count() == 0
    assert [r.id for r in kb.memories("ada", "T").collect()] == [1] and kb.memory("grace", 1).count() == 0
    row = kb.dashboard("ada").first()
    assert (row.documents, row.completed_documents, row.memories, row.pending_tasks, row.chunks) == (2, 1, 1, 1, 1)
    assert kb.digest("ada").first().recent_memories == "t"
    assert kb.notes("ada").first().related_documents == [3]
    assert kb.tasks("ada").first().status_label == "Pending" and kb.goals("ada").first().progress == 0
    plan = kb.table("documents", "ada")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(owner" in plan


def test_writes(spark, as_of, tmp_path):
    kb = KnowledgeBase.create(spark, str(tmp_path / "kb"), embedder=HashingEmbedder(32))
    make = spark.createDataFrame
    columns = "title string, file_type string, file_name string, file_size long, raw_text string, source_url string, content binary"
    for owner in ("a/b é", "eve"):
        refused = kb.upload(owner, make([("Good", "note", None, None, "Ada Lovelace wrote about Engines", None, None),
                                         ("Bad", "note", None, None, " ", None, None)], columns), as_of)
        assert [r.title for r in refused.collect()] == ["Bad"]
    me, eve = "a/b é", "eve"
    doc, = kb.documents(me).collect()
    assert (doc.title, doc.processing_status, doc.chunk_count) == ("Good", "completed", 1)
    assert [r.title for r in kb.graph(me)[0].collect()] == ["Ada Lovelace", "Engines"]
    assert [r.document_id for r in kb.search(me, "engines").collect()] == [doc.id]

    said = kb.chat(me, "Who wrote about Engines", as_of=as_of).first()
    again = kb.chat(me, "And who else", said.conversation_id, as_of).first()
    assert again.conversation_id == said.conversation_id and "[S1] Good" in said.answer
    assert kb.chat(eve, "mine?", said.conversation_id, as_of).first().error == "Conversation not found."
    assert kb.chat(eve, "  ", None, as_of).first().error
    talk, = kb.conversation(me, said.conversation_id).collect()
    assert [m.role for m in talk.messages] == ["user", "assistant"] * 2 and kb.conversations(eve).count() == 0

    task, = kb.add(me, "tasks", make([("t",)], "title string"), as_of).collect()
    kb.toggle_task(me, task.id, as_of)
    assert [r.status for r in kb.tasks(me).collect()] == ["completed"]
    entry, = kb.add(me, "memory_entries", make([("m", "c")], "title string, content string"), as_of).collect()
    kb.patch(me, "memory_entries", make([(entry.id, ["title"], "new")], "id long, fields array<string>, title string"), as_of)
    assert [(r.title, r.content) for r in kb.memories(me).collect()] == [("new", "c")]
    goal, = kb.add(eve, "goals", make([("g",)], "title string"), as_of).collect()
    note, = kb.add(me, "notes", make([("n", "text")], "title string, content string"), as_of).collect()
    with pytest.raises(ValueError):
        kb.add(me, "notes", make([("n", "")], "title string, content string"), as_of)
    kb.relate(me, note.id, [doc.id, 5, kb.documents(eve).first().id])
    assert kb.notes(me).first().related_documents == [doc.id]
    kb.reprocess(me, [doc.id], as_of)
    assert kb.documents(me).first().chunk_count == 1 and kb.table("document_chunks", me).count() == 1
    kb.delete(me, "documents", [doc.id])
    assert kb.documents(me).count() == 0 and kb.notes(me).first().related_documents == [] and kb.table("document_chunks", me).count() == 0
    assert kb.documents(eve).count() == 1 and kb.goals(eve).first().id == goal.id
    kb.delete(me, "conversations", [said.conversation_id])
    assert kb.table("messages", me).count() == 0 and kb.table("message_chunks", me).count() == 0
    kb.delete(eve, "goals", [goal.id])
    assert kb.goals(eve).count() == 0 and kb.tasks(me).count() == 1
