from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from loreloom.operators import filters, maintain, ordering, sizing, validation
from loreloom.plans import views

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)
MEMORY = "id bigint, owner string, title string, content string, category string, tags array<string>, is_pinned boolean, updated_at timestamp"


def at(day):
    return datetime(2025, 1, day, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def memory(spark):
    return spark.createDataFrame([
        (1, "ada", "Postgres tips", "use 100% of it", "note", ["db"], False, at(1)),
        (2, "ada", "Other", "about POSTGRES", "fact", ["x_y"], True, at(2)),
        (3, "ada", "Third", "plain", "fact", ["My-Postgres"], False, at(3)),
        (4, "grace", "Postgres", "hers", "note", None, False, at(4)),
        (5, "ada", "Null tags", "none", "note", None, True, at(2)),
    ], MEMORY)


def ids(rows):
    return [r.id for r in rows.collect()]


@pytest.mark.parametrize("query,category,pinned,expected", [
    ("", "", None, [2, 5, 4, 3, 1]), (" postgres ", "", None, [2, 4, 3, 1]), ("postgres", "fact", None, [2, 3]),
    ("%", "", None, [1]), ("_", "", None, [2]), ("  ", "note", "yes", [5, 4, 1]), (None, None, "true", [2, 5]),
    ("", "", "1", [2, 5]), ("", "", "false", [4, 3, 1]), ("", "", "0", [4, 3, 1]), ("POSTGRES", "", "0", [4, 3, 1]),
])
def test_memory_search(memory, query, category, pinned, expected):
    found = views.search_memory(memory, query, category, pinned).collect()
    assert sorted(r.id for r in found) == sorted(expected)
    for owner in {r.owner for r in found}:
        own = sorted((r.position, r.id) for r in found if r.owner == owner)
        assert own == list(enumerate((i for i in expected if i in {x for _, x in own}), 1))


def test_scope_and_lookup(memory):
    assert sorted(ids(filters.owned_by(memory, "ada"))) == [1, 2, 3, 5]
    assert ids(filters.owned_row(memory, "ada", 2)) == [2]
    assert ids(filters.owned_row(memory, "grace", 2)) == []
    assert ids(filters.with_status(memory, "fact", "category").orderBy("id")) == [2, 3]


def test_tri_state_column(spark):
    rows = spark.createDataFrame([("true",), ("1",), ("false",), ("0",), ("yes",), (None,)], "p string")
    assert [r[0] for r in rows.select(filters.tri_state(F.col("p"))).collect()] == [True, True, False, False, None, None]


def test_keyword_and_facets(spark, memory):
    users = spark.createDataFrame([("ada", "Ada", "ada@example.com"), ("grace", "Grace", "g@x.org")],
                                  "id string, username string, email string")
    assert sorted(ids(views.search_memory_by_keyword(memory, users, "postgres EXAMPLE"))) == [1, 2]
    assert sorted(ids(views.search_memory_by_keyword(memory, users, "", {"category": "note"}))) == [1, 4, 5]
    docs = spark.createDataFrame([(1, "ada", "One", "http://a", "note", at(1)), (2, "ada", "Two", None, "pdf", at(5))],
                                 "id bigint, owner string, title string, source_url string, file_type string, created_at timestamp")
    chunks = spark.createDataFrame([(1, 0, "hello world", at(1))],
                                   "document_id bigint, chunk_index int, content string, created_at timestamp")
    found = views.search_documents_by_keyword(docs, chunks, users, "ada")
    assert {r.id: r.chunk_count for r in found.collect()} == {1: 1, 2: 0}
    assert ids(views.search_documents_by_keyword(docs, chunks, users, "a http")) == [1]
    assert ids(views.search_documents_by_keyword(docs, chunks, users, "", {"file_type": "pdf"}, since=at(2), until=at(9))) == [2]
    assert views.search_chunks_by_keyword(chunks, docs, "ONE world").count() == 1
    counts = {(r.facet, r.value): r.row_count for r in filters.facet_counts(memory, ["category", "is_pinned"]).collect()}
    assert counts == {("category", "note"): 3, ("category", "fact"): 2, ("is_pinned", "true"): 2, ("is_pinned", "false"): 3}


def test_orders(spark):
    rows = spark.createDataFrame([(2, "b", at(1), at(1), 2), (1, "b", at(1), at(3), 0), (3, "a", at(2), at(2), 1)],
                                 "id bigint, title string, created_at timestamp, updated_at timestamp, chunk_index int") \
        .withColumns({"document_id": F.lit(1), "owner": F.lit("o"), "conversation_id": F.lit(1), "is_pinned": F.col("id") == 2})
    for order, expected in ((ordering.newest_first, [3, 1, 2]), (ordering.by_activity, [1, 3, 2]), (ordering.chronological, [1, 2, 3]),
                            (ordering.alphabetical, [3, 1, 2]), (ordering.in_document_order, [1, 3, 2]), (ordering.pinned_first, [2, 1, 3])):
        placed = order(rows.unionByName(rows.withColumns({"owner": F.lit("p"), "conversation_id": F.lit(2)})))
        assert ids(placed.where("owner = 'o'").orderBy("position")) == expected
        assert sorted(r.position for r in placed.collect()) == [1, 1, 2, 2, 3, 3]
    top = ordering.newest_per(rows, ["title"], 1)
    assert {(r.id, r.rank) for r in top.collect()} == {(1, 1), (3, 1)}
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_new_rows_get_defaults(spark, as_of):
    rows = spark.createDataFrame([("t", "c", [" Writing", "writing"])], "title string, content string, tags array<string>")
    entry = maintain.new_memory_entries(rows, F.lit("ada"), as_of).first()
    assert (entry.category, entry.tags, entry.is_pinned, entry.source, entry.owner) == ("note", ["writing"], False, "manual", "ada")
    task = maintain.new_tasks(rows.select("title"), F.lit("ada"), as_of).first()
    assert (task.status, task.priority, task.description, task.due_date) == ("pending", "medium", "", None)
    goal = maintain.new_goals(rows.select("title"), F.lit("ada"), as_of).first()
    assert (goal.progress, goal.is_completed, goal.target_date) == (0, False, None)
    notes = spark.createDataFrame([("t", "c"), ("", "c"), ("t", None)], "title string, content string")
    good, refused = maintain.new_notes(notes, F.lit("ada"), as_of)
    assert good.count() == 1 and refused.count() == notes.count() - 1 and {r.error.field for r in refused.collect()} <= {"title", "content"}


def test_new_rows_get_ids(spark, as_of):
    stored = spark.createDataFrame([(7,), (3,)], "id bigint")
    rows = spark.createDataFrame([(f"t{i}",) for i in range(20)], "title string").repartition(4)
    assert sorted(r.id for r in maintain.new_tasks(rows, F.lit("ada"), as_of, stored).collect()) == list(range(8, 28))
    assert sorted(r.id for r in maintain.new_goals(rows, F.lit("ada"), as_of).collect()) == list(range(1, 21))
    assert maintain.new_tasks(rows.limit(0), F.lit("ada"), as_of, stored).count() == 0


def test_patches_of_one_row_become_one(spark, memory, as_of):
    patches = spark.createDataFrame([
        (1, "ada", ["title"], "first", None, 1), (1, "ada", ["title", "category"], "second", "fact", 2), (1, "ada", ["category"], None, "note", 3),
        (2, "ada", ["title"], "was", None, 1), (2, "ada", ["title"], None, None, 2),
    ], "id bigint, owner string, fields array<string>, title string, category string, patched_at int")
    after = maintain.partial_update(memory, patches, ["title", "category"], as_of)
    got = {r.id: (r.title, r.category) for r in after.collect()}
    assert after.count() == memory.count() and got[1] == ("second", "note") and got[2] == (None, "fact")


def test_partial_update(spark, memory, as_of):
    patches = spark.createDataFrame([
        (1, "ada", ["title", "tags"], "New", [" A", "a"], "fact"), (2, "ada", ["title"], None, None, None),
        (4, "ada", ["title"], "stolen", None, None), (99, "ada", ["title"], "x", None, None),
    ], "id bigint, owner string, fields array<string>, title string, tags array<string>, category string")
    after = {r.id: r for r in maintain.partial_update(memory, patches, ["title", "tags", "category"], as_of).collect()}
    before = {r.id: r for r in memory.collect()}
    assert (after[1].title, after[1].tags, after[1].category) == ("New", ["a"], "note")
    assert after[2].title is None and after[2].tags == ["x_y"]
    assert after[1].updated_at != before[1].updated_at
    assert [after[i] for i in (3, 4, 5)] == [before[i] for i in (3, 4, 5)] and len(after) == 5


def test_links(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "message_id bigint, chunk_id bigint")
    new = spark.createDataFrame([(1, 12)], "message_id bigint, chunk_id bigint")
    assert maintain.add_links(links, links.unionByName(new)).count() == 4
    written = spark.createDataFrame([(1,), (3,)], "message_id bigint")
    assert {tuple(r) for r in maintain.replace_links(links, new, written, "message_id").collect()} == {(1, 12), (2, 10)}


def _everything(spark):
    make = spark.createDataFrame
    return {
        "users": make([("ada",), ("grace",)], "id string"),
        "documents": make([(1, "ada"), (2, "grace")], "id bigint, owner string"),
        "document_chunks": make([(10, 1), (20, 2)], "id bigint, document_id bigint"),
        "conversations": make([(1, "ada"), (2, "grace")], "id bigint, owner string"),
        "messages": make([(1, 1), (2, 2)], "id bigint, conversation_id bigint"),
        "message_chunks": make([(1, 20), (2, 10), (2, 20)], "message_id bigint, chunk_id bigint"),
        "memory_entries": make([(1, "ada"), (2, "grace")], "id bigint, owner string"),
        "nodes": make([("a", "ada"), ("b", "ada"), ("g", "grace")], "id string, owner string"),
        "node_documents": make([("a", 1), ("g", 2)], "node_id string, document_id bigint"),
        "edges": make([(1, "ada", "a", "b"), (2, "ada", "b", "a"), (3, "grace", "g", "g")],
                      "id bigint, owner string, source_id string, target_id string"),
        "notes": make([(1, "ada"), (2, "grace")], "id bigint, owner string"),
        "note_documents": make([(1, 1), (2, 2)], "note_id bigint, document_id bigint"),
        "tasks": make([(1, "ada"), (2, "grace")], "id bigint, owner string"),
        "goals": make([(1, "ada"), (2, "grace")], "id bigint, owner string"),
    }


def _left(spark, table, key, kind):
    gone = spark.createDataFrame([(key,)], f"id {kind}")
    return {n: sorted(tuple(r) for r in d.collect()) for n, d in maintain.cascade_delete(_everything(spark), table, gone).items()}


def test_cascade_from_user(spark):
    left = _left(spark, "users", "ada", "string")
    assert left == {
        "users": [("grace",)], "documents": [(2, "grace")], "document_chunks": [(20, 2)], "conversations": [(2, "grace")],
        "messages": [(2, 2)], "message_chunks": [(2, 20)], "memory_entries": [(2, "grace")], "nodes": [("g", "grace")],
        "node_documents": [("g", 2)], "edges": [(3, "grace", "g", "g")], "notes": [(2, "grace")],
        "note_documents": [(2, 2)], "tasks": [(2, "grace")], "goals": [(2, "grace")],
    }


def test_cascade_from_document_conversation_and_node(spark):
    left = _left(spark, "documents", 1, "bigint")
    assert left["document_chunks"] == [(20, 2)] and left["message_chunks"] == [(1, 20), (2, 20)]
    assert left["node_documents"] == [("g", 2)] and len(left["nodes"]) == 3 and left["note_documents"] == [(2, 2)]
    left = _left(spark, "conversations", 2, "bigint")
    assert left["messages"] == [(1, 1)] and left["message_chunks"] == [(1, 20)]
    left = _left(spark, "nodes", "b", "string")
    assert left["edges"] == [(3, "grace", "g", "g")] and len(left["node_documents"]) == 2


def test_toggle_and_goal_rules(spark):
    rows = spark.createDataFrame([("completed",), ("pending",), ("in_progress",)], "s string")
    assert [r[0] for r in rows.select(maintain.toggled_status(F.col("s"))).collect()] == ["pending", "completed", "completed"]
    goals = spark.createDataFrame([(40, True), (40, False), (140, False), (-3, False)], "progress int, is_completed boolean")
    assert [r.progress for r in views.goals_view(goals).collect()] == [100, 40, 100, 0]


DOC = "file_type string, file_name string, file_size bigint, raw_text string, source_url string"


@pytest.mark.parametrize("row,field", [
    (("note", None, None, "text", None), None), (("note", None, None, " \x1f", None), "raw_text"),
    (("note", None, None, None, None), "raw_text"), (("docx", "a.docx", 1, None, None), "file_type"),
    ((None, None, None, None, None), "file_type"), (("pdf", "a.PDF", 10, None, None), None),
    (("pdf", "a.txt", 10, None, None), "file"), (("txt", None, None, None, None), "file"),
    (("txt", "a.txt", 10 * 1024 * 1024, None, None), None), (("txt", "a.txt", 10 * 1024 * 1024 + 1, None, None), "file"),
    (("link", None, None, None, "http://x"), None), (("link", None, None, None, ""), "source_url"),
])
def test_document_validation(spark, row, field):
    error = validation.validate_documents(spark.createDataFrame([row], DOC)).first().error
    assert (error.field if error else None) == field


def test_docx_can_be_allowed_and_rows_split(spark):
    rows = spark.createDataFrame([("docx", "a.docx", 1, None, None), ("bogus", None, None, None, None)], DOC)
    error = validation.document_error(*[F.col(c) for c in rows.columns], allowed=("note", "docx"))
    good, bad = validation.split_valid(rows, error)
    assert [r.file_type for r in good.collect()] == ["docx"] and bad.first().error.field == "file_type"


def test_memory_validation(spark):
    rows = spark.createDataFrame([
        (0, "t", "c", "note", ["x" * 40]), (1, " ", "c", "note", None), (2, "x" * 181, "c", "note", None),
        (3, "t", "\n", "note", None), (4, "t", "c", "bad", None), (5, "t", "c", None, ["x" * 41]), (6, "t", "c", None, None),
    ], "i int, t string, c string, k string, g array<string>").orderBy("i")
    error = validation.memory_error(F.col("t"), F.col("c"), F.col("k"), F.col("g"))["field"]
    assert [r[0] for r in rows.select(error).collect()] == [None, "title", "title", "content", "category", "tags", None]


def test_limits(spark):
    whole = spark.createDataFrame([(i, t) for i, t in enumerate(["5.0", " 7. ", "5.5", "1.0.0"])], "i int, t string").orderBy("i")
    assert [r[0] for r in whole.select(validation.whole_number(F.col("t"))).collect()] == [5, 7, None, None]
    texts = ["0", "1", "20", "21", "-1", "abc", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    strict = validation.search_error(F.lit("q"), F.col("t"))["field"]
    assert [r[0] for r in rows.filter("t is not null").select(strict).collect()] == ["limit", None, None, "limit", "limit", "limit"]
    got = rows.select(validation.clamped_limit(F.col("t")), validation.clamped_limit_error(F.col("t"))["field"]).collect()
    assert [tuple(r) for r in got] == [(0, None), (1, None), (20, None), (20, None), (-1, "limit"), (None, "limit"), (5, None)]


def test_search_query_precedence(spark):
    cases = [("a", "b", "c", "d"), (None, "b", "c", "d"), ("", "b", "c", "d"), (None, None, "c", "d"),
             (None, None, None, "d"), (None, None, None, None), (" ", "b", None, None), (None, "", None, "d"),
             (None, None, "", "d")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, c string, d string").orderBy("i")
    got = rows.select(validation.search_query(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()
    assert [r[0] for r in got] == ["a", "b", "c", "c", "d", "", "", "d", ""]


def test_chat_validation(spark):
    rows = spark.createDataFrame([(0, "hi", None), (1, " ", None), (2, None, None), (3, "x" * 8000 + " ", 1), (4, "x" * 8001, 1),
                                  (5, "hi", 0)], "i int, m string, c bigint").orderBy("i")
    error = validation.chat_error(F.col("m"), F.col("c"))["field"]
    assert [r[0] for r in rows.select(error).collect()] == [None, "message", "message", None, "message", "conversation_id"]


def test_dashboard_and_digest(spark, memory):
    users = spark.createDataFrame([("ada",), ("grace",), ("idle",)], "id string")
    docs = spark.createDataFrame([(i, "ada", f"D{i}", "completed" if i % 2 else "failed", at(i)) for i in range(1, 8)],
                                 "id bigint, owner string, title string, processing_status string, updated_at timestamp")
    chunks = spark.createDataFrame([(1,), (1,), (2,), (77,)], "document_id bigint")
    tasks = spark.createDataFrame([("ada", "pending"), ("ada", "completed"), ("ghost", "pending")], "owner string, status string")
    expected = {"ada": (7, 4, 4, 1, 3), "grace": (0, 0, 1, 0, 0), "idle": (0, 0, 0, 0, 0)}
    owned = chunks.join(docs.select(F.col("id").alias("document_id"), "owner"), "document_id")
    for given in (chunks, owned):
        got = views.dashboard_summary(users, docs, given, memory, tasks).collect()
        assert {r.owner: (r.documents, r.completed_documents, r.memories, r.pending_tasks, r.chunks) for r in got} == expected
    digest = {r.owner: r for r in views.daily_digest(users, docs, memory, lambda: lambda text: f"{len(text) > 10}").collect()}
    assert digest["ada"].recent_documents == "D7, D6, D5, D4, D3"
    assert digest["ada"].recent_memories == "Third, Other, Null tags, Postgres tips"
    assert digest["idle"].recent_documents == "" and digest["idle"].summary == "True"
    assert "Recent Documents: D7" in digest["ada"].prompt


def test_lists(spark):
    docs = spark.createDataFrame([(1, "ada", "One", None, at(1)), (2, "ada", "Two", "x" * 600, at(2))],
                                 "id bigint, owner string, title string, raw_text string, created_at timestamp")
    chunks = spark.createDataFrame([(2,)], "document_id bigint")
    got = views.list_documents(docs, chunks).collect()
    assert sorted((r.position, r.id, len(r.raw_text_preview), r.chunk_count) for r in got) == [(1, 2, 500, 1), (2, 1, 0, 0)]
    tasks = spark.createDataFrame([("in_progress", "high", datetime(2025, 3, 4, 23, 59, tzinfo=timezone.utc))],
                                  "status string, priority string, due_date timestamp")
    row = views.tasks_view(tasks).first()
    assert (row.status_label, row.priority_label, row.due_day) == ("In Progress", "High", date(2025, 3, 4))
    notes = spark.createDataFrame([(1,), (2,)], "id bigint")
    links = spark.createDataFrame([(1, 30), (1, 4), (1, 31), (1, 4)], "note_id bigint, document_id bigint")
    got = {(r.id, r.page): r.related_documents for r in views.notes_view(notes, links, page_rows=2).collect()}
    assert got == {(1, 0): [4, 30], (1, 1): [31], (2, 0): []}


def test_exact_rank_and_salted_join(spark):
    rows = spark.createDataFrame([("a", i * 7 % 50) for i in range(50)] + [("b", 3)], "k string, v int")
    ranked = sizing.exact_rank(rows, ["k"], F.floor(F.col("v") / 8), [F.col("v")], "n")
    assert {(r.k, r.v): r.n for r in ranked.collect()} == {**{("a", v): v + 1 for v in range(50)}, ("b", 3): 1}
    one = sizing.exact_rank(rows, ["k"], F.lit(0), [F.col("v")], "n", F.floor(F.col("v") / 8), most=10)
    assert {(r.k, r.v): r.n for r in one.collect()} == {(r.k, r.v): r.n for r in ranked.collect()}
    small = spark.createDataFrame([("a", 1), ("c", 2)], "k string, w int")
    assert sizing.salted_join(rows, small, ["k"], F.col("v"), 4).count() == 50
    assert sizing.small_frame(small.filter("w > 5")) is None
    assert sizing.small_frame(small, 1) is small
    plan = rows.join(sizing.small_frame(small, 2), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
