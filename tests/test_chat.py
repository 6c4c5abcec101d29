from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.embedding import HashingEmbedder
from loreloom.plans import chat, search

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
EMBED = HashingEmbedder(64)
MESSAGE = "id bigint, conversation_id bigint, role string, content string, created_at timestamp"
EXCHANGE = "exchange_id bigint, owner string, conversation_id bigint, message string"


def messages(spark, *rows):
    return spark.createDataFrame([(i, c, r, t, T0 + timedelta(minutes=i)) for i, c, r, t in rows], MESSAGE)


@pytest.fixture(scope="module")
def library(spark):
    docs = spark.createDataFrame([(1, "ada", "Ada Notes"), (2, "grace", "Grace Notes"), (3, "ada", "Long")],
                                 "id bigint, owner string, title string")
    chunks = spark.createDataFrame([
        ("1-0", 1, 0, "hello world test"), ("2-0", 2, 0, "hello world test"), ("3-0", 3, 0, "word " * 900),
    ], "id string, document_id bigint, chunk_index int, content string")
    return docs, chunks.withColumn("embedding", EMBED.embed(F.col("content")))


def test_search_by_text(spark, library):
    docs, chunks = library
    asked = spark.createDataFrame([("q", "ada", " hello world TEST "), ("blank", "ada", " "), ("g", "grace", "hello")],
                                  "query_id string, owner string, query string")
    hits = search.semantic_search(search.embed_queries(asked, EMBED), chunks, docs, 2).collect()
    best = {r.query_id: r for r in hits if r.rank == 1}
    assert set(best) == {"q", "g"}
    assert best["q"].document_title == "Ada Notes" and best["q"].similarity_score == pytest.approx(1.0, abs=1e-4)
    assert best["g"].document_title == "Grace Notes"
    assert {r.owner for r in hits if r.document_id == 2} == {"grace"}
    approx = search.search_chunks(search.embed_queries(asked, EMBED), chunks, docs, 1, approximate={"dimensions": 64})
    assert {(r.query_id, r.chunk_id) for r in approx.collect()} >= {("q", "1-0")}


def test_search_requests(spark):
    rows = spark.createDataFrame([
        (1, "a", "hi", None, None, None, "3", None), (2, "a", None, None, None, None, None, None),
        (3, "a", None, None, None, "x", "0", None), (4, "a", None, "q", None, None, None, None),
    ], "query_id bigint, owner string, body_query string, body_q string, url_query string, url_q string, body_limit string, url_limit string")
    good, bad = search.search_requests(rows, EMBED)
    assert {(r.query_id, r.query, r.k) for r in good.collect()} == {(1, "hi", 3), (4, "q", 5)}
    assert {r.query_id: r.error.field for r in bad.collect()} == {2: "query", 3: "limit"}


def test_recent_history_is_newest_eight_oldest_first(spark):
    rows = messages(spark, *[(i, 1, "user" if i % 2 else "assistant", f"m{i}") for i in range(12)], (50, 2, "user", ""))
    got = {r.conversation_id: r for r in chat.recent_history(rows).collect()}
    assert [m.content for m in got[1].messages] == [f"m{i}" for i in range(4, 12)]
    assert got[1].history.split("\n")[0] == "assistant: m4" and got[2].history == ""


def test_history_is_cut_from_the_start(spark):
    rows = messages(spark, (1, 1, "user", "a " * 1500), (2, 1, "assistant", "b " * 1500))
    text = chat.recent_history(rows).first().history
    assert text.startswith("user: a a") and text.endswith("...") and len(text) <= 4003


def test_every_question_has_the_history_before_it(spark):
    rows = messages(spark, (1, 1, "user", "first"), (2, 1, "assistant", "reply"), (3, 1, "user", "second"),
                    (4, 1, "system", "later"), (5, 2, "assistant", "alone"), (6, 1, "user", "third"))
    asked = chat.asked_questions(rows)
    assert sorted((r.exchange_id, r.conversation_id, r.message, r.seq) for r in asked.collect()) == [
        (1, 1, "first", 1), (3, 1, "second", 3), (6, 1, "third", 5)]
    got = {r.exchange_id: [m.content for m in r.messages] for r in chat.history_before(asked, rows, 3).collect()}
    assert got == {3: ["first", "reply"], 6: ["reply", "second", "later"]}


def _answered(spark, rows):
    return spark.createDataFrame(rows, "exchange_id long, owner string, conversation_id long, title string, message string, answer string") \
        .withColumn("sources", F.array().cast("array<struct<chunk_id:string,score:double>>"))


def test_recording_keeps_owners_and_new_conversations_apart(spark, as_of):
    talks = spark.createDataFrame([(1, "ada", "Ada", T0, T0), (2, "eve", "Eve", T0, T0)],
                                  "id long, owner string, title string, created_at timestamp, updated_at timestamp")
    stored = messages(spark, (9, 1, "user", "before"))
    links = spark.createDataFrame([], "message_id long, chunk_id string, citation_rank int, score double")
    after = chat.record_exchanges(_answered(spark, [
        (1, "ada", 1, None, "mine", "a"), (2, "eve", 1, None, "not hers", "b"), (3, "eve", None, "first new", "m3", "c"),
        (4, "ada", None, "second new", "m4", "d"), (5, "ada", 77, None, "unknown", "e"), (6, "ada", 1, None, "again", "f"),
        (7, None, None, "no owner", "m7", "g")]), talks, stored, links, as_of)
    assert {(r.exchange_id, r.error) for r in after.refused.collect()} == {(2, "Conversation not found."), (5, "Conversation not found.")}
    talk = {r.id: (r.owner, r.title) for r in after.conversations.collect()}
    assert after.conversations.count() == 5 and set(talk) == {1, 2, 3, 4, 5}
    assert sorted(v[1] for k, v in talk.items() if k > 2) == ["first new", "no owner", "second new"]
    said = after.messages.collect()
    assert len({r.id for r in said}) == len(said) == 11 and all(r.id > 9 for r in said if r.content != "before")
    for r in said:
        if r.content in ("m3", "c"):
            assert talk[r.conversation_id] == ("eve", "first new")
        if r.content in ("m4", "d"):
            assert talk[r.conversation_id] == ("ada", "second new")
    assert {r.content for r in said if r.conversation_id == 1} == {"before", "mine", "a", "again", "f"}


def test_chat_chain(spark, library, as_of):
    docs, chunks = library
    talks = spark.createDataFrame([(7, "ada", "old", T0, T0)], "id long, owner string, title string, created_at timestamp, updated_at timestamp")
    asks = spark.createDataFrame([(1, "ada", 7, "I like tea"), (2, "ada", None, "x" * 100), (3, "eve", 7, "not hers"), (4, "ada", 7, " ")], EXCHANGE)
    links = spark.createDataFrame([], "message_id long, chunk_id string, citation_rank int, score double")
    memories = spark.createDataFrame([(5, "ada")], "id long, owner string")

    def load():
        return lambda text: '{"title":"Tea","content":"likes tea","category":"preference"}' if "I like tea" in text else "{}"

    done = chat.chat_requests(asks, talks, messages(spark, (1, 7, "user", "before")), links, chunks, docs, memories, as_of, load, EMBED)
    assert {(r.exchange_id, r.error.field) for r in done.refused.collect()} == {(3, "conversation_id"), (4, "message")}
    assert done.recorded.refused.count() == 0
    assert {r.id: r.title for r in done.recorded.conversations.collect()} == {7: "old", 8: "x" * 80}
    assert done.recorded.messages.count() == 5
    assert [(r.id, r.title) for r in done.memories.collect()] == [(6, "Tea")]


def test_conversations_are_resolved(spark):
    known = spark.createDataFrame([(1, "ada"), (2, "grace")], "id bigint, owner string")
    asks = spark.createDataFrame([(1, "ada", 1, "m"), (2, "ada", 2, "m"), (3, "ada", None, "x" * 100), (4, "ada", 9, "m")], EXCHANGE)
    got = {r.exchange_id: (r.status, r.title) for r in chat.resolve_conversations(asks, known).collect()}
    assert got == {1: ("existing", None), 2: ("not_found", None), 3: ("new", "x" * 80), 4: ("not_found", None)}


def test_whole_exchange(spark, library, as_of):
    docs, chunks = library
    asks = spark.createDataFrame([(1, "ada", 7, "hello world"), (2, "nobody", 8, "anything")], EXCHANGE)
    stored = messages(spark, (1, 7, "user", "before"), (2, 7, "assistant", "yes"))
    context = chat.chat_context(asks, stored, chunks, docs, EMBED)
    rows = {r.exchange_id: r for r in chat.answer(context).collect()}
    one, two = rows[1], rows[2]
    assert one.sources[0].document_title == "Ada Notes" and one.sources[0].score == one.sources[0].similarity_score
    assert len(one.sources) == 2 and len(one.sources[1].content) <= 1803 and one.sources[1].content.endswith("...")
    assert one.context.startswith("[S1] Document: Ada Notes\nChunk: 0\nhello world test\n\n[S2] Document: Long")
    assert [m.role for m in one.prompt] == ["system", "user"] and "[S1]" in one.prompt[0].content
    assert one.prompt[1].content.startswith("Conversation history:\nuser: before\nassistant: yes\n\nRetrieved context:\n[S1]")
    assert one.prompt[1].content.endswith("User question:\nhello world")
    assert one.answer.startswith('Based on the retrieved document context for "hello world", the most relevant evidence is in [S1], [S2].')
    assert "[S1] Ada Notes: hello world test" in one.answer
    assert two.answer == K.NO_SOURCES_ANSWER and two.sources == []
    assert two.prompt[1].content == ("Conversation history:\nNo previous messages.\n\nRetrieved context:\n"
                                     "No relevant context retrieved.\n\nUser question:\nanything")

    def load():
        return lambda text: "" if "anything" in text else "model says"

    modelled = {r.exchange_id: r.answer for r in chat.answer(context, load).collect()}
    assert modelled == {1: "model says", 2: K.NO_SOURCES_ANSWER}

    answered = chat.answer(context).withColumns({
        "title": F.lit("new talk"), "user_message_id": F.col("exchange_id") * 10,
        "assistant_message_id": F.col("exchange_id") * 10 + 1})
    talks = spark.createDataFrame([(7, "ada", "old", T0, T0), (6, "ada", "quiet", T0, T0)],
                                  "id bigint, owner string, title string, created_at timestamp, updated_at timestamp")
    links = spark.createDataFrame([(11, "stale", 1, 0.5), (2, "1-0", 1, 0.5)],
                                  "message_id bigint, chunk_id string, citation_rank int, score double")
    after = chat.record_exchanges(answered, talks, stored, links, as_of)
    talk = {r.id: (r.title, r.owner, r.updated_at > talks.first().updated_at) for r in after.conversations.collect()}
    assert talk == {7: ("old", "ada", True), 6: ("quiet", "ada", False), 8: ("new talk", "nobody", True)}
    assert {(r.id, r.conversation_id, r.role) for r in after.messages.filter("id >= 10").collect()} == {
        (10, 7, "user"), (11, 7, "assistant"), (20, 8, "user"), (21, 8, "assistant")}
    assert {(r.message_id, r.chunk_id, r.citation_rank) for r in after.message_chunks.collect()} == {
        (2, "1-0", 1), (11, "1-0", 1), (11, "3-0", 2)}

    detail = chat.conversation_detail(
        after.conversations, after.messages, chat.message_sources(after.messages, after.message_chunks, chunks, docs), page_rows=3)
    pages = {(r.id, r.page): [(m.role, len(m.sources)) for m in r.messages] for r in detail.collect()}
    assert pages[(6, 0)] == [] and pages[(7, 0)] == [("user", 0), ("assistant", 1), ("user", 0)]
    assert pages[(7, 1)] == [("assistant", 2)] and len(pages[(8, 0)]) == 2
    zero = chat.message_sources(after.messages, after.message_chunks, chunks, docs, legacy_zero_score=True)
    assert {r.score for r in zero.collect()} == {0.0}
    listed = {r.id: (r.owner, r.position) for r in chat.list_conversations(after.conversations).collect()}
    assert listed == {7: ("ada", 1), 6: ("ada", 2), 8: ("nobody", 1)}


def test_memories_from_exchanges(spark, as_of):
    rows = spark.createDataFrame([("ada", "I like tea", "ok"), ("ada", "hm", "ok")], "owner string, message string, answer string")

    def load():
        return lambda text: '{"title":"Tea","content":"likes tea","category":"preference"}' if "tea" in text else "{}"

    row, = chat.extract_memories(rows, as_of, load).collect()
    assert (row.owner, row.title, row.category, row.source, row.tags) == ("ada", "Tea", "preference", "autonomous", [])
    assert chat.extract_memories(rows, as_of, None).count() == 0
