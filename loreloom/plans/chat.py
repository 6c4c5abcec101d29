"""Chat exchanges: history, retrieval, prompt, answer, and what gets stored."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions import prompts
from loreloom.functions.embedding import Embedder
from loreloom.functions.text import truncate
from loreloom.operators.generate import Generator, answer_or_fallback, generate, memory_candidate
from loreloom.operators.maintain import new_memory_entries, replace_links
from loreloom.operators.ordering import by_activity, chronological
from loreloom.operators.sizing import (
    attach_pages, broadcast_if_bounded, ordered_list, page_of_rank,
)
from loreloom.operators.validation import chat_error, split_valid
from loreloom.plans.search import embed_queries, search_chunks
from loreloom.sources.tables import stored, with_new_ids

MESSAGE_PAGE_ROWS = 500
_NO_MESSAGES = "array<struct<role:string,content:string>>"


def resolve_conversations(exchanges: DataFrame, conversations: DataFrame) -> DataFrame:
    """Adds ``status`` (existing, new, not_found) and the ``title`` a new conversation gets.

    ``exchanges``: exchange_id, owner, conversation_id (null asks for a new one), message.
    """
    known = conversations.select("owner", F.col("id").alias("conversation_id"), F.lit(True).alias("_known"))
    named = F.col("conversation_id").isNotNull()
    return exchanges.join(known, ["owner", "conversation_id"], "left").select(
        *exchanges.columns,
        F.when(~named, "new").when(F.col("_known"), "existing").otherwise("not_found").alias("status"),
        F.when(~named, prompts.conversation_title(F.col("message"))).alias("title"),
    )


def recent_messages(messages: DataFrame, n: int = K.HISTORY_MESSAGES) -> DataFrame:
    """Newest ``n`` messages per conversation with ``recency`` 1 for the newest."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def recent_history(messages: DataFrame, n: int = K.HISTORY_MESSAGES) -> DataFrame:
    """conversation_id, messages (oldest first, at most n) and their history text."""
    turn = F.struct("role", "content")
    return (
        recent_messages(messages, n).groupBy("conversation_id")
        .agg(ordered_list(turn, -F.col("recency")).alias("messages"))
        .withColumn("history", prompts.history_text(F.col("messages")))
    )


def asked_questions(messages: DataFrame) -> DataFrame:
    """Every user message as an exchange: exchange_id, conversation_id, message and ``seq``, its place in the
    conversation."""
    return chronological(messages, "seq").filter(F.col("role") == "user").select(
        F.col("id").alias("exchange_id"), "conversation_id", F.col("content").alias("message"), "seq")


def history_before(exchanges: DataFrame, messages: DataFrame, n: int = K.HISTORY_MESSAGES) -> DataFrame:
    """exchange_id, messages, history: the ``n`` messages before each exchange's place ``seq`` in its conversation.

    An exchange looks up the at most n places before its own; the messages of a conversation are never gathered."""
    places = exchanges.select("exchange_id", "conversation_id", "seq", F.explode(F.sequence(
        F.greatest(F.col("seq") - n, F.lit(0)), F.col("seq") - 1)).alias("_at")).filter(F.col("_at") > 0)
    numbered = chronological(_of_conversations(messages, exchanges), "seq").select(
        "conversation_id", F.col("seq").alias("_at"), "role", "content")
    found = places.join(numbered, ["conversation_id", "_at"])
    return found.groupBy("exchange_id").agg(ordered_list(F.struct("role", "content"), F.col("_at")).alias("messages")) \
        .withColumn("history", prompts.history_text(F.col("messages")))


def _of_conversations(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Only the messages of conversations that are asked about."""
    asked = exchanges.select("conversation_id").filter(F.col("conversation_id").isNotNull()).distinct()
    return messages.join(asked, "conversation_id", "left_semi")


def retrieve_sources(exchanges: DataFrame, chunks: DataFrame, documents: DataFrame,
                     embedder: Embedder | None = None, k: int = K.CONTEXT_CHUNKS,
                     include_zero: bool = False) -> DataFrame:
    """exchange_id, sources: the k best chunks as ranked structs."""
    asked = exchanges.select(F.col("exchange_id").alias("query_id"), "owner", F.col("message").alias("query"))
    hits = search_chunks(embed_queries(asked, embedder), chunks, documents, k, include_zero=include_zero)
    return group_sources(hits).withColumnRenamed("query_id", "exchange_id")


def group_sources(hits: DataFrame) -> DataFrame:
    """query_id, sources from ranked search hits; at most k per query."""
    source = prompts.source_struct(
        F.col("document_id"), F.col("document_title"), F.col("chunk_id").cast("string"),
        F.col("chunk_index"), F.col("content"), F.col("distance"),
    )
    return hits.groupBy("query_id").agg(ordered_list(source, F.col("rank")).alias("sources"))


def chat_context(exchanges: DataFrame, messages: DataFrame, chunks: DataFrame, documents: DataFrame,
                 embedder: Embedder | None = None, k: int = K.CONTEXT_CHUNKS,
                 history_size: int = K.HISTORY_MESSAGES) -> DataFrame:
    """Everything a model needs per exchange: sources, context, history, prompt.

    ``exchanges``: exchange_id, owner, conversation_id, message. ``messages`` are the stored ones, so the new
    message is not part of its own history. Exchanges with a place ``seq`` among the stored messages have what was
    said before it as their history, others the newest messages.
    """
    if "seq" in exchanges.columns:
        history, on = history_before(exchanges, messages, history_size), "exchange_id"
    else:
        history, on = recent_history(_of_conversations(messages, exchanges), history_size), "conversation_id"
    asked = exchanges.join(history.drop("messages"), on, "left")
    asked = asked.join(retrieve_sources(exchanges, chunks, documents, embedder, k), "exchange_id", "left")
    sources = F.coalesce("sources", F.array().cast(prompts.SOURCE_TYPE))
    return asked.withColumn("sources", sources).withColumns({
        "context": prompts.context_text(F.col("sources")),
        "history": F.coalesce("history", F.lit("")),
    }).withColumns({
        "prompt": prompts.prompt_messages(F.col("message"), F.col("context"), F.col("history")),
    })


def answer(contexts: DataFrame, model: Generator | None = None) -> DataFrame:
    """Adds ``answer``: the model's reply to the user prompt, else the leading excerpts."""
    reply = generate(F.col("prompt")[1]["content"], model)
    return contexts.withColumn(
        "answer", answer_or_fallback(reply, prompts.fallback_answer(F.col("message"), F.col("sources")))
    )


@dataclass
class Recorded:
    conversations: DataFrame
    messages: DataFrame
    message_chunks: DataFrame
    refused: DataFrame
    exchanges: DataFrame


def _settled(answered: DataFrame, conversations: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Exchanges with ``error`` (null: accepted), ``_opens`` (for the one that opens its conversation) and a
    conversation id each.

    A null conversation asks for a new one, each for its own. A named one must be its owner's; an unknown one is
    opened if the exchange has a title for it, for the owner of the first exchange."""
    fresh = F.col("conversation_id").isNull()
    new = answered.filter(fresh).drop("conversation_id")
    taken = conversations.select(F.col("id").alias("conversation_id")).union(
        answered.filter(F.col("title").isNotNull()).select("conversation_id"))
    opened = with_new_ids(new, taken if ids is None else ids.select(F.col("id").alias("conversation_id")), "conversation_id") \
        .withColumns({"error": F.lit(None).cast("string"), "_opens": F.lit(True)})
    known = conversations.select(F.col("id").alias("conversation_id"), F.col("owner").alias("_owner"))
    named = answered.filter(~fresh).join(known, "conversation_id", "left")
    first = named.filter(F.col("_owner").isNull() & F.col("title").isNotNull()).groupBy("conversation_id").agg(
        F.min(F.struct("exchange_id", F.col("owner").alias("_by"))).alias("_first"))
    named = named.join(first, "conversation_id", "left")
    belongs = F.coalesce("_owner", "_first._by").eqNullSafe(F.col("owner")) & F.coalesce("_owner", "_first._by").isNotNull()
    return opened.unionByName(named.withColumns({
        "error": F.when(~belongs, F.lit("Conversation not found.")),
        "_opens": F.coalesce(F.col("_owner").isNull() & (F.col("_first.exchange_id") == F.col("exchange_id")), F.lit(False)),
    }).drop("_owner", "_first"))


def record_exchanges(answered: DataFrame, conversations: DataFrame, messages: DataFrame,
                     message_chunks: DataFrame, as_of: Column, ids: DataFrame | None = None) -> Recorded:
    """Tables after storing the exchanges.

    ``answered``: exchange_id (distinct), owner, conversation_id, title (for new conversations), message, answer,
    sources, and the ids of both messages (user_message_id, assistant_message_id), which are given out here where
    they are absent. Sources go to the assistant message, the user message gets none, and the conversations'
    updated_at moves. The exchanges are stored first, so that a model is asked once and all tables get the same
    answer. Exchanges that name a conversation of another owner, or an unknown one without a title, store nothing
    and come back in ``refused``; ``exchanges`` are the stored ones, with their conversation. New ids follow those
    of the tables, or of ``ids`` where the tables aren't all there is.
    """
    settled = stored(_settled(stored(answered, "answered"), conversations, ids), "settled")
    refused = settled.filter(F.col("error").isNotNull()).drop("_opens")
    answered = settled.filter(F.col("error").isNull()).drop("error")
    if "user_message_id" not in answered.columns:
        used = messages if ids is None else ids
        answered = with_new_ids(answered, used.select(F.ceil(F.col("id") / 2).alias("_pair")), "_pair").withColumns({
            "user_message_id": F.col("_pair") * 2, "assistant_message_id": F.col("_pair") * 2 + 1}).drop("_pair")
        answered = stored(answered, "numbered-answers")
    said = answered.select(
        F.explode(F.array(
            F.struct(F.col("user_message_id").alias("id"), F.lit("user").alias("role"),
                     F.col("message").alias("content")),
            F.struct(F.col("assistant_message_id").alias("id"), F.lit("assistant").alias("role"),
                     F.col("answer").alias("content")),
        )).alias("m"), "conversation_id", "owner",
    ).select("m.id", "conversation_id", "owner", "m.role", "m.content", as_of.alias("created_at"))
    cited = answered.select(
        F.col("assistant_message_id").alias("message_id"), "owner", F.posexplode("sources").alias("pos", "s")
    ).select("message_id", "owner", F.col("s.chunk_id").alias("chunk_id"), (F.col("pos") + 1).alias("citation_rank"),
             F.col("s.score").alias("score"))
    written = answered.select(F.explode(F.array("user_message_id", "assistant_message_id")).alias("message_id"))

    touched = answered.select(F.col("conversation_id").alias("id"), "owner").distinct().withColumn("_touched", F.lit(True))
    known = conversations.join(broadcast_if_bounded(touched), ["id", "owner"], "left") \
        .withColumn("updated_at", F.when(F.col("_touched"), as_of).otherwise(F.col("updated_at"))).drop("_touched")
    opened = answered.filter("_opens").select(
        F.col("conversation_id").alias("id"), "owner", F.coalesce("title", F.lit("")).alias("title"),
        as_of.alias("created_at"), as_of.alias("updated_at"))
    of_table = lambda rows, table: rows.select(*[c for c in rows.columns if c in table.columns])
    return Recorded(
        known.select(*opened.columns).unionByName(opened),
        messages.unionByName(of_table(said, messages), allowMissingColumns=True),
        replace_links(message_chunks, of_table(cited, message_chunks), written, "message_id"),
        refused, answered.drop("_opens"),
    )


def extract_memories(answered: DataFrame, as_of: Column, model: Generator | None, existing: DataFrame | None = None) -> DataFrame:
    """New memory rows a model finds in the exchanges; none without a model. Their ids follow those of ``existing``.
    """
    reply = generate(prompts.memory_prompt(F.col("message"), F.col("answer")), model)
    found = answered.select("owner", memory_candidate(reply).alias("c")).filter(F.col("c").isNotNull())
    return new_memory_entries(found.select("owner", "c.*"), F.col("owner"), as_of, source="autonomous", existing=existing)


@dataclass
class Chat:
    """The tables after a batch of chat requests; ``refused`` ones have an ``error``."""

    recorded: Recorded
    memories: DataFrame
    refused: DataFrame


def chat_requests(requests: DataFrame, conversations: DataFrame, messages: DataFrame, message_chunks: DataFrame, chunks: DataFrame,
                  documents: DataFrame, memories: DataFrame, as_of: Column, model: Generator | None = None,
                  embedder: Embedder | None = None, ids: DataFrame | None = None) -> Chat:
    """The whole chain: validate, resolve or open the conversation, history, retrieval, answer, record, memories.

    ``requests``: exchange_id, owner, conversation_id, message. Conversations are settled before anything is
    retrieved, so that an exchange refused costs nothing."""
    good, invalid = split_valid(requests, chat_error(F.col("message"), F.col("conversation_id")))
    resolved = resolve_conversations(good, conversations)
    lost = resolved.filter(F.col("status") == "not_found").drop("status", "title").withColumn(
        "error", F.struct(F.lit("conversation_id").alias("field"), F.lit("Conversation not found.").alias("message")))
    asked = resolved.filter(F.col("status") != "not_found").drop("status")
    answered = answer(chat_context(asked, messages, chunks, documents, embedder), model)
    recorded = record_exchanges(answered, conversations, messages, message_chunks, as_of, ids)
    found = extract_memories(recorded.exchanges, as_of, model, memories if ids is None else ids)
    return Chat(recorded, found, invalid.unionByName(lost))


def list_conversations(conversations: DataFrame) -> DataFrame:
    return by_activity(conversations.select("id", "owner", "title", "created_at", "updated_at"))


def message_sources(messages: DataFrame, message_chunks: DataFrame, chunks: DataFrame, documents: DataFrame,
                    legacy_zero_score: bool = False) -> DataFrame:
    """Flat citations of assistant messages: message_id, citation_rank and the source fields.

    The stored score is returned; ``legacy_zero_score`` shows 0.0, as a history that does not
    keep scores would.
    """
    assistant = messages.filter(F.col("role") == "assistant").select(F.col("id").alias("message_id"))
    texts = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "content")
    titles = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    score = F.lit(0.0) if legacy_zero_score else F.coalesce("score", F.lit(0.0))
    return (
        message_chunks.join(assistant, "message_id").join(texts, "chunk_id").join(titles, "document_id")
        .select("message_id", "citation_rank", "document_id", "document_title", "chunk_id", "chunk_index",
                truncate(F.col("content"), K.SOURCE_CHARS).alias("content"),
                score.alias("score"), score.alias("similarity_score"))
    )


def conversation_detail(conversations: DataFrame, messages: DataFrame, sources: DataFrame,
                        page_rows: int = MESSAGE_PAGE_ROWS, bucket_seconds: int = 3600) -> DataFrame:
    """Conversations with their messages, each with its sources, oldest first.

    ``sources`` is ``message_sources(...)``. Messages come in pages of ``page_rows``: page 0 holds
    the first ones. A message has the few sources it was answered from, so that list is bounded;
    a conversation's message list is not, hence the pages.
    """
    fields = [c for c in sources.columns if c not in ("message_id", "citation_rank")]
    cited = sources.groupBy("message_id").agg(
        ordered_list(F.struct(*fields), F.col("citation_rank")).alias("sources")
    ).withColumnRenamed("message_id", "id")
    numbered = chronological(messages, "seq", bucket_seconds)
    item = F.struct("id", "role", "content", "sources", "created_at")
    pages = (
        numbered.join(cited, "id", "left")
        .withColumn("sources", F.coalesce("sources", F.array().cast(cited.schema["sources"].dataType)))
        .groupBy("conversation_id", page_of_rank(F.col("seq"), page_rows).alias("page"))
        .agg(ordered_list(item, F.col("seq")).alias("messages"))
        .withColumnRenamed("conversation_id", "id")
    )
    return attach_pages(conversations, pages, messages.select(F.col("conversation_id").alias("id")), "messages")
