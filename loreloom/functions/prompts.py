"""Source structs, context, history and prompt text for a chat exchange.

The arrays these work on are bounded by the query: k sources, N history messages.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.text import default_if_empty, prefix, truncate
from loreloom.functions.vectors import similarity_from_distance

SYSTEM_TEXT = (
    "Answer strictly from the numbered sources below and mark every claim with its "
    "label, such as [S1]. When the sources do not hold the answer, name what is missing."
)
SOURCE_TYPE = (
    "array<struct<document_id:bigint,document_title:string,chunk_id:string,chunk_index:int,"
    "content:string,score:double,similarity_score:double>>"
)


def source_struct(document_id, document_title, chunk_id, chunk_index, content, distance) -> Column:
    score = similarity_from_distance(distance)
    return F.struct(
        document_id.alias("document_id"),
        document_title.alias("document_title"),
        chunk_id.alias("chunk_id"),
        chunk_index.alias("chunk_index"),
        truncate(content, K.SOURCE_CHARS).alias("content"),
        score.alias("score"),
        score.alias("similarity_score"),
    )


def citation(index: Column) -> Column:
    """Label of the 0-based ``index``-th source."""
    return F.concat(F.lit("[S"), (index + 1).cast("string"), F.lit("]"))


def context_text(sources: Column) -> Column:
    blocks = F.transform(
        sources,
        lambda s, i: F.concat(
            citation(i), F.lit(" Document: "), s["document_title"],
            F.lit("\nChunk: "), s["chunk_index"].cast("string"),
            F.lit("\n"), s["content"],
        ),
    )
    return truncate(F.array_join(blocks, "\n\n"), K.CONTEXT_CHARS)


def history_text(messages: Column) -> Column:
    """'role: content' lines, oldest first; messages without content are left out."""
    filled = F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")
    lines = F.transform(filled, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return truncate(F.array_join(lines, "\n"), K.HISTORY_CHARS)


def user_prompt(question: Column, context: Column, history: Column) -> Column:
    return F.concat(
        F.lit(K.HISTORY_HEADING), default_if_empty(history, K.NO_HISTORY),
        F.lit("\n\n" + K.CONTEXT_HEADING), default_if_empty(context, K.NO_CONTEXT),
        F.lit("\n\n" + K.QUESTION_HEADING), question,
    )


def prompt_messages(question: Column, context: Column, history: Column) -> Column:
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(SYSTEM_TEXT)),
        message("user", user_prompt(question, context, history)),
    )


def fallback_answer(question: Column, sources: Column) -> Column:
    """Answer made of the leading excerpts, used when no model answers."""
    leading = F.slice(sources, 1, K.FALLBACK_SOURCES)
    labels = F.array_join(F.transform(leading, lambda s, i: citation(i)), ", ")
    excerpts = F.array_join(
        F.transform(
            leading,
            lambda s, i: F.concat(
                citation(i), F.lit(" "), s["document_title"], F.lit(": "),
                truncate(s["content"], K.EXCERPT_CHARS),
            ),
        ),
        "\n\n",
    )
    found = F.concat(
        F.lit(K.ANSWER_START), question,
        F.lit(K.ANSWER_MIDDLE), labels, F.lit(".\n\n"), excerpts,
    )
    return F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, F.lit(K.NO_SOURCES_ANSWER)).otherwise(found)


MEMORY_START = (
    "Read this exchange. If it states a lasting fact or preference of the user, reply with a JSON "
    "object holding 'title', 'content' and 'category' (fact, preference or note); otherwise reply {}."
    "\n\nUser: "
)
MEMORY_MIDDLE = "\nAssistant: "
DIGEST_START = (
    "Write a short daily summary, under 150 words, of what this user is working on, "
    "and suggest one or two next steps.\n\nRecent Documents: "
)
DIGEST_MIDDLE = "\nRecent Memories: "


def conversation_title(message: Column) -> Column:
    return prefix(message, K.CONVERSATION_TITLE_CHARS)


def memory_prompt(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(MEMORY_START), question, F.lit(MEMORY_MIDDLE), answer)


def digest_prompt(document_titles: Column, memory_titles: Column) -> Column:
    return F.concat(F.lit(DIGEST_START), document_titles, F.lit(DIGEST_MIDDLE), memory_titles)
