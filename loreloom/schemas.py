"""One StructType per table; readers never infer."""

from pyspark.sql import types as T

_long, _int, _str = T.LongType(), T.IntegerType(), T.StringType()
_ts, _bool, _dbl = T.TimestampType(), T.BooleanType(), T.DoubleType()


def _table(*columns):
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


VECTOR = T.ArrayType(T.FloatType(), False)

USERS = _table(("id", _str), ("username", _str), ("email", _str))
DOCUMENTS = _table(
    ("id", _long), ("owner", _str), ("title", _str), ("file", _str), ("file_type", _str),
    ("source_url", _str), ("raw_text", _str), ("processing_status", _str), ("processing_error", _str),
    ("extracted_at", _ts), ("source_checksum", _str), ("created_at", _ts), ("updated_at", _ts),
)
DOCUMENT_CHUNKS = _table(
    ("id", _str), ("owner", _str), ("document_id", _long), ("chunk_index", _int), ("content", _str),
    ("embedding", VECTOR), ("created_at", _ts),
)
CONVERSATIONS = _table(
    ("id", _long), ("owner", _str), ("title", _str), ("created_at", _ts), ("updated_at", _ts),
)
MESSAGES = _table(
    ("id", _long), ("conversation_id", _long), ("owner", _str), ("role", _str), ("content", _str), ("created_at", _ts),
)
MESSAGE_CHUNKS = _table(
    ("message_id", _long), ("owner", _str), ("chunk_id", _str), ("citation_rank", _int), ("score", _dbl),
)
MEMORY_ENTRIES = _table(
    ("id", _long), ("owner", _str), ("title", _str), ("content", _str), ("category", _str),
    ("tags", T.ArrayType(_str)), ("is_pinned", _bool), ("source", _str),
    ("created_at", _ts), ("updated_at", _ts),
)
NODES = _table(
    ("id", _str), ("owner", _str), ("title", _str), ("node_type", _str), ("description", _str),
    ("metadata", T.MapType(_str, _str)), ("created_at", _ts), ("updated_at", _ts),
)
NODE_DOCUMENTS = _table(("node_id", _str), ("owner", _str), ("document_id", _long))
EDGES = _table(
    ("id", _str), ("owner", _str), ("source_id", _str), ("target_id", _str),
    ("relationship_type", _str), ("description", _str), ("weight", _dbl), ("created_at", _ts),
)
NOTES = _table(
    ("id", _long), ("owner", _str), ("title", _str), ("content", _str),
    ("created_at", _ts), ("updated_at", _ts),
)
NOTE_DOCUMENTS = _table(("note_id", _long), ("owner", _str), ("document_id", _long))
TASKS = _table(
    ("id", _long), ("owner", _str), ("title", _str), ("description", _str), ("status", _str),
    ("priority", _str), ("due_date", _ts), ("created_at", _ts), ("updated_at", _ts),
)
GOALS = _table(
    ("id", _long), ("owner", _str), ("title", _str), ("description", _str), ("target_date", T.DateType()),
    ("progress", _int), ("is_completed", _bool), ("created_at", _ts), ("updated_at", _ts),
)

GRAPH_PAYLOAD = T.StructType([
    T.StructField("nodes", T.ArrayType(_table(("title", _str), ("type", _str), ("description", _str)))),
    T.StructField("edges", T.ArrayType(
        _table(("source", _str), ("target", _str), ("type", _str), ("description", _str)))),
])
MEMORY_CANDIDATE = _table(("title", _str), ("content", _str), ("category", _str))

TABLES = {
    "users": USERS, "documents": DOCUMENTS, "document_chunks": DOCUMENT_CHUNKS,
    "conversations": CONVERSATIONS, "messages": MESSAGES, "message_chunks": MESSAGE_CHUNKS,
    "memory_entries": MEMORY_ENTRIES, "nodes": NODES, "node_documents": NODE_DOCUMENTS, "edges": EDGES,
    "notes": NOTES, "note_documents": NOTE_DOCUMENTS, "tasks": TASKS, "goals": GOALS,
}
