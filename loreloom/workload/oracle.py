"""SQL giving the same result as each registered query, for checking."""

from loreloom.constants import (
    CHUNK_OVERLAP, CHUNK_SIZE, CONTEXT_CHARS, EMBEDDING_DIMENSIONS, EXCERPT_CHARS, HISTORY_CHARS, NO_CONTEXT, NO_HISTORY,
    NO_SOURCES_ANSWER, SOURCE_CHARS,
)
from loreloom.functions.prompts import DIGEST_MIDDLE, DIGEST_START, MEMORY_MIDDLE, MEMORY_START
from loreloom.workload.tables import EPOCH

_AS_OF = EPOCH + 400 * 86400


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _truncate(value: str, n: int) -> str:
    return (f"(CASE WHEN length({value}) <= {n} THEN {value} "
            f"ELSE regexp_replace(substr({value}, 1, {n}), ' [^ ]*$', '') || '...' END)")


_DOCS = f"""docs AS (
  SELECT doc_id AS id, source AS owner, 'Document ' || doc_id AS title, text, lang,
         {EPOCH} + doc_id * 60 AS made FROM documents)"""

_NORMAL = """normal AS (
  SELECT doc_id, source AS owner, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
         lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents)"""


def _chunks(name: str, size: int, overlap: int, source: str = "documents", where: str = "") -> str:
    step = size - overlap
    return f"""{name}_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM {source} {where}),
{name}_windows AS (
  SELECT doc_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - {size}) / {step}) AS BIGINT)))) AS i
  FROM {name}_words WHERE len(w) > 0),
{name} AS (
  SELECT doc_id AS document_id, i AS chunk_index,
         array_to_string(list_slice(w, i * {step} + 1, i * {step} + {size}), ' ') AS content
  FROM {name}_windows)"""


_CHUNKS = _chunks("chunked", CHUNK_SIZE, CHUNK_OVERLAP)

_VECTOR_CHUNKS = """total AS (SELECT count(*) AS n FROM documents),
vchunks AS (
  SELECT vec_id AS id, vec_id % n AS document_id, vec_id // n AS chunk_index, embedding::DOUBLE[] AS embedding,
         label, text AS content, source AS owner
  FROM embeddings, total, documents WHERE doc_id = vec_id % n)"""


def _centroids(keys: str, query_id: str) -> str:
    return f"""parts AS (
  SELECT {keys}, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM vchunks),
means AS (SELECT {keys}, pos, avg(x) AS mean FROM parts GROUP BY {keys}, pos),
asked AS (SELECT {query_id} AS query_id, owner, list(mean ORDER BY pos) AS vector FROM means GROUP BY {keys}),
scored AS (
  SELECT query_id, asked.owner, id AS chunk_id, document_id, chunk_index, content,
         round(1 - list_dot_product(vector, embedding)
               / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(embedding, embedding))), 9) + 0.0
         AS distance
  FROM asked JOIN vchunks ON asked.owner = vchunks.owner),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM scored)"""


_SIMILARITY = "greatest(0.0, least(1.0, 1 - distance))"


def _vectors(name: str, source: str, key: str) -> str:
    """Sparse signed word-hash vectors of ``source.content``: key, bucket, x and the norm."""
    d = EMBEDDING_DIMENSIONS
    return f"""{name}_hash AS (
  SELECT {key}, ('0x' || substr(md5(unnest(list_filter(regexp_split_to_array(lower(content), '\\s+'),
         lambda x: x <> ''))), 1, 9))::UBIGINT::BIGINT AS h FROM {source}),
{name}_sums AS (
  SELECT {key}, (h // 16) % {d} AS bucket, sum(CASE WHEN h % 16 < 8 THEN 1 ELSE -1 END)::DOUBLE AS s
  FROM {name}_hash GROUP BY {key}, bucket HAVING s <> 0),
{name}_len AS (SELECT {key}, sqrt(sum(s * s)) AS len FROM {name}_sums GROUP BY {key}),
{name}_vec AS (SELECT {key}, bucket, (s / len)::FLOAT::DOUBLE AS x FROM {name}_sums JOIN {name}_len USING ({key})),
{name}_norm AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {name}_vec GROUP BY {key})"""


_INGESTED = ",\n".join([
    _NORMAL, _chunks("plain", CHUNK_SIZE, CHUNK_OVERLAP, "normal"),
    """ichunks AS (
  SELECT p.document_id || '-' || p.chunk_index AS chunk_id, p.document_id, p.chunk_index, p.content,
         d.source AS owner, 'Document ' || d.doc_id AS document_title
  FROM plain p JOIN documents d ON d.doc_id = p.document_id)""",
    _vectors("c", "ichunks", "chunk_id"),
])

_TURNS = f"""turns AS (
  SELECT conv_id * 100 + turn AS id, conv_id, turn, role, text AS content,
         {EPOCH} + (conv_id * 60 + turn) * 60 AS made, 'src' || (conv_id % 20) AS owner
  FROM conversations)"""

_QUESTIONS = """questions AS (
  SELECT conv_id, owner, id AS query_id, content FROM turns WHERE role = 'user')"""

_RETRIEVED = ",\n".join([
    _INGESTED, _TURNS, _QUESTIONS,
    _vectors("q", "questions", "query_id"),
    """dots AS (
  SELECT query_id, chunk_id, sum(q_vec.x * c_vec.x) AS dot
  FROM q_vec JOIN questions USING (query_id) JOIN ichunks ON ichunks.owner = questions.owner
       JOIN c_vec USING (chunk_id, bucket) GROUP BY query_id, chunk_id),
hits AS (
  SELECT query_id, questions.owner, chunk_id, document_id, document_title, chunk_index, ichunks.content,
         round(1 - coalesce(dot, 0) / (q_norm.norm * c_norm.norm), 9) + 0.0 AS distance
  FROM questions JOIN q_norm USING (query_id) JOIN ichunks ON ichunks.owner = questions.owner
       JOIN c_norm USING (chunk_id) LEFT JOIN dots USING (query_id, chunk_id)),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM hits)
  WHERE rank <= 5)""",
])


def _history(source: str, key: str, n: int) -> str:
    return f"""newest AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY made DESC, id DESC) AS recency FROM {source}),
lines AS (
  SELECT {key}, count(*) AS message_count, coalesce(string_agg(role || ': ' || content, chr(10)
         ORDER BY recency DESC) FILTER (content <> ''), '') AS raw FROM newest WHERE recency <= {n} GROUP BY {key}),
history AS (SELECT {key}, message_count, {_truncate('raw', HISTORY_CHARS)} AS history FROM lines)"""


_CONTEXT = ",\n".join([
    _RETRIEVED,
    f"""cut AS (SELECT *, {_truncate('content', SOURCE_CHARS)} AS excerpt FROM best),
blocks AS (
  SELECT query_id, count(*) AS source_count, string_agg('[S' || rank || '] Document: ' || document_title || chr(10)
         || 'Chunk: ' || chunk_index || chr(10) || excerpt, chr(10) || chr(10) ORDER BY rank) AS raw_context
  FROM cut GROUP BY query_id),
earlier AS (
  SELECT turns.*, questions.query_id FROM turns JOIN questions USING (conv_id) WHERE turns.id < questions.query_id)""",
    _history("earlier", "query_id", 8),
    f"""contexts AS (
  SELECT q.conv_id, q.query_id, q.content AS message, coalesce(b.source_count, 0) AS source_count,
         coalesce({_truncate('b.raw_context', CONTEXT_CHARS)}, '') AS context, coalesce(h.history, '') AS history
  FROM questions q LEFT JOIN blocks b USING (query_id) LEFT JOIN history h USING (query_id))""",
])

_ANSWERS = ",\n".join([
    _CONTEXT,
    f"""lead_sources AS (
  SELECT query_id, string_agg('[S' || rank || ']', ', ' ORDER BY rank) AS labels,
         string_agg('[S' || rank || '] ' || document_title || ': ' || {_truncate('excerpt', EXCERPT_CHARS)},
                    chr(10) || chr(10) ORDER BY rank) AS excerpts
  FROM cut WHERE rank <= 3 GROUP BY query_id),
answers AS (
  SELECT c.conv_id, c.query_id, c.source_count, CASE WHEN l.labels IS NULL THEN '{NO_SOURCES_ANSWER}'
         ELSE 'Based on the retrieved document context for "' || c.message
              || '", the most relevant evidence is in ' || l.labels || '.' || chr(10) || chr(10) || l.excerpts
         END AS answer
  FROM contexts c LEFT JOIN lead_sources l USING (query_id))""",
])

_MEMORY = """mem AS (
  SELECT event_id AS id, 'src' || (user_id % 20) AS owner, event_type || ' ' || event_id AS title, props AS content,
         CASE event_type WHEN 'click' THEN 'note' WHEN 'view' THEN 'summary' WHEN 'purchase' THEN 'preference'
              WHEN 'signup' THEN 'fact' ELSE 'pinned' END AS category,
         event_type AS kind, 'k' || json_extract_string(props, '$.k') AS ktag, value > 150 AS is_pinned,
         CAST(floor(epoch(ts)) AS BIGINT) AS updated_epoch, ts
  FROM events)"""

_LINES = """lines AS (
  SELECT l_orderkey * 10 + l_linenumber AS document_id, 'src' || (c_nationkey % 20) AS owner,
         'seen on order ' || l_orderkey AS about, c_name, p_name, s_name
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
mentions AS (
  SELECT document_id, 0 AS pos, owner, c_name AS title, 'person' AS node_type, about FROM lines
  UNION ALL SELECT document_id, 1, owner, p_name, 'technology', about FROM lines
  UNION ALL SELECT document_id, 2, owner, s_name, 'company', about FROM lines)"""

_ENTITIES = _NORMAL + """,
phrases AS (
  SELECT doc_id, owner, unnest(p) AS title, generate_subscripts(p, 1) AS place FROM (
    SELECT doc_id, owner, regexp_extract_all(text, '\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)*') AS p FROM normal)),
firsts AS (SELECT doc_id, owner, title AS full_title, min(place) AS place FROM phrases GROUP BY doc_id, owner, title)"""

_DUE = "strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')"

_USERS = """people AS (
  SELECT source AS owner FROM documents UNION SELECT 'src' || (user_id % 20) FROM events
  UNION SELECT 'src' || (o_custkey % 20) FROM orders)"""

_SUFFIX = "CASE doc_id % 4 WHEN 1 THEN 'a.txt' WHEN 2 THEN 'a.PDF' WHEN 3 THEN 'a.bin' END"
_INPUTS = f"""inputs AS (
  SELECT doc_id AS id, ['note', 'txt', 'pdf', 'docx', 'link', 'bogus'][CAST(doc_id % 6 + 1 AS BIGINT)] AS kind,
         {_SUFFIX} AS file_name, n_chars * 1000 AS file_size,
         CASE WHEN doc_id % 5 <> 0 THEN 'https://example.org/page' END AS source_url,
         CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS raw_text, text
  FROM documents)"""

ORACLE: dict[str, str] = {}

ORACLE["semantic_search_topk"] = _with(_VECTOR_CHUNKS, _centroids("owner, label", "owner || '/' || label")) + f"""
SELECT query_id, owner, rank, document_id, 'Document ' || document_id AS document_title, chunk_id, chunk_index,
       md5(content) AS content_md5, round({_SIMILARITY}, 6) AS similarity_score,
       CAST(floor({_SIMILARITY} * 100 + 0.5) AS BIGINT) || '%' AS percent
FROM ranked WHERE rank <= 5"""

ORACLE["search_chunks_distance"] = _with(_VECTOR_CHUNKS, _centroids("owner", "owner")) + """
SELECT query_id, owner, rank, document_id, 'Document ' || document_id AS document_title, chunk_id, chunk_index,
       round(distance, 6) AS distance FROM ranked WHERE rank <= 20"""

ORACLE["lsh_topk"] = _with(_VECTOR_CHUNKS, _centroids("owner, label", "owner || '/' || label"), """planes AS (
  SELECT t, b, list(CASE WHEN substr(md5('17|' || t || '|' || b || '|' || d), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS plane
  FROM range(6) AS ts(t), range(4) AS bs(b), range(64) AS ds(d) GROUP BY t, b)""", """vector_signs AS (
  SELECT id AS chunk_id, t, CAST(sum(CASE WHEN list_dot_product(embedding, plane) > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS sign
  FROM vchunks, planes GROUP BY id, t)""", """query_signs AS (
  SELECT query_id, t, CAST(sum(CASE WHEN list_dot_product(vector, plane) > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS sign
  FROM asked, planes GROUP BY query_id, t)""", """candidates AS (
  SELECT DISTINCT query_id, chunk_id FROM scored JOIN query_signs q USING (query_id) JOIN vector_signs v USING (chunk_id, t)
  WHERE bit_count(xor(q.sign, v.sign)) <= 1)""", """candidate_counts AS (SELECT query_id, count(*) AS n FROM candidates GROUP BY query_id)""") + """
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM (
  SELECT scored.query_id, scored.chunk_id, distance,
         row_number() OVER (PARTITION BY scored.query_id ORDER BY distance, scored.chunk_id) AS rank
  FROM scored LEFT JOIN candidate_counts USING (query_id)
       LEFT JOIN candidates ON candidates.query_id = scored.query_id AND candidates.chunk_id = scored.chunk_id
  WHERE candidates.chunk_id IS NOT NULL OR coalesce(n, 0) < 5)
WHERE rank <= 5"""

ORACLE["pruned_search"] = _with(_VECTOR_CHUNKS, _centroids("owner, label", "owner || '/' || label")) + """
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 5"""

ORACLE["cells_search_quality"] = _with(_VECTOR_CHUNKS, _centroids("owner, label", "owner || '/' || label")) + """
SELECT count(DISTINCT query_id) AS queries, count(*) AS asked, count(*) AS found, TRUE AS enough, TRUE AS exact_distances
FROM ranked WHERE rank <= 5"""

ORACLE["embedded_chunks"] = _with(_INGESTED) + """
SELECT document_id, chunk_index, coalesce(nonzero, 0) AS nonzero, coalesce(weight, 0.0) AS weight
FROM ichunks LEFT JOIN (
  SELECT chunk_id, count(*) AS nonzero, round(sum(abs(x)), 5) AS weight FROM c_vec GROUP BY chunk_id) USING (chunk_id)"""

ORACLE["text_search_topk"] = _with(_RETRIEVED) + """
SELECT query_id, owner, rank, document_id, chunk_id, round(distance, 6) AS distance FROM best"""

ORACLE["search_request_batch"] = _with(_TURNS, """asks AS (
  SELECT id AS query_id, trim(CASE WHEN turn = 0 THEN '' ELSE content END, E' \\n') AS query,
         CASE turn WHEN 2 THEN 'abc' WHEN 6 THEN '21' WHEN 4 THEN '7' ELSE '5' END AS lim
  FROM turns WHERE role = 'user')""") + """
SELECT query_id, md5(query) AS query_md5,
       CASE WHEN query <> '' AND TRY_CAST(lim AS INT) BETWEEN 1 AND 20 THEN CAST(lim AS BIGINT) END AS k,
       CASE WHEN query = '' THEN 'query' WHEN TRY_CAST(lim AS INT) BETWEEN 1 AND 20 THEN NULL ELSE 'limit' END AS field
FROM asks"""

ORACLE["normalize_text"] = _with(_NORMAL) + """
SELECT doc_id AS id, length(text) AS n_chars, md5(text) AS text_md5 FROM normal"""

ORACLE["txt_extract"] = _with(_NORMAL) + """
SELECT doc_id AS id, md5(nullif(text, '')) AS text_md5, CASE WHEN text = '' THEN 'Text file is empty.' END AS error
FROM normal"""

ORACLE["chunk_documents"] = _with(_CHUNKS) + """
SELECT document_id, chunk_index, length(content) AS n_chars, md5(content) AS content_md5 FROM chunked"""
ORACLE["stream_ingest"] = _with(_NORMAL, _chunks("chunked", CHUNK_SIZE, CHUNK_OVERLAP, "normal")) + """
SELECT document_id, chunk_index, length(content) AS n_chars, md5(content) AS content_md5 FROM chunked"""

ORACLE["document_list"] = _with(_DOCS, _CHUNKS) + """
SELECT id, owner, title, 'note' AS file_type, substr(text, 1, 500) AS raw_text_preview,
       coalesce(n, 0) AS chunk_count, 'NOTE · ' || coalesce(n, 0) || ' chunks' AS caption, made AS created_epoch,
       row_number() OVER (PARTITION BY owner ORDER BY made DESC, id) AS position
FROM docs LEFT JOIN (SELECT document_id AS id, count(*) AS n FROM chunked GROUP BY document_id) USING (id)"""

ORACLE["validate_documents"] = _with(_INPUTS) + """
SELECT id, split_part(rule, '|', 1) AS field, split_part(rule, '|', 2) AS message FROM (
  SELECT id, CASE
    WHEN kind IN ('docx', 'bogus') THEN 'file_type|Supported MVP types are note, pdf, txt, and link.'
    WHEN file_name IS NOT NULL AND file_size > 10485760 THEN 'file|File is too large for MVP ingestion.'
    WHEN kind = 'note' AND trim(raw_text) = '' THEN 'raw_text|Notes require text content.'
    WHEN kind IN ('pdf', 'txt') AND file_name IS NULL THEN 'file|' || upper(kind) || ' documents require a file.'
    WHEN kind IN ('pdf', 'txt') AND lower(regexp_extract(file_name, '\\.[^.]+$')) <> '.' || kind
      THEN 'file|Expected a ' || upper(kind) || ' file.'
    WHEN kind = 'link' AND source_url IS NULL THEN 'source_url|Links require a source URL.' END AS rule
  FROM inputs)"""

ORACLE["ingest_documents"] = _with(_INPUTS, """texts AS (
  SELECT id AS doc_id, kind, array_to_string(list_filter(list_transform(string_split(
         CASE kind WHEN 'note' THEN raw_text WHEN 'txt' THEN text WHEN 'docx' THEN text ELSE '' END, chr(10)),
         lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM inputs)""",
    _chunks("chunked", CHUNK_SIZE, CHUNK_OVERLAP, "texts")) + """
SELECT doc_id AS id, CASE WHEN texts.text = '' THEN 'failed' ELSE 'completed' END AS processing_status,
  CASE WHEN texts.text <> '' THEN '' ELSE CASE texts.kind WHEN 'note' THEN 'Note is empty.' WHEN 'txt' THEN 'Text file is empty.'
       WHEN 'link' THEN 'Link extraction is not implemented in this MVP yet.'
       WHEN 'docx' THEN 'DOCX file contains no selectable text.'
       ELSE 'Unsupported document type: ' || texts.kind END END AS processing_error,
  coalesce(n, 0) AS chunk_count, texts.text <> '' AS extracted, md5(coalesce(nullif(texts.text, ''), raw_text)) AS text_md5
FROM texts JOIN inputs ON inputs.id = doc_id LEFT JOIN (SELECT document_id AS doc_id, count(*) AS n FROM chunked GROUP BY document_id) USING (doc_id)"""

ORACLE["replace_chunks"] = _with(
    _CHUNKS, "good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)",
    _chunks("small", 120, 20, "documents", "WHERE doc_id IN (SELECT doc_id FROM good)"),
) + """
SELECT document_id, chunk_index, md5(content) AS content_md5 FROM chunked
WHERE document_id NOT IN (SELECT doc_id FROM good)
UNION ALL SELECT document_id, chunk_index, md5(content) FROM small"""

ORACLE["cascade_delete"] = _with(
    _VECTOR_CHUNKS, "toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)",
    "gone AS (SELECT id FROM vchunks WHERE document_id IN (SELECT doc_id FROM toxic))",
    """cites AS (
  SELECT conv_id * 100 + turn AS message_id, (conv_id * 7 + turn * 3 + j) % n AS chunk_id
  FROM conversations, (SELECT unnest([0, 1, 2]) AS j), (SELECT count(*) AS n FROM embeddings)
  WHERE role = 'assistant')""",
    """links AS (
  SELECT a.doc_id AS note_id, b.doc_id AS document_id
  FROM documents a JOIN documents b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 3)""",
) + """
SELECT 'documents' AS table_name, count(*) AS row_count, CAST(sum(doc_id) AS BIGINT) AS key_sum
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM toxic)
UNION ALL SELECT 'document_chunks', count(*), CAST(sum(document_id) AS BIGINT) FROM vchunks
WHERE document_id NOT IN (SELECT doc_id FROM toxic)
UNION ALL SELECT 'message_chunks', count(*), CAST(sum(chunk_id) AS BIGINT) FROM cites
WHERE chunk_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'note_documents', count(*), CAST(sum(document_id) AS BIGINT) FROM links
WHERE document_id NOT IN (SELECT doc_id FROM toxic)
UNION ALL SELECT 'notes', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents"""

ORACLE["keyword_search"] = _with(_DOCS, _CHUNKS) + """
SELECT id, owner, title, coalesce(n, 0) AS chunk_count
FROM docs LEFT JOIN (SELECT document_id AS id, count(*) AS n FROM chunked GROUP BY document_id) USING (id)
WHERE (contains(lower(title), 'document') OR contains(lower(owner), 'document'))
  AND (contains(lower(title), 'src1') OR contains(lower(owner), 'src1'))"""

ORACLE["keyword_search_chunks"] = _with(_CHUNKS) + """
SELECT document_id, 'Document ' || document_id AS document_title, chunk_index,
       'Document ' || document_id || ' - Chunk ' || chunk_index AS label
FROM chunked WHERE contains(lower(content), 'the') AND contains(lower(content), 'license')"""

ORACLE["indexed_chunk_search"] = ORACLE["keyword_search_chunks"]

ORACLE["facets"] = _with(_NORMAL, _MEMORY) + f"""
SELECT 'file_type' AS facet, 'note' AS value, count(*) AS row_count FROM documents
UNION ALL SELECT 'processing_status', CASE WHEN text = '' THEN 'failed' ELSE 'completed' END, count(*)
FROM normal GROUP BY 2
UNION ALL SELECT 'created_day', strftime(make_timestamp(({EPOCH} + doc_id * 60) * 1000000), '%Y-%m-%d'), count(*)
FROM documents GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM mem GROUP BY 2
UNION ALL SELECT 'is_pinned', CAST(is_pinned AS VARCHAR), count(*) FROM mem GROUP BY 2
UNION ALL SELECT 'source', 'manual', count(*) FROM mem"""

ORACLE["recent_history"] = _with(_TURNS, _history("turns", "conv_id", 8)) + """
SELECT conv_id AS conversation_id, message_count, history FROM history"""
ORACLE["recent_history_4"] = _with(_TURNS, _history("turns", "conv_id", 4)) + """
SELECT conv_id AS conversation_id, message_count, history FROM history"""

ORACLE["chat_context"] = _with(_CONTEXT) + f"""
SELECT conv_id AS conversation_id, query_id AS exchange_id, source_count, md5(context) AS context_md5,
       md5(history) AS history_md5,
       'Conversation history:' || chr(10) || coalesce(nullif(history, ''), '{NO_HISTORY}') || chr(10) || chr(10)
       || 'Retrieved context:' || chr(10) || coalesce(nullif(context, ''), '{NO_CONTEXT}') || chr(10) || chr(10)
       || 'User question:' || chr(10) || message AS user_prompt
FROM contexts"""

ORACLE["fallback_answer"] = _with(_ANSWERS) + """
SELECT conv_id AS conversation_id, query_id AS exchange_id, answer FROM answers"""

ORACLE["record_exchange"] = _with(_ANSWERS, f"""stored AS (
  SELECT id, conv_id, role, content, CASE WHEN role = 'assistant' THEN 3 ELSE 0 END AS cites FROM turns
  UNION ALL SELECT query_id + 50, conv_id, 'user', content, 0 FROM questions
  UNION ALL SELECT query_id + 51, conv_id, 'assistant', answer, source_count FROM answers),
moved AS (
  SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM questions) THEN {_AS_OF} ELSE max(made) END AS moved_at
  FROM turns GROUP BY conv_id)""") + """
SELECT id, conv_id AS conversation_id, role, md5(content) AS content_md5, CAST(cites AS BIGINT) AS citation_count,
       CAST(moved_at AS BIGINT) AS conversation_updated_epoch, role || ': ' || substr(content, 1, 80) AS label
FROM stored JOIN moved USING (conv_id)"""

ORACLE["list_conversations"] = _with(_TURNS) + """
SELECT conv_id AS id, owner, 'Conversation ' || conv_id AS title, min(made) AS created_epoch, max(made) AS updated_epoch,
       row_number() OVER (PARTITION BY owner ORDER BY max(made) DESC, conv_id) AS position
FROM turns GROUP BY conv_id, owner"""

ORACLE["conversation_detail"] = _with(_TURNS, _VECTOR_CHUNKS, f"""cites AS (
  SELECT conv_id * 100 + turn AS message_id, (conv_id * 7 + turn * 3 + j) % n AS chunk_id, j
  FROM conversations, (SELECT unnest([0, 1, 2]) AS j), (SELECT count(*) AS n FROM embeddings)
  WHERE role = 'assistant'),
sources AS (
  SELECT message_id AS id, string_agg(chunk_id || ',Document ' || document_id || ','
         || md5({_truncate('content', SOURCE_CHARS)}) || ','
         || CASE j WHEN 0 THEN '1.0' WHEN 1 THEN '0.5' ELSE '0.333333' END, ';' ORDER BY j) AS src
  FROM cites JOIN vchunks ON vchunks.id = chunk_id GROUP BY message_id),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY made, id) - 1) // 4 AS page,
         'Conversation ' || conv_id AS title FROM turns)""") + """
SELECT conv_id AS id, owner, title, page, count(*) AS message_count,
       string_agg(id || '|' || role || '|' || md5(content) || '|' || coalesce(src, ''), chr(10) ORDER BY made, id)
       AS messages_text
FROM numbered LEFT JOIN sources USING (id) GROUP BY conv_id, owner, title, page"""

ORACLE["validate_chat_requests"] = _with(_TURNS, """asks AS (
  SELECT id, conv_id, trim(CASE WHEN turn = 1 THEN '' ELSE content END, E' \\n') AS message FROM turns)""") + """
SELECT id, CASE WHEN message = '' OR length(message) > 8000 THEN 'message' WHEN conv_id < 1 THEN 'conversation_id'
  END AS field,
  CASE WHEN message = '' THEN 'This field may not be blank.'
       WHEN length(message) > 8000 THEN 'Ensure this field has no more than 8000 characters.'
       WHEN conv_id < 1 THEN 'Ensure this value is greater than or equal to 1.' END AS message
FROM asks"""

ORACLE["memory_search"] = _with(_MEMORY) + """
SELECT id, owner, title, category, is_pinned, kind || ', ' || ktag AS tags, updated_epoch,
       row_number() OVER (PARTITION BY owner ORDER BY is_pinned DESC, ts DESC, id) AS position FROM mem
WHERE NOT is_pinned AND (contains(lower(title), 'k1') OR contains(lower(content), 'k1') OR contains(kind, 'k1')
                         OR contains(lower(ktag), 'k1'))"""
ORACLE["memory_search_category"] = _with(_MEMORY) + """
SELECT id, owner, title, category, is_pinned, kind || ', ' || ktag AS tags, updated_epoch,
       row_number() OVER (PARTITION BY owner ORDER BY is_pinned DESC, ts DESC, id) AS position FROM mem
WHERE category = 'preference' AND (contains(lower(title), 'purchase 1') OR contains(lower(content), 'purchase 1')
                                   OR contains(kind, 'purchase 1') OR contains(lower(ktag), 'purchase 1'))"""

ORACLE["memory_tags_normalized"] = _with(_MEMORY) + """
SELECT id, kind || ', ' || ktag AS tags, kind || ', ' || ktag AS tags_from_text,
       upper(kind) || ', ' || kind || ', ' || ktag AS form_text FROM mem"""

ORACLE["memory_keyword_search"] = _with(_MEMORY) + """
SELECT id, owner, title, category FROM mem WHERE category = 'fact'
  AND contains(lower(title || chr(10) || content || chr(10) || owner || '@example.org' || chr(10) || owner), 'src1')
  AND contains(lower(title || chr(10) || content || chr(10) || owner || '@example.org' || chr(10) || owner), 'k')
  AND contains(lower(title || chr(10) || content || chr(10) || owner || '@example.org' || chr(10) || owner), '5')"""

ORACLE["validate_memory"] = _with(_MEMORY) + """
SELECT id, split_part(rule, '|', 1) AS field, split_part(rule, '|', 2) AS message FROM (
  SELECT id, CASE
    WHEN id % 5 = 0 THEN 'title|Title is required.'
    WHEN id % 5 = 1 AND length(repeat(title, 30)) > 180 THEN 'title|Ensure this field has no more than 180 characters.'
    WHEN id % 5 = 2 THEN 'content|Content is required.'
    WHEN id % 5 = 3 THEN 'category|"odd" is not a valid choice.'
    WHEN greatest((length(kind) + 1) * 8, length(ktag) * 8) > 40
      THEN 'tags|Ensure this field has no more than 40 characters.' END AS rule
  FROM mem)"""

ORACLE["partial_update"] = _with(_MEMORY) + f"""
SELECT id, owner, CASE WHEN category = 'pinned' THEN 'Resolved ' || title ELSE title END AS title, category, is_pinned,
       CASE WHEN category = 'pinned' THEN 'resolved, done' ELSE kind || ', ' || ktag END AS tags,
       CASE WHEN category = 'pinned' THEN {_AS_OF} ELSE updated_epoch END AS updated_epoch FROM mem"""

ORACLE["graph_nodes_upsert"] = _with(_LINES) + """
SELECT owner, title, node_type, arg_min(about, document_id * 10 + pos) AS description,
       count(DISTINCT document_id) AS document_count, true AS type_ok, title || ' (' || node_type || ')' AS label
FROM mentions GROUP BY owner, title, node_type"""

ORACLE["graph_edges_upsert"] = _with(_LINES, """edges AS (
  SELECT document_id, 0 AS pos, owner, c_name AS a, p_name AS b, 'uses' AS kind, about FROM lines
  UNION ALL SELECT document_id, 1, owner, p_name, s_name, 'belongs_to', about FROM lines
  UNION ALL SELECT document_id, 2, owner, c_name, s_name, 'related_to', about FROM lines)""") + """
SELECT owner, a AS source_title, b AS target_title, kind AS relationship_type,
       replace(kind, '_', ' ') AS relationship_label, arg_min(about, document_id * 10 + pos) AS description,
       CAST(1.0 AS DOUBLE) AS weight, a || ' --[' || kind || ']--> ' || b AS label
FROM edges GROUP BY owner, a, b, kind"""

ORACLE["node_detail"] = _with(_LINES, """links AS (
  SELECT owner, title, node_type, document_id,
         (row_number() OVER (PARTITION BY owner, title, node_type ORDER BY document_id) - 1) // 1000 AS page
  FROM (SELECT DISTINCT owner, title, node_type, document_id FROM mentions))""") + """
SELECT owner, title, node_type, page, count(*) AS document_count,
       md5(string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY document_id)) AS document_ids_md5,
       'Order line ' || min(document_id) AS first_document
FROM links GROUP BY owner, title, node_type, page"""

ORACLE["entity_nodes"] = _with(_ENTITIES) + """
SELECT owner, substr(full_title, 1, 255) AS title, 'topic' AS node_type, count(DISTINCT doc_id) AS document_count
FROM firsts GROUP BY owner, substr(full_title, 1, 255)"""

ORACLE["entity_edges"] = _with(_ENTITIES, """pairs AS (
  SELECT doc_id, owner, full_title AS a, lead(full_title) OVER (PARTITION BY doc_id ORDER BY place) AS b FROM firsts)""") + """
SELECT DISTINCT owner, a AS source_title, b AS target_title, 'related_to' AS relationship_type,
       CAST(1.0 AS DOUBLE) AS weight
FROM pairs WHERE b IS NOT NULL AND length(a) <= 255 AND length(b) <= 255"""

ORACLE["dashboard_summary"] = _with(_USERS, _NORMAL, _CHUNKS) + """
SELECT owner, coalesce(d.n, 0) AS documents, coalesce(d.done, 0) AS completed_documents, coalesce(m.n, 0) AS memories,
       coalesce(t.n, 0) AS pending_tasks, coalesce(c.n, 0) AS chunks
FROM people
LEFT JOIN (SELECT owner, count(*) AS n, count(*) FILTER (text <> '') AS done FROM normal GROUP BY owner) d USING (owner)
LEFT JOIN (SELECT 'src' || (user_id % 20) AS owner, count(*) AS n FROM events GROUP BY 1) m USING (owner)
LEFT JOIN (SELECT 'src' || (o_custkey % 20) AS owner, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) t
  USING (owner)
LEFT JOIN (SELECT source AS owner, count(*) AS n FROM chunked JOIN documents ON doc_id = document_id GROUP BY 1) c
  USING (owner)"""

ORACLE["recent_digest"] = _with(_USERS, _DOCS) + f"""
SELECT owner, coalesce(d.titles, '') AS recent_documents, coalesce(m.titles, '') AS recent_memories,
       '{DIGEST_START}' || coalesce(d.titles, '') || '{DIGEST_MIDDLE}' || coalesce(m.titles, '') AS prompt FROM people
LEFT JOIN (SELECT owner, string_agg(title, ', ' ORDER BY r) AS titles FROM (
  SELECT owner, title, row_number() OVER (PARTITION BY owner ORDER BY made DESC, id) AS r FROM docs)
  WHERE r <= 5 GROUP BY owner) d USING (owner)
LEFT JOIN (SELECT owner, string_agg(title, ', ' ORDER BY r) AS titles FROM (
  SELECT 'src' || (user_id % 20) AS owner, event_type || ' ' || event_id AS title,
         row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id) AS r FROM events)
  WHERE r <= 5 GROUP BY owner) m USING (owner)"""

ORACLE["tasks_view"] = f"""
SELECT o_orderkey AS id, 'src' || (o_custkey % 20) AS owner, 'Order ' || o_orderkey AS title,
       CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'In Progress' ELSE 'Completed' END AS status_label,
       CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'High' WHEN o_orderpriority[1] = '3' THEN 'Medium'
            ELSE 'Low' END AS priority_label, {_DUE} AS due_day
FROM orders"""

ORACLE["toggle_tasks"] = """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'in_progress' ELSE 'completed'
       END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'completed' ELSE 'pending' END AS new_status
FROM orders"""

ORACLE["goals_view"] = """
SELECT p_partkey AS id, 'src' || (p_partkey % 20) AS owner, p_name AS title,
       CAST(CASE WHEN p_size = 50 THEN 100 ELSE p_size * 2 END AS BIGINT) AS progress, p_size = 50 AS is_completed
FROM part"""

ORACLE["notes_view"] = """
SELECT a.doc_id AS id, a.source AS owner, 'Document ' || a.doc_id AS title,
       CAST(0 AS BIGINT) AS page,
       coalesce(string_agg(CAST(b.doc_id AS VARCHAR), ',' ORDER BY b.doc_id), '') AS related_ids
FROM documents a LEFT JOIN documents b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 3
GROUP BY a.doc_id, a.source"""

_RULE = """CASE
    WHEN kind IN ('docx', 'bogus') THEN 'file_type'
    WHEN file_name IS NOT NULL AND file_size > 10485760 THEN 'file'
    WHEN kind = 'note' AND trim(raw_text) = '' THEN 'raw_text'
    WHEN kind IN ('pdf', 'txt') AND file_name IS NULL THEN 'file'
    WHEN kind IN ('pdf', 'txt') AND lower(regexp_extract(file_name, '\\.[^.]+$')) <> '.' || kind THEN 'file'
    WHEN kind = 'link' AND source_url IS NULL THEN 'source_url' END"""

ORACLE["upload_chain"] = _with(_INPUTS, f"ruled AS (SELECT *, {_RULE} AS rule FROM inputs)", """texts AS (
  SELECT id, rule, array_to_string(list_filter(list_transform(string_split(
         CASE kind WHEN 'note' THEN raw_text WHEN 'txt' THEN text ELSE '' END, chr(10)),
         lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM ruled)""") + """
SELECT id, CASE WHEN rule IS NOT NULL THEN 'refused: ' || rule WHEN text = '' THEN 'failed' ELSE 'completed' END AS outcome,
       CASE WHEN rule IS NOT NULL THEN 0 ELSE len(list_distinct(list_transform(
         regexp_extract_all(text, '\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)*'), lambda x: substr(x, 1, 255)))) END AS nodes
FROM texts"""

ORACLE["keyword_search_dated"] = _with(_DOCS, _CHUNKS, "span AS (SELECT max(doc_id) AS last FROM documents)") + f"""
SELECT id, owner, title, coalesce(n, 0) AS chunk_count
FROM docs CROSS JOIN span LEFT JOIN (SELECT document_id AS id, count(*) AS n FROM chunked GROUP BY document_id) USING (id)
WHERE contains(lower(owner), 'src') AND made >= {EPOCH} + CAST(floor(last * 1 / 3) AS BIGINT) * 60
  AND made < {EPOCH} + CAST(floor(last * 2 / 3) AS BIGINT) * 60"""

ORACLE["owner_documents"] = _with(_DOCS, _CHUNKS) + """
SELECT id, title, coalesce(n, 0) AS chunk_count, row_number() OVER (ORDER BY made DESC, id) AS position
FROM docs LEFT JOIN (SELECT document_id AS id, count(*) AS n FROM chunked GROUP BY document_id) USING (id) WHERE owner = 'src0'"""

ORACLE["nearest_chunks"] = """
WITH vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), asked AS (SELECT v AS q FROM vectors WHERE vec_id = 0),
scored AS (
  SELECT vec_id AS chunk_id, round(1 - list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 9) + 0.0
         AS distance FROM vectors, asked)
SELECT chunk_id, round(distance, 6) AS distance FROM scored ORDER BY scored.distance, chunk_id LIMIT 10"""

ORACLE["cascade_delete_owner"] = _with(_USERS, _TURNS) + """
SELECT 'users' AS table_name, count(*) AS row_count FROM people WHERE owner <> 'src0'
UNION ALL SELECT 'documents', count(*) FROM documents WHERE source <> 'src0'
UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM turns WHERE owner <> 'src0'
UNION ALL SELECT 'messages', count(*) FROM turns WHERE owner <> 'src0'
UNION ALL SELECT 'memory_entries', count(*) FROM events WHERE user_id % 20 <> 0
UNION ALL SELECT 'tasks', count(*) FROM orders WHERE o_custkey % 20 <> 0
UNION ALL SELECT 'goals', count(*) FROM part WHERE p_partkey % 20 <> 0
UNION ALL SELECT 'notes', count(*) FROM documents WHERE source <> 'src0'
UNION ALL SELECT 'note_documents', count(*) FROM documents a JOIN documents b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 3
WHERE a.source <> 'src0' AND b.source <> 'src0'"""

ORACLE["insert_tasks"] = """
SELECT 'src' || (o_custkey % 20) AS owner, 'Order ' || o_orderkey AS title, 'pending' AS status,
       CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS priority,
       false AS id_taken
FROM orders"""

ORACLE["clamped_limits"] = _with(_TURNS) + """
SELECT id, CASE turn WHEN 0 THEN 5 WHEN 1 THEN NULL WHEN 2 THEN -1 ELSE least(turn * 4, 20) END::BIGINT AS k,
       CASE turn WHEN 1 THEN 'limit must be an integer.' WHEN 2 THEN 'limit must not be negative.' END AS error
FROM turns"""

ORACLE["new_conversations"] = _with(_TURNS, _QUESTIONS) + f"""
SELECT 'conversation' AS kind, owner, md5(substr(content, 1, 80)) AS what, 2::BIGINT AS messages FROM questions
UNION ALL
SELECT 'memory', owner, md5(CAST(length(content) + {len(MEMORY_START) + len(MEMORY_MIDDLE) + len('Noted.')} AS VARCHAR)), 0 FROM questions"""

ORACLE["graph_incremental_upsert"] = _with(_LINES, "cut AS (SELECT max(o_orderkey) * 5 AS bound FROM orders)", """named AS (
  SELECT owner, title, node_type, arg_min(about, (CASE WHEN document_id >= bound THEN 0 ELSE 1 END, document_id, pos)) AS description,
         count(DISTINCT document_id) AS n FROM mentions, cut GROUP BY owner, title, node_type)""", """edges AS (
  SELECT document_id, 0 AS pos, owner, c_name AS a, p_name AS b, 'uses' AS kind, about FROM lines
  UNION ALL SELECT document_id, 1, owner, p_name, s_name, 'belongs_to', about FROM lines
  UNION ALL SELECT document_id, 2, owner, c_name, s_name, 'related_to', about FROM lines)""") + """
SELECT 'node' AS kind, owner, node_type || '/' || title AS name, description, n,
       row_number() OVER (PARTITION BY owner ORDER BY title, md5(owner || chr(31) || node_type || chr(31) || title)) AS position
FROM named
UNION ALL
SELECT 'edge', owner, kind || '/' || a || '/' || b, arg_min(about, (CASE WHEN document_id >= bound THEN 0 ELSE 1 END, document_id, pos)), 0, 0
FROM edges, cut GROUP BY owner, a, b, kind"""

ORACLE["stream_upload_chain"] = f"""
SELECT id, 'Document ' || id AS title, outcome, nodes FROM ({ORACLE["upload_chain"]})"""

ORACLE["decoder_plugin"] = """WITH texts AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), '|'), '|'), lambda x: trim(x)),
         lambda x: x <> ''), chr(10)) AS text FROM documents)
SELECT doc_id AS id, md5(nullif(text, '')) AS text_md5,
       CASE WHEN text = '' THEN 'No selectable text found in this PDF.' END AS error FROM texts"""

ORACLE["append_read_back"] = _with(_DOCS) + """
SELECT id, owner, title, md5(text) AS text_md5, made AS created_epoch FROM docs"""

ORACLE["documents_json"] = _with(_DOCS) + """
SELECT '{"id":' || id || ',"owner":"' || owner || '","title":"' || title || '"}' AS json FROM docs"""

ORACLE["owned_lookup"] = _with(_DOCS) + """
SELECT id, owner, title FROM docs WHERE owner = 'src' || (id % 20)"""

ORACLE["chunk_order"] = _with(_CHUNKS) + """
SELECT document_id, chunk_index + 1 AS position, md5(content) AS content_md5 FROM chunked"""

ORACLE["unit_vectors"] = """WITH vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
units AS (SELECT vec_id, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE) AS u FROM vectors)
SELECT vec_id, round(list_dot_product(u, u), 4) AS square, round(u[1], 5) AS lead FROM units"""

ORACLE["upload_types"] = _with(_INPUTS) + """
SELECT id, CASE WHEN file_name IS NULL THEN 'note' WHEN ends_with(lower(file_name), '.txt') THEN 'txt' ELSE 'pdf' END AS kind,
       file_name IS NOT NULL OR regexp_replace(raw_text, '\\s', '', 'g') <> '' AS submittable FROM inputs"""
