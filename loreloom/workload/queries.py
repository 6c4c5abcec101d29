"""One function per registered query: (spark, sf_dir) -> DataFrame."""

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions import text as X
from loreloom.functions.tags import normalize_tags, tags_from_text, tags_to_text
from loreloom.functions.vectors import l2_normalize
from loreloom.operators import chunking, filters, graph, maintain, validation
from loreloom.operators.cells import cells_topk, indexed, pruned_topk, train_cells
from loreloom.operators.ordering import in_document_order
from loreloom.operators.postings import gram_index, search_index
from loreloom.operators.sizing import small_frame
from loreloom.operators.topk import approximate_topk, cosine_topk, nearest
from loreloom.plans import chat, views
from loreloom.plans.ingest import embed_chunks, ingest, ingest_uploads, process_documents, stored_processing, upsert_graph
from loreloom.plans.search import embed_queries, search_chunks, search_requests, semantic_search
from loreloom.session import shared_folder
from loreloom.sources.extraction import extract_text
from loreloom.sources.tables import append_table, as_json, read_table, stored
from loreloom.streaming.ingest import current_chunks, document_stream, start_ingest
from loreloom.streaming.uploads import current_graph, start_uploads, upload_outcomes
from loreloom.workload.tables import EPOCH, Tables


def _as_of():
    """A fixed run time keeps results reproducible."""
    return F.timestamp_seconds(F.lit(EPOCH + 400 * 86400))


def _seconds(column):
    return F.unix_seconds(column)


def _error_columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("error.field").alias("field"), F.col("error.message").alias("message"))


# ---- retrieval ---------------------------------------------------------------------------

def semantic_search_topk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hits = semantic_search(t.centroid_queries("label"), t.chunks(), t.documents())
    return hits.select(
        "query_id", "owner", F.col("rank").cast("bigint").alias("rank"), "document_id", "document_title", "chunk_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("content").alias("content_md5"),
        F.round("similarity_score", 6).alias("similarity_score"), X.percent(F.col("similarity_score")).alias("percent"),
    )


def search_chunks_distance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hits = search_chunks(t.centroid_queries(), t.chunks(), t.documents(), k=K.MAX_LIMIT)
    return hits.select(
        "query_id", "owner", F.col("rank").cast("bigint").alias("rank"), "document_id", "document_title", "chunk_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"), F.round("distance", 6).alias("distance"),
    )


def _embedded(t: Tables) -> DataFrame:
    """Whole documents normalised, chunked and embedded by the default embedder."""
    done = t.documents().withColumn("raw_text", X.normalize_text(F.col("raw_text")))
    chunks = chunking.chunk_documents(done, keep=("owner",)).withColumn(
        "id", chunking.chunk_id(F.col("document_id"), F.col("chunk_index")))
    return embed_chunks(chunks)


def _ingested_chunks(t: Tables) -> DataFrame:
    """The same as a stored table, which searches read several times."""
    return stored(_embedded(t), "chunks")


def _exchanges(t: Tables) -> DataFrame:
    """Every user message as an exchange, with its place in its conversation."""
    owners = t.conversations().select(F.col("id").alias("conversation_id"), "owner")
    return chat.asked_questions(t.messages()).join(owners, "conversation_id")


def embedded_chunks(spark, sf_dir):
    chunks = _embedded(Tables(spark, sf_dir))
    weight = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x))
    return chunks.select(
        "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("nonzero"),
        F.round(weight, 5).alias("weight"),
    )


def text_search_topk(spark, sf_dir):
    """Every question of every conversation, embedded and searched among its owner's chunks."""
    t = Tables(spark, sf_dir)
    asked = _exchanges(t).select(F.col("exchange_id").alias("query_id"), "owner", F.col("message").alias("query"))
    hits = search_chunks(embed_queries(asked), _ingested_chunks(t), t.documents())
    return hits.select(
        "query_id", "owner", F.col("rank").cast("bigint").alias("rank"), "document_id", "chunk_id",
        F.round("distance", 6).alias("distance"),
    )


def lsh_topk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    vectors = t.chunks().select(F.col("id").alias("chunk_id"), "owner", "embedding")
    found = approximate_topk(t.centroid_queries("label"), vectors, dimensions=64)
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"),
                        F.col("rank").cast("bigint").alias("rank"))


def _cells(spark, sf_dir):
    """Queries by owner and label, chunk vectors, and a trained index of them."""
    t = Tables(spark, sf_dir)
    vectors = t.chunks().select(F.col("id").alias("chunk_id"), "owner", "embedding")
    cells = train_cells(vectors)
    return t.centroid_queries("label"), vectors, cells, indexed(vectors, cells)


def pruned_search(spark, sf_dir):
    """Exact five nearest by the triangle inequality over trained cells."""
    queries, _, cells, index = _cells(spark, sf_dir)
    return pruned_topk(queries, index, cells).select(
        "query_id", "chunk_id", F.round("distance", 6).alias("distance"),
        F.col("rank").cast("bigint").alias("rank"))


def cells_search_quality(spark, sf_dir):
    """The approximate search over trained cells against the exact one: queries, hits asked for, hits found, and whether nine of
    ten exact hits are among them, all with their exact distances."""
    queries, vectors, cells, index = _cells(spark, sf_dir)
    exact = cosine_topk(queries, vectors).select("query_id", "chunk_id", F.col("distance").alias("true"))
    found = cells_topk(queries, index, cells).select("query_id", "chunk_id", "distance")
    both = exact.join(found, ["query_id", "chunk_id"], "full")
    hit = F.col("true").isNotNull() & F.col("distance").isNotNull()
    return both.agg(
        F.count_distinct("query_id").alias("queries"), F.count("true").alias("asked"), F.count("distance").alias("found"),
        (F.count_if(hit) >= F.count("true") * 0.9).alias("enough"),
        (F.count_if(hit & (F.abs(F.col("true") - F.col("distance")) > 1e-6)) == 0).alias("exact_distances"))


def search_request_batch(spark, sf_dir):
    """Every user message as a raw request; accepted ones with query and limit, refused ones with the rule."""
    t = Tables(spark, sf_dir)
    turn = F.col("id") % 100
    requests = t.messages().filter(F.col("role") == "user").select(
        F.col("id").alias("query_id"), F.lit("src0").alias("owner"),
        F.when(turn == 0, F.lit("  ")).when(turn == 2, F.col("content")).alias("body_query"),
        F.when(turn != 4, F.col("content")).alias("body_q"),
        F.lit(None).cast("string").alias("url_query"),
        F.when(turn == 4, F.col("content")).alias("url_q"),
        F.when(turn == 2, F.lit("abc")).when(turn == 6, F.lit("21")).alias("body_limit"),
        F.when(turn == 4, F.lit("7")).alias("url_limit"),
    )
    queries, refused = search_requests(requests)
    good = queries.select("query_id", F.md5("query").alias("query_md5"), F.col("k").cast("bigint").alias("k"),
                          F.lit(None).cast("string").alias("field"))
    return good.unionByName(refused.select("query_id", F.md5("query").alias("query_md5"),
                                           F.lit(None).cast("bigint").alias("k"), F.col("error.field").alias("field")))


# ---- documents ---------------------------------------------------------------------------

def normalize_text(spark, sf_dir):
    text = X.normalize_text(F.col("raw_text"))
    return Tables(spark, sf_dir).documents().select("id", text.alias("t")).select(
        "id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_md5"))


def txt_extract(spark, sf_dir):
    """Document bytes read as text files."""
    files = Tables(spark, sf_dir).raw("documents").select(
        F.col("doc_id").alias("id"), F.lit("txt").alias("file_type"), F.lit(None).cast("string").alias("raw_text"),
        F.encode("text", "UTF-8").alias("content"))
    return extract_text(files, {}).select("id", F.md5("text").alias("text_md5"), "error")


def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(Tables(spark, sf_dir).documents()).select(
        "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5"))


def document_list(spark, sf_dir):
    t = Tables(spark, sf_dir)
    listed = views.list_documents(t.documents(), chunking.chunk_documents(t.documents()))
    return listed.select(
        "id", "owner", "title", "file_type", "raw_text_preview", "chunk_count",
        X.document_caption(F.col("file_type"), F.col("chunk_count")).alias("caption"),
        _seconds("created_at").alias("created_epoch"), F.col("position").cast("bigint").alias("position"),
    )


def validate_documents(spark, sf_dir):
    return _error_columns(validation.validate_documents(Tables(spark, sf_dir).document_inputs()))


def ingest_documents(spark, sf_dir):
    """Uploads of every type: final status, error and number of chunks."""
    done = stored_processing(Tables(spark, sf_dir).document_inputs(), _as_of())
    result = ingest(done, _as_of(), extractor=None, processed=True)
    listed = chunking.with_chunk_count(result.documents, result.chunks)
    return listed.select("id", "processing_status", "processing_error", "chunk_count",
                         F.col("extracted_at").isNotNull().alias("extracted"), F.md5("raw_text").alias("text_md5"))


def upload_chain(spark, sf_dir):
    """Uploads of every type through validation, processing and the graph: refused rows, then statuses and linked
    nodes."""
    done = ingest_uploads(Tables(spark, sf_dir).document_inputs(), _as_of())
    linked = done.graph.links.groupBy("document_id").agg(F.count("*").alias("nodes")).withColumnRenamed("document_id", "id")
    good = done.ingested.documents.join(linked, "id", "left").select(
        "id", F.col("processing_status").alias("outcome"), F.coalesce("nodes", F.lit(0)).alias("nodes"))
    return good.unionByName(done.refused.select("id", F.concat(F.lit("refused: "), "error.field").alias("outcome"), F.lit(0).alias("nodes")))


def _reprocessed(t: Tables) -> DataFrame:
    """Documents labelled good quality."""
    good = t.raw("labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("id")).distinct()
    return t.documents().join(good, "id", "left_semi")


def replace_chunks(spark, sf_dir):
    """Good-quality documents are chunked anew with smaller windows, the rest keep their chunks."""
    t = Tables(spark, sf_dir)
    again = _reprocessed(t)
    after = chunking.replace_chunks(
        chunking.chunk_documents(t.documents()), chunking.chunk_documents(again, size=120, overlap=20), again)
    return after.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                        F.md5("content").alias("content_md5"))


def cascade_delete(spark, sf_dir):
    """Toxic documents go, with their chunks, citations and links; what remains per table."""
    t = Tables(spark, sf_dir)
    tables = {
        "documents": t.documents(),
        "document_chunks": t.chunks().select("id", "document_id"),
        "message_chunks": t.message_chunks(),
        "note_documents": t.note_documents(),
        "notes": t.notes(),
    }
    toxic = t.raw("labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    after = maintain.cascade_delete(tables, "documents", toxic)
    keys = {"documents": "id", "document_chunks": "document_id", "message_chunks": "chunk_id",
            "note_documents": "document_id", "notes": "id"}
    counted = [
        rows.agg(F.count("*").alias("row_count"), F.sum(keys[name]).alias("key_sum"))
        .select(F.lit(name).alias("table_name"), "row_count", "key_sum")
        for name, rows in after.items()
    ]
    result = counted[0]
    for rows in counted[1:]:
        result = result.unionByName(rows)
    return result


def keyword_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = views.search_documents_by_keyword(
        t.documents().withColumn("source_url", F.lit(None).cast("string")),
        chunking.chunk_documents(t.documents()), t.users(), "DOCUMENT src1")
    return found.select("id", "owner", "title", "chunk_count")


def keyword_search_dated(spark, sf_dir):
    """Documents of the second of three equal stretches of time, by keyword."""
    t = Tables(spark, sf_dir)
    last = t.raw("documents").agg(F.max("doc_id")).scalar()
    since, until = (F.timestamp_seconds(F.lit(EPOCH) + F.floor(last * n / 3) * 60) for n in (1, 2))
    found = views.search_documents_by_keyword(
        t.documents().withColumn("source_url", F.lit(None).cast("string")),
        chunking.chunk_documents(t.documents()), t.users(), "src", since=since, until=until)
    return found.select("id", "owner", "title", "chunk_count")


def owner_documents(spark, sf_dir):
    """What one owner sees of the document list."""
    t = Tables(spark, sf_dir)
    documents = filters.owned_by(t.documents(), "src0")
    chunks = filters.owned_by(chunking.chunk_documents(t.documents(), keep=("owner",)), "src0")
    return views.list_documents(documents, chunks).select("id", "title", "chunk_count", F.col("position").cast("bigint").alias("position"))


def nearest_chunks(spark, sf_dir):
    """The ten chunks nearest to the first vector."""
    t = Tables(spark, sf_dir)
    first = t.raw("embeddings").filter(F.col("vec_id") == 0).select("embedding").first()[0]
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return nearest(vectors, first, 10).select("chunk_id", F.round("distance", 6).alias("distance"))


def cascade_delete_owner(spark, sf_dir):
    """One user goes, with all that is theirs; what remains per table."""
    t = Tables(spark, sf_dir)
    tables = {"users": t.users(), "documents": t.documents(), "conversations": t.conversations(),
              "messages": t.messages(), "memory_entries": t.memory(), "tasks": t.tasks(), "goals": t.goals(), "notes": t.notes(),
              "note_documents": t.note_documents()}
    after = maintain.cascade_delete(tables, "users", t.users().filter(F.col("id") == "src0").select("id"))
    result = None
    for name, rows in after.items():
        counted = rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        result = counted if result is None else result.unionByName(counted)
    return result


def insert_tasks(spark, sf_dir):
    """Orders as new tasks without ids, beside the stored ones: each gets an id of its own."""
    t = Tables(spark, sf_dir)
    new = maintain.new_tasks(t.tasks().select("title", "priority", F.col("owner").alias("who")), F.col("who"), _as_of(), t.tasks())
    both = new.withColumn("is_new", F.lit(True)).unionByName(t.tasks().withColumn("is_new", F.lit(False)), allowMissingColumns=True)
    shared = chunking.duplicate_keys(both, ["id"]).select("id", F.lit(True).alias("shared"))
    return both.join(shared, "id", "left").filter("is_new").select(
        "owner", "title", "status", "priority", F.coalesce("shared", F.lit(False)).alias("id_taken"))


def clamped_limits(spark, sf_dir):
    """Limits of document searches as they come in a URL, one for each message."""
    turn = F.col("id") % 100
    text = F.when(turn == 0, F.lit(None).cast("string")).when(turn == 1, F.lit("abc")).when(turn == 2, F.lit("-1")) \
        .otherwise((turn * 4).cast("string"))
    return Tables(spark, sf_dir).messages().select(
        "id", validation.clamped_limit(text).cast("bigint").alias("k"), validation.clamped_limit_error(text)["message"].alias("error"))


def keyword_search_chunks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = views.search_chunks_by_keyword(chunking.chunk_documents(t.documents()), t.documents(), "the License")
    return found.select("document_id", "document_title", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                        X.chunk_label(F.col("document_title"), F.col("chunk_index")).alias("label"))


def indexed_chunk_search(spark, sf_dir):
    """keyword_search_chunks through trigram posting lists."""
    t = Tables(spark, sf_dir)
    # As joined with the titles of their ids: a title says its id, so chunks keep it, and a chunk counts for each row of its id.
    # Only ids are shuffled.
    chunks = chunking.chunk_documents(t.documents().filter(F.col("id").isNotNull()), keep=("title",)).withColumnRenamed("title", "document_title")
    several = small_frame(chunking.duplicate_keys(t.documents().select(F.col("id").alias("document_id")), ["document_id"]))
    if several is not None:
        chunks = chunks.join(several, "document_id", "left").withColumn(
            "row_count", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("row_count", F.lit(1)))))
    chunks = stored(chunks.select("document_id", "chunk_index", "document_title", "content"), "indexed-chunks", "zstd")
    keys, fields = ["document_id", "chunk_index"], ["document_title", "content"]
    found = search_index(gram_index(chunks, keys, fields), chunks, "the License", keys, fields)
    return found.select("document_id", "document_title", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                        X.chunk_label(F.col("document_title"), F.col("chunk_index")).alias("label"))


def facets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    done = process_documents(t.documents(), _as_of()).withColumn("created_day", F.to_date("created_at"))
    documents = filters.facet_counts(done, ["file_type", "processing_status", "created_day"])
    memory = filters.facet_counts(t.memory(), ["category", "is_pinned", "source"])
    return documents.unionByName(memory)


def stream_ingest(spark, sf_dir):
    """chunk_documents through the streaming job: files in, batch folders out, current state read back."""
    out = f"{shared_folder(spark)}/stream_ingest-{uuid.uuid4().hex}"
    t = Tables(spark, sf_dir)
    source = spark.readStream.schema(t.raw("documents").schema).parquet(f"{t.sf_dir}/documents.parquet*")
    made = F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 60)
    documents = source.select(
        F.col("doc_id").alias("id"), F.col("source").alias("owner"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("note").alias("file_type"),
        F.col("text").alias("raw_text"), made.alias("created_at"), made.alias("updated_at"))
    start_ingest(documents, out, checkpoint=f"{out}/progress", as_of=_as_of()).awaitTermination()
    return current_chunks(spark, out).select(
        "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5"))


def stream_upload_chain(spark, sf_dir):
    """upload_chain as a stream of files in which each upload comes twice, its older version in any place."""
    folder = f"{shared_folder(spark)}/stream_upload_chain-{uuid.uuid4().hex}"
    uploads = Tables(spark, sf_dir).document_inputs()
    # Files are packed once for both versions.
    both = uploads.withColumn("_old", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns({
        "title": F.when(F.col("_old"), F.concat(F.lit("Old "), "title")).otherwise(F.col("title")),
        "updated_at": F.when(F.col("_old"), F.col("updated_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("updated_at"))}).drop("_old")
    files = max(4, spark.sparkContext.defaultParallelism)
    both.repartition(files, "id", "title").write.parquet(f"{folder}/in")
    source = document_stream(spark, f"{folder}/in", uploads.schema, files_per_batch=-(-files // 2))
    start_uploads(source, f"{folder}/out", as_of=_as_of()).awaitTermination()
    linked = current_graph(spark, f"{folder}/out")["node_documents"].groupBy("document_id").agg(F.count("*").alias("nodes"))
    return upload_outcomes(spark, f"{folder}/out").join(linked.withColumnRenamed("document_id", "id"), "id", "left").select(
        "id", "title", "outcome", F.coalesce("nodes", F.lit(0)).alias("nodes"))


# ---- rows in and out ---------------------------------------------------------------------

def decoder_plugin(spark, sf_dir):
    """Files of a type that a plug-in decodes: pages between bars."""
    files = Tables(spark, sf_dir).raw("documents").select(
        F.col("doc_id").alias("id"), F.lit("pdf").alias("file_type"), F.lit(None).cast("string").alias("raw_text"),
        F.encode(F.translate("text", "\n", "|"), "UTF-8").alias("content"))
    found = extract_text(files, {"pdf": lambda data: "\n".join(data.decode().split("|"))})
    return found.select("id", F.md5("text").alias("text_md5"), "error")


def append_read_back(spark, sf_dir):
    """Documents appended to a stored table in two goes and read back."""
    root = f"{shared_folder(spark)}/append_read_back-{uuid.uuid4().hex}"
    documents = Tables(spark, sf_dir).documents()
    late = F.col("id") % 2 == 1
    for part in (documents.filter(~late), documents.filter(late)):
        append_table(part, root, "documents")
    return read_table(spark, root, "documents").select(
        "id", "owner", "title", F.md5("raw_text").alias("text_md5"), _seconds("created_at").alias("created_epoch"))


def documents_json(spark, sf_dir):
    return as_json(Tables(spark, sf_dir).documents().select("id", "owner", "title"))


def owned_lookup(spark, sf_dir):
    """Each document asked for by the owner that its number suggests; others' documents stay hidden."""
    asking = F.concat(F.lit("src"), (F.col("id") % 20).cast("string"))
    return filters.owned_row(Tables(spark, sf_dir).documents(), asking, F.col("id")).select("id", "owner", "title")


def chunk_order(spark, sf_dir):
    chunks = in_document_order(chunking.chunk_documents(Tables(spark, sf_dir).documents()))
    return chunks.select("document_id", "position", F.md5("content").alias("content_md5"))


def unit_vectors(spark, sf_dir):
    made = Tables(spark, sf_dir).raw("embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return made.select("vec_id", F.round(square, 4).alias("square"), F.round(F.element_at("v", 1).cast("double"), 5).alias("lead"))


def upload_types(spark, sf_dir):
    rows = Tables(spark, sf_dir).document_inputs()
    name = F.col("file_name")
    return rows.select("id", X.upload_type(name).alias("kind"), X.is_submittable(F.col("title"), name, F.col("raw_text")).alias("submittable"))


# ---- chat --------------------------------------------------------------------------------

def _history(spark, sf_dir, n):
    rows = chat.recent_history(Tables(spark, sf_dir).messages(), n)
    return rows.select("conversation_id", F.size("messages").cast("bigint").alias("message_count"), "history")


def recent_history(spark, sf_dir):
    return _history(spark, sf_dir, K.HISTORY_MESSAGES)


def recent_history_4(spark, sf_dir):
    return _history(spark, sf_dir, 4)


def _contexts(t: Tables) -> DataFrame:
    return chat.chat_context(_exchanges(t), t.messages(), _ingested_chunks(t), t.documents())


def chat_context(spark, sf_dir):
    rows = _contexts(Tables(spark, sf_dir))
    return rows.select(
        "conversation_id", "exchange_id", F.size("sources").cast("bigint").alias("source_count"),
        F.md5("context").alias("context_md5"), F.md5("history").alias("history_md5"),
        F.col("prompt")[1]["content"].alias("user_prompt"),
    )


def fallback_answer(spark, sf_dir):
    rows = chat.answer(_contexts(Tables(spark, sf_dir)))
    return rows.select("conversation_id", "exchange_id", "answer")


def record_exchange(spark, sf_dir):
    """Messages and citations after every question got its answer stored."""
    t = Tables(spark, sf_dir)
    answered = chat.answer(_contexts(t)).withColumns({
        "title": F.lit(None).cast("string"),
        "user_message_id": F.col("exchange_id") + 50, "assistant_message_id": F.col("exchange_id") + 51,
    })
    links = t.message_chunks().withColumn("chunk_id", F.col("chunk_id").cast("string"))
    after = chat.record_exchanges(answered, t.conversations(), t.messages(), links, _as_of())
    counts = after.message_chunks.groupBy("message_id").agg(F.count("*").alias("n")).withColumnRenamed("message_id", "id")
    moved = after.conversations.select(F.col("id").alias("conversation_id"),
                                       _seconds("updated_at").alias("conversation_updated_epoch"))
    return after.messages.join(counts, "id", "left").join(moved, "conversation_id").select(
        "id", "conversation_id", "role", F.md5("content").alias("content_md5"),
        F.coalesce("n", F.lit(0)).alias("citation_count"), "conversation_updated_epoch",
        X.message_label(F.col("role"), F.col("content")).alias("label"))


def new_conversations(spark, sf_dir):
    """Every question asked outside any conversation: each opens one of its own, and a model finds a memory in each
    exchange."""
    t = Tables(spark, sf_dir)
    asked = _exchanges(t).drop("seq").withColumns({
        "conversation_id": F.lit(None).cast("bigint"), "title": chat.prompts.conversation_title(F.col("message")),
        "answer": F.lit("Noted."), "sources": F.array().cast("array<struct<chunk_id:string,score:double>>")})
    links = t.message_chunks().withColumn("chunk_id", F.col("chunk_id").cast("string"))
    after = chat.record_exchanges(asked, t.conversations(), t.messages(), links, _as_of())

    def load():
        return lambda text: json.dumps({"title": "Asked", "content": str(len(text)), "category": "fact"})

    memories = chat.extract_memories(after.exchanges.select("owner", "message", "answer"), _as_of(), load, t.memory())
    said = after.messages.groupBy("conversation_id").agg(F.count("*").alias("messages")).withColumnRenamed("conversation_id", "id")
    opened = after.conversations.join(t.conversations().select("id"), "id", "left_anti").join(said, "id").select(
        F.lit("conversation").alias("kind"), "owner", F.md5("title").alias("what"), "messages")
    return opened.unionByName(memories.select(F.lit("memory").alias("kind"), "owner", F.md5("content").alias("what"),
                                              F.lit(0).cast("bigint").alias("messages")))


def list_conversations(spark, sf_dir):
    rows = chat.list_conversations(Tables(spark, sf_dir).conversations())
    return rows.select("id", "owner", X.conversation_label(F.col("id"), F.col("title")).alias("title"),
                       _seconds("created_at").alias("created_epoch"), _seconds("updated_at").alias("updated_epoch"),
                       F.col("position").cast("bigint").alias("position"))


def conversation_detail(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sources = chat.message_sources(t.messages(), t.message_chunks(), t.chunks(), t.documents())
    detail = chat.conversation_detail(t.conversations(), t.messages(), sources, page_rows=4)
    source_text = lambda s: F.concat_ws(
        ",", s["chunk_id"].cast("string"), s["document_title"], F.md5(s["content"]), F.round(s["score"], 6).cast("string"))
    message_text = F.transform("messages", lambda m: F.concat_ws(
        "|", m["id"].cast("string"), m["role"], F.md5(m["content"]),
        F.array_join(F.transform(m["sources"], source_text), ";")))
    return detail.select("id", "owner", "title", "page", F.size("messages").cast("bigint").alias("message_count"),
                         F.array_join(message_text, "\n").alias("messages_text"))


def validate_chat_requests(spark, sf_dir):
    t = Tables(spark, sf_dir)
    message = F.when(F.col("id") % 100 == 1, F.lit(" \n ")).otherwise(F.col("content"))
    rows = t.messages().withColumn("error", validation.chat_error(message, F.col("conversation_id")))
    return _error_columns(rows)


# ---- memory ------------------------------------------------------------------------------

def _memory_columns(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select("id", "owner", "title", "category", "is_pinned", tags_to_text(F.col("tags")).alias("tags"),
                       _seconds("updated_at").alias("updated_epoch"), *more)


def _found(rows: DataFrame) -> DataFrame:
    return _memory_columns(rows, F.col("position").cast("bigint").alias("position"))


def memory_search(spark, sf_dir):
    entries = Tables(spark, sf_dir).memory().withColumn("tags", normalize_tags(F.col("tags")))
    return _found(views.search_memory(entries, " K1 ", "", "false"))


def memory_search_category(spark, sf_dir):
    entries = Tables(spark, sf_dir).memory().withColumn("tags", normalize_tags(F.col("tags")))
    return _found(views.search_memory(entries, "PURCHASE 1", "preference", "any"))


def memory_tags_normalized(spark, sf_dir):
    """Tags from a list and from the same text; the form's round trip keeps case and repeats."""
    rows = Tables(spark, sf_dir).memory()
    listed = F.array_join("tags", ",")
    return rows.select(
        "id", tags_to_text(normalize_tags(F.col("tags"))).alias("tags"),
        tags_to_text(normalize_tags(F.split(listed, ","))).alias("tags_from_text"),
        tags_to_text(tags_from_text(listed)).alias("form_text"))


def memory_keyword_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = views.search_memory_by_keyword(t.memory(), t.users(), "src1 k 5", {"category": "fact"})
    return found.select("id", "owner", "title", "category")


def validate_memory(spark, sf_dir):
    rows = Tables(spark, sf_dir).memory()
    broken = F.col("id") % 5
    title = F.when(broken == 0, F.lit("  ")).when(broken == 1, F.repeat("title", 30)).otherwise(F.col("title"))
    content = F.when(broken == 2, F.lit("\n")).otherwise(F.col("content"))
    category = F.when(broken == 3, F.lit("odd")).otherwise(F.col("category"))
    tags = F.transform("tags", lambda tag: F.repeat(tag, 8))
    return _error_columns(rows.withColumn("error", validation.memory_error(title, content, category, tags)))


def partial_update(spark, sf_dir):
    """Every error entry is retitled and retagged; other entries and fields stay."""
    memory = Tables(spark, sf_dir).memory().withColumn("tags", normalize_tags(F.col("tags")))
    patches = memory.filter(F.col("category") == "pinned").select(
        "id", "owner", F.array(F.lit("title"), F.lit("tags")).alias("fields"),
        F.concat(F.lit("Resolved "), F.col("title")).alias("title"),
        F.array(F.lit(" Resolved"), F.lit("DONE"), F.lit("done ")).alias("tags"), F.lit("fact").alias("category"))
    return _memory_columns(maintain.partial_update(memory, patches, ["title", "tags", "category"], _as_of()))


# ---- graph -------------------------------------------------------------------------------

def _node_counts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy("node_id").agg(F.count("*").alias("document_count")).withColumnRenamed("node_id", "id")
    return nodes.join(counts, "id", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def graph_nodes_upsert(spark, sf_dir):
    g = upsert_graph(Tables(spark, sf_dir).graph_payloads(), _as_of())
    rows = _node_counts(g.nodes, g.links)
    return graph.with_type_check(rows, "node_type", K.NODE_TYPES).select(
        "owner", "title", "node_type", "description", "document_count", "type_ok",
        X.node_label(F.col("title"), F.col("node_type")).alias("label"))


def graph_edges_upsert(spark, sf_dir):
    g = upsert_graph(Tables(spark, sf_dir).graph_payloads(), _as_of())
    _, titled = views.graph_data(g.nodes, g.edges)
    return titled.select(
        "owner", "source_title", "target_title", "relationship_type", "relationship_label", "description", "weight",
        X.edge_label(F.col("source_title"), F.col("relationship_type"), F.col("target_title")).alias("label"))


def graph_incremental_upsert(spark, sf_dir):
    """The graph built in two batches, late orders first: stored rows win, links and edges add up."""
    t = Tables(spark, sf_dir)
    late = F.col("document_id") >= t.raw("orders").agg(F.max("o_orderkey")).scalar() * 5
    first = upsert_graph(t.graph_payloads().filter(late), _as_of())
    nodes, links, edges = stored(first.nodes, "nodes"), stored(first.links, "links"), stored(first.edges, "edges")
    g = upsert_graph(t.graph_payloads().filter(~late), _as_of(), nodes, links, edges)
    listed, titled = views.graph_data(g.nodes, g.edges)
    counted = _node_counts(listed, g.links)
    return counted.select(
        F.lit("node").alias("kind"), "owner", F.concat_ws("/", "node_type", "title").alias("name"), "description",
        F.col("document_count").alias("n"), F.col("position").cast("bigint").alias("position")).unionByName(titled.select(
            F.lit("edge").alias("kind"), "owner", F.concat_ws("/", "relationship_type", "source_title", "target_title").alias("name"),
            "description", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("position")))


def node_detail(spark, sf_dir):
    t = Tables(spark, sf_dir)
    g = upsert_graph(t.graph_payloads(), _as_of())
    detail = graph.node_detail(g.nodes, g.links, t.order_documents())
    ids = F.array_join(F.transform("source_documents", lambda d: d["id"].cast("string")), ",")
    return detail.select("owner", "title", "node_type", "page",
                         F.size("source_documents").cast("bigint").alias("document_count"),
                         F.md5(ids).alias("document_ids_md5"),
                         F.get("source_documents", F.lit(0))["title"].alias("first_document"))


def _text_graph(spark, sf_dir):
    return upsert_graph(ingest(Tables(spark, sf_dir).documents(), _as_of()).payloads, _as_of())


def entity_nodes(spark, sf_dir):
    g = _text_graph(spark, sf_dir)
    return _node_counts(g.nodes, g.links).select("owner", "title", "node_type", "document_count")


def entity_edges(spark, sf_dir):
    g = _text_graph(spark, sf_dir)
    return graph.edges_with_titles(g.edges, g.nodes).select(
        "owner", "source_title", "target_title", "relationship_type", "weight")


# ---- roll-ups and productivity -------------------------------------------------------------

def dashboard_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    done = process_documents(t.documents(), _as_of())
    chunks = chunking.chunk_documents(t.documents(), keep=("owner",))
    return views.dashboard_summary(t.users(), done, chunks, t.memory(), t.tasks())


def recent_digest(spark, sf_dir):
    t = Tables(spark, sf_dir)
    digest = views.daily_digest(t.users(), t.documents(), t.memory())
    return digest.select("owner", "recent_documents", "recent_memories", "prompt")


def tasks_view(spark, sf_dir):
    rows = views.tasks_view(Tables(spark, sf_dir).tasks())
    return rows.select("id", "owner", "title", "status_label", "priority_label",
                       F.date_format("due_day", "yyyy-MM-dd").alias("due_day"))


def toggle_tasks(spark, sf_dir):
    rows = Tables(spark, sf_dir).tasks()
    return rows.select("id", "status", maintain.toggled_status(F.col("status")).alias("new_status"))


def goals_view(spark, sf_dir):
    rows = views.goals_view(Tables(spark, sf_dir).goals())
    return rows.select("id", "owner", "title", F.col("progress").cast("bigint").alias("progress"), "is_completed")


def notes_view(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = views.notes_view(t.notes(), t.note_documents())
    ids = F.array_join(F.transform("related_documents", lambda d: d.cast("string")), ",")
    return rows.select("id", "owner", "title", "page", ids.alias("related_ids"))


QUERIES = {
    f.__name__: f
    for f in (
        semantic_search_topk, search_chunks_distance, embedded_chunks, text_search_topk, lsh_topk, pruned_search,
        cells_search_quality,
        search_request_batch, normalize_text, txt_extract, chunk_documents, document_list, validate_documents,
        ingest_documents, replace_chunks, cascade_delete, keyword_search, keyword_search_chunks,
        indexed_chunk_search, facets,
        stream_ingest, stream_upload_chain, decoder_plugin, append_read_back, documents_json, owned_lookup, chunk_order, unit_vectors,
        upload_types, recent_history, recent_history_4, chat_context, fallback_answer, record_exchange,
        list_conversations, conversation_detail, validate_chat_requests, memory_search, memory_search_category,
        memory_tags_normalized, memory_keyword_search, validate_memory, partial_update, graph_nodes_upsert,
        graph_edges_upsert, node_detail, entity_nodes, entity_edges, dashboard_summary, recent_digest, tasks_view,
        toggle_tasks, goals_view, notes_view, upload_chain, keyword_search_dated, owner_documents, nearest_chunks,
        cascade_delete_owner, insert_tasks, clamped_limits, new_conversations, graph_incremental_upsert,
    )
}
