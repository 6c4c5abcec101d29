"""The upload chain as a stream: newest versions, validation, processing, chunks, vectors and the graph.

Folders are those of ``streaming.ingest``: each micro-batch writes its own and a repeated batch overwrites it. Graph
tables are kept as what each batch added, so a batch never rewrites what others wrote.
"""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom import constants as K
from loreloom.functions.embedding import Embedder
from loreloom.operators import graph
from loreloom.operators.generate import capitalised_phrases
from loreloom.operators.validation import document_error, split_valid
from loreloom.plans.ingest import ingest, stored_processing
from loreloom.schemas import EDGES, NODE_DOCUMENTS, NODES
from loreloom.sources.tables import conform, stored
from loreloom.streaming.ingest import _VERSION, _newest, _versions
from loreloom.streaming.versions import EXPIRED, NEWEST, STORE, WAIT_MS, newest_versions

GRAPH = {"nodes": NODES, "node_documents": NODE_DOCUMENTS, "edges": EDGES}
REFUSED = T.StructType([T.StructField("id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("message", T.StringType()),
                        T.StructField("title", T.StringType())])
TIMED_OUT = "Processing did not finish in time."


def start_uploads(uploads: DataFrame, out: str, checkpoint: str | None = None, as_of=None, wait_ms: int = WAIT_MS,
                  embedder: Embedder | None = None, extractor=capitalised_phrases, decoders: dict | None = None,
                  allowed: tuple[str, ...] = K.UPLOAD_TYPES, strict: bool = False):
    """Start taking the available uploads into ``out``; returns the query.

    Late and repeated versions of a document are dropped by ``newest_versions``. A version that says ``processing`` is in
    other hands: it is not taken, and reported as failed when nothing newer came for ``wait_ms``. Refused versions are
    listed in ``refused`` and change nothing else. The graph only grows: a newer version adds nodes, links and edges.
    """
    spark = uploads.sparkSession
    stamp = F.current_timestamp() if as_of is None else as_of
    for name, schema in {**GRAPH, "refused": REFUSED}.items():
        # An empty first folder, so that reading needs no test for the table.
        spark.createDataFrame([], _stamped(schema)).write.mode("ignore").parquet(f"{out}/{name}/run=none/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        here = batch.sparkSession
        run = here.sparkContext.getLocalProperty("sql.streaming.queryId")
        written = F.lit(time.time_ns() // 1000).alias("written_us")

        def put(rows: DataFrame, name: str) -> None:
            rows.select("*", written).write.mode("overwrite").parquet(f"{out}/{name}/run={run}/batch={batch_id}")

        # Stored before anything reads it: each read of the batch would run the state again.
        versions = stored(batch, "versions")
        if versions.isEmpty():
            return
        in_hand = F.coalesce(F.col("processing_status") == "processing", F.lit(False)) if "processing_status" in versions.columns else F.lit(False)
        taken = versions.filter((F.col("event") == NEWEST) & ~in_hand).drop("event")
        # What other batches added, never this one's own first attempt.
        other = (F.col("run") != run) | (F.col("batch") != batch_id)
        before = {name: _versions(here, f"{out}/{name}", schema).filter(other).drop(*_VERSION) for name, schema in GRAPH.items()}
        error = document_error(F.col("file_type"), F.col("file_name"), F.col("file_size"), F.col("raw_text"), F.col("source_url"), allowed)
        good, refused = split_valid(taken, error)
        done = ingest(stored_processing(good, stamp, decoders), stamp, embedder, extractor, processed=True)
        payloads = stored(graph.parsed(done.payloads), "payloads")
        links = graph.link_nodes(payloads, strict=strict, owner=True)
        # Ids are keys of titles, so only the stored nodes that share a title with this batch matter.
        mentions = graph.node_mentions(payloads, strict).select("owner", "title").union(
            graph.edge_mentions(payloads).select("owner", F.explode(F.array("source_title", "target_title")).alias("title"))).distinct()
        known = stored(before["nodes"].join(mentions, ["owner", "title"], "left_semi").select(*NODES.names), "known-nodes")
        first = stored(graph.first_nodes(payloads, strict), "first-nodes")
        made = {"nodes": (graph.upsert_nodes(payloads, stamp, strict=strict, first=first), known, ["id"]),
                "node_documents": (links, before["node_documents"], ["node_id", "document_id"]),
                "edges": (graph.upsert_edges(payloads, stamp, known, strict=strict, first=first), before["edges"], ["id"])}
        for name, (new, old, keys) in made.items():
            put(conform(new.join(old.select(*keys), keys, "left_anti"), GRAPH[name]), name)
        put(done.chunks, "chunks")
        put(conform(refused.select("id", "error.field", "error.message", "title"), REFUSED), "refused")
        expired = versions.filter(F.col("event") == EXPIRED).drop("event", "content").withColumns({
            "processing_status": F.lit("failed"), "processing_error": F.lit(TIMED_OUT), "updated_at": stamp})
        # Status rows come last: a document is complete once its status is visible.
        put(done.documents.unionByName(expired, allowMissingColumns=True), "documents")

    kept = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        return (
            newest_versions(uploads, wait_ms).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint or f"{out.rstrip('/')}/_progress")
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(STORE[0]) if kept is None else spark.conf.set(STORE[0], kept)


def _stamped(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("written_us", T.LongType())])


def current_graph(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """nodes, node_documents and edges: all that the batches added."""
    return {name: _versions(spark, f"{out}/{name}", schema).drop(*_VERSION) for name, schema in GRAPH.items()}


def upload_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """id, title, outcome of each upload's newest version: its status, or ``refused: `` and the field."""
    status = _versions(spark, f"{out}/documents", None).select("id", "title", F.col("processing_status").alias("outcome"), *_VERSION)
    refused = _versions(spark, f"{out}/refused", REFUSED).select(
        "id", "title", F.concat(F.lit("refused: "), "field").alias("outcome"), *_VERSION)
    return _newest(status.unionByName(refused))
