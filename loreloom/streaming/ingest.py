"""Incremental ingestion.

Every micro-batch writes one folder per table, ``run=<stream id>/batch=<id>``, and never touches another one. The
stream id is the one Spark keeps with the stream's progress: a restarted stream goes on under it and a repeated
batch overwrites its own folder, so the sink is idempotent; another stream into the same output, or one that lost
its progress, has folders of its own. Nothing is rewritten when a document comes again: readers take the newest by
the time the batch was written.
"""

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions.embedding import Embedder
from loreloom.operators.ordering import newest_per
from loreloom.plans.ingest import ingest, stored_processing

#: Files that a micro-batch takes unless the caller says otherwise, so that a first run over a full folder isn't one
#: batch.
FILES_PER_BATCH = 1000
_VERSION = ["written_us", "run", "batch"]


def document_stream(spark: SparkSession, path: str, schema: T.StructType,
                    files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def start_ingest(documents: DataFrame, out: str, checkpoint: str | None = None, as_of=None,
                 embedder: Embedder | None = None, decoders: dict | None = None,
                 size: int | None = None, overlap: int | None = None):
    """Start ingesting the available rows of a document stream into ``out``; returns the query.

    Progress is kept in ``checkpoint``; by default below ``out``, so that outputs never share it. Two streams into
    one output need a ``checkpoint`` each.
    """
    stamp = F.current_timestamp() if as_of is None else as_of
    progress = checkpoint or f"{out.rstrip('/')}/_progress"

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        folder = f"run={run}/batch={batch_id}"
        latest = newest_per(batch, ["id"], 1, by="updated_at", tie="title").drop("rank")
        # Files are decoded once; status rows and chunks derive from what was stored.
        done = stored_processing(latest, stamp, decoders)
        result = ingest(done, stamp, embedder, None, None, size, overlap, processed=True)
        written = F.lit(time.time_ns() // 1000).alias("written_us")
        result.chunks.select("*", written).write.mode("overwrite").parquet(f"{out}/chunks/{folder}")
        # Status rows come last: a document is complete once its status is visible.
        result.documents.select("*", written).write.mode("overwrite").parquet(f"{out}/documents/{folder}")

    return (
        documents.writeStream.foreachBatch(write).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )


def _newest(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("id").agg(F.max(F.struct(*_VERSION)).alias("_v")).select("id", "_v.*")
    return rows.join(newest, ["id", *_VERSION]).drop(*_VERSION)


def current_documents(spark: SparkSession, out: str, schema: T.StructType | None = None) -> DataFrame:
    """Newest version of every document."""
    return _newest(_versions(spark, f"{out}/documents", schema))


def current_chunks(spark: SparkSession, out: str, schema: T.StructType | None = None) -> DataFrame:
    """Chunks of every document's last successful run, which the (narrow) status rows tell."""
    completed = _versions(spark, f"{out}/documents", None).filter(F.col("processing_status") == "completed")
    newest = completed.groupBy("id").agg(F.max(F.struct(*_VERSION)).alias("_v")).select(F.col("id").alias("document_id"), "_v.run", "_v.batch")
    rows = _versions(spark, f"{out}/chunks", schema)
    return rows.join(newest, ["document_id", "run", "batch"], "left_semi").drop(*_VERSION)


def _versions(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(
        T.StructType([*schema.fields, T.StructField("written_us", T.LongType()), T.StructField("run", T.StringType()),
                      T.StructField("batch", T.LongType())]))
    return reader.parquet(path)


def compact(spark: SparkSession, out: str, target: str) -> None:
    """Write the current state to a new folder as a run of its own, for readers to switch to and streams to go on in.

    Batch 0 holds every document's last successful run, batch 1 the status of those that failed since."""
    run, now = f"run=compacted-{time.time_ns()}", time.time_ns() // 1000
    documents = _versions(spark, f"{out}/documents", None)
    done = documents.filter(F.col("processing_status") == "completed")
    for batch, rows in enumerate((_newest(done), current_documents(spark, out).filter(F.col("processing_status") != "completed"))):
        rows.select("*", F.lit(now + batch).alias("written_us")).write.mode("errorifexists").parquet(f"{target}/documents/{run}/batch={batch}")
    current_chunks(spark, out).select("*", F.lit(now).alias("written_us")).write.mode("errorifexists").parquet(f"{target}/chunks/{run}/batch=0")
