"""Knowledge-base tables as views over the given parquet tables. Every view spans its whole table."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.operators.sizing import ordered_list
from loreloom.sources.tables import spread

# 2024-01-01T00:00:00Z, the time the row with id 0 was made.
EPOCH = 1704067200
OWNERS = 20


def _at(minutes):
    return F.timestamp_seconds(F.lit(EPOCH) + minutes * 60)


def _owner(number):
    return F.concat(F.lit("src"), (number % OWNERS).cast("string"))


def _docx(text):
    """The text as a DOCX file, a paragraph for each line."""
    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        def one(text):
            lines = "".join(f"<w:p><w:r><w:t xml:space=\"preserve\">{escape(x)}</w:t></w:r></w:p>" for x in (text or "").split("\n"))
            name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("word/document.xml", f"<w:document xmlns:w=\"{name}\"><w:body>{lines}</w:body></w:document>")
            return out.getvalue()

        return texts.map(one)

    return pack(text)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def users(self) -> DataFrame:
        """One user per owner id, found in documents, events and orders alike."""
        names = (
            self.raw("documents").select(F.col("source").alias("id")).distinct()
            .union(self.raw("events").select(_owner(F.col("user_id")).alias("id")).distinct())
            .union(self.raw("orders").select(_owner(F.col("o_custkey")).alias("id")).distinct())
        ).distinct()
        return names.select("id", F.col("id").alias("username"), F.concat("id", F.lit("@example.org")).alias("email"))

    def documents(self) -> DataFrame:
        made = _at(F.col("doc_id"))
        return spread(self.raw("documents")).select(
            F.col("doc_id").alias("id"), F.col("source").alias("owner"),
            F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
            F.lit("note").alias("file_type"), F.col("text").alias("raw_text"), F.lit("pending").alias("processing_status"),
            F.lit("").alias("processing_error"), made.alias("created_at"), made.alias("updated_at"), "lang",
        )

    def document_inputs(self) -> DataFrame:
        """Uploads of every type, so that each validation and extraction rule fires."""
        doc = F.col("doc_id")
        kinds = F.array(*[F.lit(k) for k in ("note", "txt", "pdf", "docx", "link", "bogus")])
        names = F.array(F.lit(None).cast("string"), F.lit("a.txt"), F.lit("a.PDF"), F.lit("a.bin"))
        made = _at(doc)
        return spread(self.raw("documents")).select(
            doc.alias("id"), F.col("source").alias("owner"),
            F.concat(F.lit("Document "), doc.cast("string")).alias("title"),
            F.element_at(kinds, (doc % 6 + 1).cast("int")).alias("file_type"),
            F.element_at(names, (doc % 4 + 1).cast("int")).alias("file_name"),
            (F.col("n_chars") * 1000).alias("file_size"),
            F.when(doc % 5 != 0, F.lit("https://example.org/page")).alias("source_url"),
            F.when(doc % 7 == 0, F.lit("")).otherwise(F.col("text")).alias("raw_text"),
            F.when(doc % 6 == 3, _docx(F.col("text"))).otherwise(F.encode("text", "UTF-8")).alias("content"),
            F.lit("").alias("processing_error"), made.alias("created_at"), made.alias("updated_at"),
        )

    def chunks(self) -> DataFrame:
        """Given vectors as chunks, dealt over all documents in turn."""
        documents = self.raw("documents")
        total = documents.agg(F.count("*")).scalar()
        placed = self.raw("embeddings").select(
            F.col("vec_id").alias("id"), (F.col("vec_id") % total).alias("document_id"),
            F.floor(F.col("vec_id") / total).cast("int").alias("chunk_index"), "embedding", "label",
        )
        texts = documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"),
                                 F.col("source").alias("owner"))
        return placed.join(texts, "document_id")

    def centroid_queries(self, *keys: str) -> DataFrame:
        """One query per ``keys`` group of an owner's vectors: their mean."""
        group = ["owner", *keys]
        means = (
            self.chunks().select(*group, F.posexplode("embedding").alias("pos", "x"))
            .groupBy(*group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
        )
        # As many elements per group as the vectors have dimensions.
        vectors = means.groupBy(*group).agg(ordered_list(F.col("mean"), F.col("pos")).alias("vector"))
        return vectors.select(
            F.concat_ws("/", *[F.col(c).cast("string") for c in group]).alias("query_id"), "owner", "vector"
        )

    def conversations(self) -> DataFrame:
        return self.raw("conversations").groupBy("conv_id").agg(
            F.min("turn").alias("_first"), F.max("turn").alias("_last")
        ).select(
            F.col("conv_id").alias("id"), _owner(F.col("conv_id")).alias("owner"),
            F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
            _at(F.col("conv_id") * 60 + F.col("_first")).alias("created_at"),
            _at(F.col("conv_id") * 60 + F.col("_last")).alias("updated_at"),
        )

    def messages(self) -> DataFrame:
        """Messages of all roles, ``system`` too."""
        return self.raw("conversations").select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"),
            "role", F.col("text").alias("content"), _at(F.col("conv_id") * 60 + F.col("turn")).alias("created_at"),
        )

    def message_chunks(self) -> DataFrame:
        """Three citations per assistant message."""
        total = self.raw("embeddings").agg(F.count("*")).scalar()
        assistant = self.raw("conversations").filter(F.col("role") == "assistant")
        return assistant.select(
            "conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")
        ).select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"),
            ((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("j")) % total).alias("chunk_id"),
            (F.col("j") + 1).alias("citation_rank"),
            (1 / (F.col("j") + 1)).alias("score"),
        )

    def memory(self) -> DataFrame:
        kind = F.col("event_type")
        category = (
            F.when(kind == "click", "note").when(kind == "view", "summary").when(kind == "purchase", "preference")
            .when(kind == "signup", "fact").otherwise("pinned")
        )
        key = F.get_json_object("props", "$.k")
        at = F.col("ts").cast("timestamp")
        return self.raw("events").select(
            F.col("event_id").alias("id"), _owner(F.col("user_id")).alias("owner"),
            F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("title"),
            F.col("props").alias("content"), category.alias("category"),
            F.array(F.concat(F.lit(" "), F.upper(kind)), kind, F.concat(F.lit("k"), key)).alias("tags"),
            (F.col("value") > 150).alias("is_pinned"), F.lit("manual").alias("source"),
            at.alias("created_at"), at.alias("updated_at"),
        )

    def tasks(self) -> DataFrame:
        status, level = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
        at = F.col("o_orderdate").cast("timestamp")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), _owner(F.col("o_custkey")).alias("owner"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
            F.lit("").alias("description"),
            F.when(status == "O", "pending").when(status == "P", "in_progress").otherwise("completed").alias("status"),
            F.when(level.isin("1", "2"), "high").when(level == "3", "medium").otherwise("low").alias("priority"),
            (at + F.expr("INTERVAL 30 DAYS")).alias("due_date"), at.alias("created_at"), at.alias("updated_at"),
        )

    def goals(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), _owner(F.col("p_partkey")).alias("owner"), F.col("p_name").alias("title"),
            F.lit("").alias("description"), F.lit(None).cast("date").alias("target_date"),
            (F.col("p_size") * 2).alias("progress"), (F.col("p_size") == 50).alias("is_completed"),
        )

    def notes(self) -> DataFrame:
        return self.documents().select("id", "owner", "title", F.col("raw_text").alias("content"),
                                       "created_at", "updated_at")

    def note_documents(self) -> DataFrame:
        """Each note relates to the three documents after it, where they exist."""
        ids = self.raw("documents").select(F.col("doc_id").alias("document_id"))
        return (
            self.raw("documents").select(
                F.col("doc_id").alias("note_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j"))
            .select("note_id", (F.col("note_id") + F.col("j")).alias("document_id"))
            .join(ids, "document_id").select("note_id", "document_id")
        )

    def order_lines(self) -> DataFrame:
        """One small document per order line: who bought what from whom."""
        lines = spread(self.raw("lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        customers = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        suppliers = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
        return (
            lines.join(orders.join(customers, "o_custkey"), "l_orderkey").join(parts, "l_partkey")
            .join(suppliers, "l_suppkey")
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"),
                _owner(F.col("c_nationkey")).alias("owner"), "l_orderkey", "c_name", "p_name", "s_name",
            )
        )

    def order_documents(self) -> DataFrame:
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
        ).distinct().withColumn("title", F.concat(F.lit("Order line "), F.col("id").cast("string")))

    def graph_payloads(self) -> DataFrame:
        about = F.concat(F.lit("seen on order "), F.col("l_orderkey").cast("string"))

        def node(title, kind):
            return F.struct(F.col(title).alias("title"), F.lit(kind).alias("type"), about.alias("description"))

        def edge(source, target, kind):
            return F.struct(F.col(source).alias("source"), F.col(target).alias("target"),
                            F.lit(kind).alias("type"), about.alias("description"))

        payload = F.to_json(F.struct(
            F.array(node("c_name", "person"), node("p_name", "technology"), node("s_name", "company")).alias("nodes"),
            F.array(edge("c_name", "p_name", "uses"), edge("p_name", "s_name", "belongs_to"),
                    edge("c_name", "s_name", "related_to")).alias("edges"),
        ))
        return self.order_lines().select("document_id", "owner", payload.alias("payload"))
