import io
import zipfile

import pytest
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions.embedding import HashingEmbedder
from loreloom.operators import chunking
from loreloom.plans.ingest import ingest, reprocess
from loreloom.session import checkpoint_dir
from loreloom.sources import tables
from loreloom.sources.extraction import extract_text
from loreloom.sources.files import docx_lines, read_files
from loreloom.streaming import ingest as stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SMALL = HashingEmbedder(8)


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


TABLE = f"<w:tbl><w:tr><w:tc>{p('c1')}</w:tc><w:tc>{p(' ')}</w:tc></w:tr><w:tr><w:tc>{p('c2')}</w:tc></w:tr></w:tbl>"


# A lambda travels to the workers by value.
pages = lambda data: "\n".join(data.decode().split("|"))


@pytest.fixture()
def uploads(spark, tmp_path):
    files = {
        "a.docx": docx(p(" Hello ", "world ") + TABLE + p("") + p("end")), "empty.docx": docx(p(" ")),
        "bad.docx": b"no zip", "a.txt": b"one \r\n\n two \xff", "empty.txt": b" \n ", "a.pdf": b" x | y ", "e.pdf": b"|",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = read_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("file", "([^/]*)$", 1))
    rows = [(i, "ada", n, n.split(".")[1], None, n) for i, n in enumerate(files)]
    rows += [(20, "ada", "note", "note", " a \n\n b ", None), (21, "ada", "none", "note", " ", None),
             (22, "ada", "link", "link", None, None), (23, "ada", "odd", "odd", None, None),
             (24, "ada", "null", None, None, None)]
    docs = spark.createDataFrame(rows, "id bigint, owner string, title string, file_type string, raw_text string, name string")
    return docs.join(found.select("name", "content", "file_size"), "name", "left")


def test_merged_docx_cells_stand_at_each_place_they_cover():
    def cell(text, properties=""):
        return f"<w:tc><w:tcPr>{properties}</w:tcPr>{p(text)}</w:tc>"

    wide, top, below = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = (cell("a", wide) + cell("b", top), cell("c") + cell("d") + cell("", below), cell("e") + cell("f", wide))
    body = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    assert docx_lines(docx(body)).split("\n") == ["a", "a", "b", "c", "d", "b", "e", "f", "f"]


def test_extraction_by_type(uploads):
    got = {r.title: (r.text, r.error) for r in extract_text(uploads, {"pdf": pages}).collect()}
    failed = got.pop("bad.docx")
    assert failed[0] is None and failed[1].startswith("Failed to extract DOCX text: ")
    assert got == {
        "a.docx": ("Hello world\nend\nc1\nc2", None),
        "empty.docx": (None, "DOCX file contains no selectable text."),
        "a.txt": ("one\ntwo �", None),
        "empty.txt": (None, "Text file is empty."),
        "a.pdf": ("x\ny", None),
        "e.pdf": (None, "No selectable text found in this PDF."),
        "note": ("a\nb", None),
        "none": (None, "Note is empty."),
        "link": (None, K.LINK_UNSUPPORTED),
        "odd": (None, "Unsupported document type: odd"),
        "null": (None, "Unsupported document type: None"),
    }


def test_ingest_sets_status_chunks_and_vectors(uploads, as_of):
    result = ingest(uploads, as_of, SMALL, decoders={"pdf": pages})
    status = {r.title: r for r in result.documents.collect()}
    done = {t for t, r in status.items() if r.processing_status == "completed"}
    assert done == {"a.docx", "a.txt", "a.pdf", "note"}
    assert all((r.extracted_at is not None) == (t in done) and (r.processing_error == "") == (t in done)
               for t, r in status.items())
    chunks = result.chunks.collect()
    assert {c.document_id for c in chunks} == {status[t].id for t in done}
    assert all(len(c.embedding) == 8 and c.owner == "ada" for c in chunks)
    assert result.payloads.count() == len(done)


def test_note_of_twenty_sentences(spark, as_of):
    docs = spark.createDataFrame([(1, "ada", "n", "note", "This is a sentence of exactly nine words here." * 20)],
                                 "id bigint, owner string, title string, file_type string, raw_text string")
    result = ingest(docs, as_of, SMALL)
    row, = result.documents.collect()
    assert row.processing_status == "completed" and row.processing_error == "" and row.extracted_at
    assert result.chunks.count() >= 1
    assert chunking.duplicate_keys(result.chunks, ["document_id", "chunk_index"]).count() == 0


def test_long_errors_are_cut(spark, as_of):
    docs = spark.createDataFrame([(1, "ada", "n", "x" * 3000, None)],
                                 "id bigint, owner string, title string, file_type string, raw_text string")
    assert len(ingest(docs, as_of, SMALL).documents.first().processing_error) == 2000


def test_reprocess_replaces_good_and_keeps_failed(spark, as_of):
    schema = "id bigint, owner string, title string, file_type string, raw_text string"
    first = spark.createDataFrame([(1, "a", "x", "note", "one two"), (2, "a", "y", "note", "three"),
                                   (3, "a", "z", "note", "four")], schema)
    old = ingest(first, as_of, SMALL).chunks
    again = spark.createDataFrame([(1, "a", "x", "note", "new text"), (2, "a", "y", "note", " ")], schema)
    docs, chunks = reprocess(old, again, as_of, embedder=SMALL)
    assert {r.document_id: r.content for r in chunks.collect()} == {1: "new text", 2: "three", 3: "four"}
    assert {r.id: r.processing_status for r in docs.collect()} == {1: "completed", 2: "failed"}


def test_chunk_counts_and_documents(spark):
    docs = spark.createDataFrame([(1, "a", "One"), (2, "b", "Two")], "id bigint, owner string, title string")
    chunks = spark.createDataFrame([(1, 0), (1, 1), (9, 0)], "document_id bigint, chunk_index int")
    assert {r.id: r.chunk_count for r in chunking.with_chunk_count(docs, chunks).collect()} == {1: 2, 2: 0}
    joined = chunking.with_document(chunks, docs).collect()
    assert {(r.document_id, r.owner, r.document_title) for r in joined} == {(1, "a", "One")}
    assert chunking.duplicate_keys(chunks, ["document_id"]).first().row_count == 2


def test_tables_round_trip(spark, tmp_path, as_of):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "ada", "T")], "id bigint, owner string, title string")
    tables.append_table(rows, root, "conversations")
    tables.append_table(rows.withColumn("id", F.lit(2)), root, "conversations")
    back = tables.read_table(spark, root, "conversations")
    assert {(r.id, r.owner, r.title, r.created_at) for r in back.collect()} == {(1, "ada", "T", None), (2, "ada", "T", None)}
    plan = back.filter("owner = 'ada'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(owner" in plan
    tables.replace_owner({"conversations": back.filter("owner = 'ada' AND id = 1")}, root, "ada")
    tables.append_table(rows.withColumns({"id": F.lit(3), "owner": F.lit("ü/=%\"")}), root, "conversations")
    tables.replace_owner({"conversations": rows.withColumn("id", F.lit(4))}, root, "ü/=%\"")
    assert {(r.id, r.owner) for r in tables.read_table(spark, root, "conversations").collect()} == {(1, "ada"), (4, "ü/=%\"")}
    back = tables.read_table(spark, root, "conversations")
    tables.write_json(back, f"{root}/json")
    assert tables.as_json(spark.read.json(f"{root}/json").select("id")).count() == 2
    tables.write_table(rows, f"{root}/t", ("id",))
    with pytest.raises(Exception, match="exists"):
        tables.write_table(rows, f"{root}/t")
    assert tables.stored(rows, "x").collect() == rows.collect()
    assert tables.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 4


def test_stream_reads_newest_versions(spark, tmp_path, as_of):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id bigint, owner string, title string, file_type string, raw_text string, updated_at timestamp"

    def put(rows, name):
        made = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("updated_at", as_of)
        made.coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        docs = stream.document_stream(spark, f"{source}/*", made_schema, files_per_batch=10)
        stream.start_ingest(docs, out, f"{out}/progress", as_of, SMALL).awaitTermination()

    made_schema = spark.createDataFrame([], schema).schema
    put([(1, "a", "x", "note", "one"), (2, "a", "y", "note", "two words")], "b1")
    run()
    put([(1, "a", "x", "note", "one again"), (2, "a", "y", "note", " "), (3, "a", "z", "note", "three")], "b2")
    run()
    run()
    assert {r.document_id: r.content for r in stream.current_chunks(spark, out).collect()} == \
        {1: "one again", 2: "two words", 3: "three"}
    status = {r.id: r.processing_status for r in stream.current_documents(spark, out).collect()}
    assert status == {1: "completed", 2: "failed", 3: "completed"}
    target = str(tmp_path / "compact")
    stream.compact(spark, out, target)
    assert stream.current_chunks(spark, target).count() == 3


def test_streams_do_not_touch_each_other(spark, tmp_path, as_of):
    """A second source into one output, one source into a second output, and a stream that lost its progress."""
    def source(name, ids):
        path = str(tmp_path / name)
        spark.range(*ids).selectExpr("id", "'o' AS owner", "'t' AS title", "'note' AS file_type", f"'{name} text' AS raw_text",
                                     "timestamp_seconds(id) AS updated_at").write.parquet(path)
        return lambda: stream.document_stream(spark, path, spark.read.parquet(path).schema)

    a, b, out, other = source("a", (0, 3)), source("b", (10, 12)), str(tmp_path / "out"), str(tmp_path / "other")
    stream.start_ingest(a(), out, as_of=as_of).awaitTermination()
    stream.start_ingest(a(), other, as_of=as_of).awaitTermination()
    assert stream.current_documents(spark, other).count() == 3
    stream.start_ingest(b(), out, checkpoint=str(tmp_path / "progress-b"), as_of=as_of).awaitTermination()
    assert {r.id for r in stream.current_documents(spark, out).collect()} == {0, 1, 2, 10, 11}
    stream.start_ingest(a(), out, checkpoint=str(tmp_path / "progress-lost"), as_of=as_of).awaitTermination()
    assert stream.current_documents(spark, out).count() == 5 and stream.current_chunks(spark, out).count() == 5
    target = str(tmp_path / "target")
    stream.compact(spark, out, target)
    stream.start_ingest(b(), target, as_of=as_of).awaitTermination()
    assert stream.current_documents(spark, target).count() == 5 and stream.current_chunks(spark, target).count() == 5


def test_compaction_keeps_chunks_of_documents_that_failed_since(spark, tmp_path, as_of):
    out, target = str(tmp_path / "out"), str(tmp_path / "target")
    for i, text in enumerate(("good text", " ")):
        path = str(tmp_path / f"in/{i}")
        spark.createDataFrame([(1, "o", "t", "note", text)], "id long, owner string, title string, file_type string, raw_text string") \
            .withColumn("updated_at", F.timestamp_seconds(F.lit(i))).write.parquet(path)
        docs = stream.document_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(path).schema)
        stream.start_ingest(docs, out, as_of=as_of).awaitTermination()
    stream.compact(spark, out, target)
    for place in (out, target):
        assert [r.content for r in stream.current_chunks(spark, place).collect()] == ["good text"]
        assert [r.processing_status for r in stream.current_documents(spark, place).collect()] == ["failed"]


def test_checkpoint_folder_is_the_sessions(spark):
    assert checkpoint_dir(spark, "/x") == (spark.conf.get("spark.checkpoint.dir", None) or "/x")


def test_a_decoder_holds_few_files_at_once(spark):
    """decoder_plugin: texts of a batch come back in parts, in order, failures and missing files too."""
    from loreloom.sources.files import DECODED_AT_ONCE, decoder_column

    n = 2 * DECODED_AT_ONCE + 3
    files = spark.createDataFrame([(i, None if i % 7 == 3 else bytearray(b"\xff" if i % 5 == 0 else b"t%d" % i)) for i in range(n)],
                                  "id bigint, content binary").coalesce(1)
    got = {r.id: r.out for r in files.select("id", decoder_column(F.col("content"), lambda data: data.decode(), "Failed").alias("out")).collect()}
    for i in range(n):
        if i % 7 == 3:
            assert got[i].text is None and got[i].error == "Failed: no content"
        elif i % 5 == 0:
            assert got[i].text is None and got[i].error.startswith("Failed: 'utf-8'")
        else:
            assert tuple(got[i]) == (f"t{i}", None)
