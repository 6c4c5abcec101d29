import time

import pytest
from pyspark.sql import functions as F

from loreloom.functions.embedding import HashingEmbedder
from loreloom.plans.ingest import ingest_uploads
from loreloom.streaming import versions
from loreloom.streaming.ingest import current_chunks, current_documents, document_stream
from loreloom.streaming.uploads import TIMED_OUT, current_graph, start_uploads, upload_outcomes

SCHEMA = ("id bigint, owner string, title string, file_type string, file_name string, file_size bigint, source_url string, "
          "raw_text string, processing_status string, updated_at timestamp")
SMALL = HashingEmbedder(8)


def row(i, version, text, kind="note", status="pending", title=None):
    return (i, "o", title or f"v{version}", kind, None, 10, None, text, status, version)


@pytest.fixture()
def stream(spark, tmp_path, as_of):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def frame(rows):
        made = spark.createDataFrame(rows, SCHEMA.replace("updated_at timestamp", "at bigint"))
        return made.withColumn("updated_at", F.timestamp_seconds("at")).drop("at")

    def put(name, rows):
        frame(rows).coalesce(1).write.parquet(f"{source}/{name}")

    def run(wait_ms=3_600_000, per_batch=1):
        docs = document_stream(spark, f"{source}/*", frame([]).schema, per_batch)
        start_uploads(docs, out, as_of=as_of, wait_ms=wait_ms, embedder=SMALL).awaitTermination()

    return put, run, out, frame


VERSIONS = [
    [row(1, 1, "Old Name here"), row(2, 1, "Rome and Paris"), row(3, 5, "x", kind="docx")],
    [row(1, 3, "New Name here. Rome"), row(1, 2, "Middle Name"), row(2, 1, "Rome and Paris")],
    [row(1, 2, "Middle Name"), row(2, 1, "Rome and Paris"), row(3, 4, "fine text"), row(4, 1, " ")],
]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_any_order_gives_the_newest_versions(spark, stream, as_of, order):
    put, run, out, frame = stream
    for n, i in enumerate(order):
        put(f"b{n}", VERSIONS[i])
        run()
    run()
    outcomes = {r.id: (r.title, r.outcome) for r in upload_outcomes(spark, out).collect()}
    newest = frame([VERSIONS[1][0], VERSIONS[0][1], VERSIONS[0][2], VERSIONS[2][3]])
    want = ingest_uploads(newest, as_of, embedder=SMALL)
    expected = {r.id: (r.title, r.processing_status) for r in want.ingested.documents.collect()}
    expected |= {r.id: (r.title, "refused: " + r.error.field) for r in want.refused.collect()}
    assert outcomes == expected
    texts = {r.document_id: r.content for r in current_chunks(spark, out).collect()}
    assert texts[1] == "New Name here. Rome" and texts[2] == "Rome and Paris"
    graph = current_graph(spark, out)
    names = [r.title for r in graph["nodes"].collect()]
    assert len(names) == len(set(names)) and {"New Name", "Rome", "Paris"} <= set(names)
    ids = {r.title: r.id for r in graph["nodes"].collect()}
    links = [(r.node_id, r.document_id) for r in graph["node_documents"].collect()]
    assert len(links) == len(set(links)) and {(ids["Rome"], 1), (ids["Rome"], 2), (ids["Paris"], 2)} <= set(links)
    edges = [r.id for r in graph["edges"].collect()]
    assert len(edges) == len(set(edges)) >= 2


def test_a_document_that_stays_in_processing_fails(spark, stream):
    put, run, out, _ = stream
    put("a", [row(1, 1, "one", status="processing"), row(2, 1, "two", status="processing"), row(3, 1, "three")])
    run()
    assert {r.id for r in current_documents(spark, out).collect()} == {3}
    put("b", [row(2, 2, "two is done")])
    run(wait_ms=1)
    assert {r.id: r.processing_status for r in current_documents(spark, out).collect()} == {2: "completed", 3: "completed"}
    put("c", [row(4, 1, "four", status="processing")])
    run(wait_ms=1)
    time.sleep(0.1)
    put("d", [row(5, 1, "five")])
    run(wait_ms=1)
    found = {r.id: (r.processing_status, r.processing_error) for r in current_documents(spark, out).collect()}
    assert found[4] == ("failed", TIMED_OUT) and found[5][0] == "completed" and 1 not in found


def test_a_restart_from_lost_progress_repeats_without_harm(spark, stream, as_of, tmp_path):
    """Progress lost: everything comes again, as another run into the same output."""
    put, run, out, frame = stream
    put("a", VERSIONS[0])
    run()
    first = {n: t.count() for n, t in current_graph(spark, out).items()}
    docs = document_stream(spark, f"{tmp_path}/in/*", frame([]).schema)
    start_uploads(docs, out, checkpoint=str(tmp_path / "other"), as_of=as_of, embedder=SMALL).awaitTermination()
    assert {n: t.count() for n, t in current_graph(spark, out).items()} == first
    assert current_documents(spark, out).count() == 2 and current_chunks(spark, out).count() == 2


def test_documents_that_share_a_part_of_the_state_keep_their_own_versions_and_timers(spark, stream, monkeypatch):
    """State is asked once for a part, not once for a document; one document's timer is not lost with another's."""
    monkeypatch.setattr(versions, "PARTS", 1)
    put, run, out, _ = stream
    put("a", [row(i, 1, f"text {i}", status="processing") for i in range(1, 5)] + [row(9, 3, "nine"), row(9, 2, "old nine")])
    run(wait_ms=1)
    time.sleep(0.1)
    # In the batch in which the others are given up 2 goes on, 9 comes late.
    put("b", [row(2, 2, "two is done"), row(9, 1, "oldest nine")])
    run(wait_ms=1)
    put("c", [row(5, 1, "five"), row(3, 2, "three is done")])
    run(wait_ms=1)
    found = {r.id: (r.processing_status, r.processing_error) for r in current_documents(spark, out).collect()}
    failed = ("failed", TIMED_OUT)
    assert {i: found[i] for i in (1, 4)} == {1: failed, 4: failed}
    assert {i: found[i][0] for i in (2, 3, 5, 9)} == dict.fromkeys((2, 3, 5, 9), "completed")
    titles = {r.id: r.title for r in upload_outcomes(spark, out).collect()}
    assert titles[9] == "v3" and titles[2] == "v2" and titles[3] == "v2"
    # The state holds one value for the part, whatever the number of documents.
    assert spark.read.format("statestore").option("stateVarName", "part").load(f"{out}/_progress").count() == 1
