import json

import pytest
from pyspark.sql import functions as F

from loreloom.functions.text import edge_label
from loreloom.operators import graph, maintain
from loreloom.operators.generate import capitalised_phrases, generate, memory_candidate, model_extractor
from loreloom.plans.ingest import upsert_graph
from loreloom.plans.views import graph_data
from loreloom import constants as K


def payloads(spark, *docs):
    rows = [(i, "ada", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(docs, 1)]
    return spark.createDataFrame(rows, "document_id bigint, owner string, payload string")


def n(title, kind="topic", description="d"):
    return {"title": title, "type": kind, "description": description}


def e(source, target, kind="uses", description="e"):
    return {"source": source, "target": target, "type": kind, "description": description}


def edge_names(spark, docs, as_of, **options):
    p = payloads(spark, *docs)
    nodes = graph.upsert_nodes(p, as_of, options.get("existing_nodes"), options.get("strict", False))
    edges = graph.upsert_edges(p, as_of, **options)
    titled = graph.edges_with_titles(edges, nodes)
    label = edge_label(F.col("source_title"), F.col("relationship_type"), F.col("target_title"))
    return {(r[0], r.description) for r in titled.select(label, "description").collect()}


def test_nodes_keep_first_description_and_all_links(spark, as_of):
    p = payloads(spark, {"nodes": [n("A", description="first"), {"title": "B"}, n("A", "person")]},
                 {"nodes": [n("A", description="later"), n("C" * 300)]}, "not json", "{}", '{"nodes": null}')
    nodes = graph.upsert_nodes(p, as_of)
    got = {(r.title, r.node_type): r.description for r in nodes.collect()}
    assert got == {("A", "topic"): "first", ("B", "topic"): "", ("A", "person"): "d", ("C" * 255, "topic"): "d"}
    links = graph.link_nodes(p).join(nodes.select(F.col("id").alias("node_id"), "title", "node_type"), "node_id")
    assert {(r.title, r.node_type, r.document_id) for r in links.collect()} == {
        ("A", "topic", 1), ("B", "topic", 1), ("A", "person", 1), ("A", "topic", 2), ("C" * 255, "topic", 2)}
    assert graph.link_nodes(p, graph.link_nodes(p)).count() == 5


def test_upsert_is_idempotent_and_existing_rows_win(spark, as_of):
    p = payloads(spark, {"nodes": [n("A"), n("B")], "edges": [e("A", "B")]})
    nodes, edges = graph.upsert_nodes(p, as_of), graph.upsert_edges(p, as_of)
    again = payloads(spark, {"nodes": [n("A", description="new"), n("B")], "edges": [e("A", "B", description="new")]})
    nodes2 = graph.upsert_nodes(again, as_of, nodes)
    edges2 = graph.upsert_edges(again, as_of, nodes, edges)
    assert sorted(nodes2.collect()) == sorted(nodes.collect())
    assert edges2.collect() == edges.collect()
    assert edges.first().weight == 1.0
    by_key = graph.link_nodes(again, nodes=nodes2)
    assert sorted(by_key.collect()) == sorted(graph.link_nodes(again).collect())


def test_edges_need_known_endpoints(spark, as_of):
    docs = [{"nodes": [n("A")], "edges": [e("A", "A"), e("A", "nobody"), e("a", "A")]}]
    assert edge_names(spark, docs, as_of) == {("A --[uses]--> A", "e")}


def test_edge_before_its_node_is_skipped_until_the_node_exists(spark, as_of):
    docs = [{"nodes": [n("A")], "edges": [e("A", "B", description="early")]},
            {"nodes": [n("B")], "edges": [e("A", "B", description="in time")]}]
    assert edge_names(spark, docs, as_of) == {("A --[uses]--> B", "in time")}
    assert edge_names(spark, docs[:1] + [{"nodes": [n("B")]}], as_of) == set()


def test_first_edge_wins_and_type_defaults(spark, as_of):
    docs = [{"nodes": [n("A"), n("B")], "edges": [e("A", "B", description="1"), e("A", "B", description="2"),
                                                    {"source": "B", "target": "A"}]}]
    assert edge_names(spark, docs, as_of) == {("A --[uses]--> B", "1"), ("B --[related_to]--> A", "")}


def test_ambiguous_titles(spark, as_of):
    docs = [{"nodes": [n("A"), n("B")], "edges": [e("A", "B", "uses")]},
            {"nodes": [n("A", "person"), n("C")], "edges": [e("B", "C"), e("A", "B", "references"), e("C", "B")]}]
    before = ("A --[uses]--> B", "e")
    assert edge_names(spark, docs, as_of) == {before, ("B --[uses]--> C", "e"), ("C --[uses]--> B", "e")}
    # Strict: the document stops at its ambiguous edge; earlier documents are untouched.
    assert edge_names(spark, docs, as_of, strict=True) == {before, ("B --[uses]--> C", "e")}


def test_incomplete_entries(spark, as_of):
    docs = [{"nodes": [n("A"), {"type": "topic"}, n("B")], "edges": [e("A", "A")]},
            {"nodes": [n("C")], "edges": [e("C", "C"), {"source": "C"}, e("C", "A")]}]
    assert edge_names(spark, docs, as_of) == {("A --[uses]--> A", "e"), ("C --[uses]--> C", "e"), ("C --[uses]--> A", "e")}
    assert edge_names(spark, docs, as_of, strict=True) == {("C --[uses]--> C", "e")}
    titles = {r.title for r in graph.upsert_nodes(payloads(spark, *docs), as_of, strict=True).collect()}
    assert titles == {"A", "C"}


def test_long_titles_never_resolve(spark, as_of):
    long = "x" * 300
    assert edge_names(spark, [{"nodes": [n(long)], "edges": [e(long, long)]}], as_of) == set()


def test_owners_do_not_mix(spark, as_of):
    rows = [(1, "ada", json.dumps({"nodes": [n("A")]})), (2, "grace", json.dumps({"nodes": [n("B")], "edges": [e("A", "B")]}))]
    p = spark.createDataFrame(rows, "document_id bigint, owner string, payload string")
    assert graph.upsert_edges(p, as_of).count() == 0


def test_views(spark, as_of):
    p = payloads(spark, {"nodes": [n("B"), n("A", "odd")], "edges": [e("A", "B", "works_on")]}, {"nodes": [n("B")]})
    nodes, edges = graph.upsert_nodes(p, as_of), graph.upsert_edges(p, as_of)
    listed, titled = graph_data(nodes, edges)
    assert [r.title for r in listed.collect()] == ["A", "B"]
    assert titled.first().relationship_label == "works on"
    docs = spark.createDataFrame([(1, "One"), (2, "Two")], "id bigint, title string")
    detail = graph.node_detail(nodes.unionByName(nodes.limit(1).withColumn("id", F.lit("lonely"))),
                               graph.link_nodes(p), docs, page_rows=1)
    got = {(r.id == "lonely", r.title, r.page): [d.title for d in r.source_documents] for r in detail.collect()}
    assert got[(False, "B", 0)] == ["One"] and got[(False, "B", 1)] == ["Two"]
    assert [v for k, v in got.items() if k[0]] == [[]]
    ok = graph.with_type_check(nodes, "node_type", K.NODE_TYPES)
    assert {r.title: r.type_ok for r in ok.collect()} == {"A": False, "B": True}


def test_links_of_documents_that_come_once_are_not_shuffled(spark):
    p = payloads(spark, {"nodes": [n("A"), n("A"), n("A", "person"), {"title": "B"}, {"type": "topic"}, n("x" * 300), n("x" * 299)]},
                 {"nodes": [n("A")]}, {"edges": []}, {})
    assert graph.each_once(p) and not graph.each_once(p.union(p))
    links = graph.link_nodes(graph.parsed(p), once=True)
    assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
    assert sorted(links.collect()) == sorted(graph.link_nodes(p).collect()) and links.count() == 5
    assert sorted(graph.link_nodes(p, once=True, owner=True).collect()) == sorted(graph.link_nodes(p, owner=True).collect())


@pytest.mark.parametrize("most", [100_000, 3, 0])
def test_node_detail_of_few_and_many_links(spark, as_of, monkeypatch, most):
    """Nodes of parts with many links are ranked in id ranges, others node by node, with the same pages."""
    monkeypatch.setattr(graph, "PART_LINKS", most)
    p = payloads(spark, *[{"nodes": [n("every"), n(f"third {i % 3}"), n(f"own {i}")]} for i in range(12)])
    docs = spark.createDataFrame([(i, f"Document {i}") for i in range(1, 12)], "id bigint, title string")
    nodes = graph.upsert_nodes(p, as_of)
    detail = graph.node_detail(nodes, graph.link_nodes(p), docs, page_rows=4)
    assert detail.columns == [*nodes.columns, "page", "source_documents"]
    wanted = {}
    known = {r.id: r.title for r in docs.collect()}
    of = {}
    for link in graph.link_nodes(p).collect():
        of.setdefault(link.node_id, []).extend([link.document_id] if link.document_id in known else [])
    for node in nodes.collect():
        ids = sorted(of[node.id])
        for page in range(max(1, -(-len(ids) // 4))):
            wanted[node.title, page] = [(i, known[i]) for i in ids[4 * page:4 * page + 4]]
    rows = detail.collect()
    assert len(rows) == len(wanted)
    assert {(r.title, r.page): [(d.id, d.title) for d in r.source_documents] for r in rows} == wanted


def test_default_extractor(spark):
    rows = spark.createDataFrame([("Ada Lovelace met Babbage. Ada Lovelace wrote; Mr Babbage read it",), ("",), ("none",)], "t string")
    got = [json.loads(r[0]) for r in rows.select(capitalised_phrases(F.col("t"))).collect()]
    assert [x["title"] for x in got[0]["nodes"]] == ["Ada Lovelace", "Babbage", "Mr Babbage"]
    assert [(x["source"], x["target"]) for x in got[0]["edges"]] == [("Ada Lovelace", "Babbage"), ("Babbage", "Mr Babbage")]
    assert got[1] == got[2] == {"nodes": [], "edges": []}


def test_model_plug_ins(spark):
    rows = spark.createDataFrame([("fail",), ("hello",), (None,)], "t string")

    def load():
        def model(text):
            if text == "fail":
                raise RuntimeError("down")
            return text.upper()
        return model

    assert [r[0] for r in rows.select(generate(F.col("t"), load)).collect()] == [None, "HELLO", None]
    assert [r[0] for r in rows.select(generate(F.col("t"), None)).collect()] == [None] * 3
    got = [r[0] for r in rows.select(model_extractor(load, 2)(F.col("t"))).collect()]
    assert got == ["FA", "HE", '{"nodes":[],"edges":[]}']


@pytest.mark.parametrize("reply,expected", [
    ('{"title":"T","content":"C"}', ("T", "C", "note")), ('{"title":"T","content":"C","category":"fact"}', ("T", "C", "fact")),
    ('{"title":"T"}', None), ("{}", None), ("oops", None), (None, None),
])
def test_memory_candidates(spark, reply, expected):
    row = spark.createDataFrame([(reply,)], "r string").select(memory_candidate(F.col("r")).alias("c")).first()
    assert (tuple(row.c) if row.c else None) == expected


def test_first_per_key(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    got = maintain.first_per_key(rows, ["k"], ["o"], ["v"]).collect()
    assert {tuple(r) for r in got} == {("a", 1, "y"), ("b", 5, None)}


def _mentioned_often(spark, n=240):
    """n documents that mention a few nodes and edges again and again, some twice, later ones first."""
    rows = []
    for i in reversed(range(n)):
        about = f"seen in {i}"
        rows.append((i, f"o{i % 2}", json.dumps({
            "nodes": [{"title": f"p{i % 3}", "type": "person", "description": about}, {"title": f"c{i % 4}", "type": "company", "description": about}],
            "edges": [{"source": f"p{i % 3}", "target": f"c{i % 4}", "type": "uses", "description": about}]})))
    return spark.createDataFrame(rows + rows[:40], "document_id bigint, owner string, payload string").repartition(3)


def test_edges_of_frequent_mentions_keep_titles_without_a_lookup(spark, as_of):
    """graph_edges_upsert, graph_incremental_upsert: first mentions of few nodes are found by hashing, ids aren't carried through
    shuffles, and titles aren't joined to edges again."""
    p = _mentioned_often(spark)
    g = upsert_graph(p, as_of)
    first = {}
    for i in range(240):
        first.setdefault((f"o{i % 2}", f"p{i % 3}", f"c{i % 4}"), f"seen in {i}")
    titled = graph_data(g.nodes, g.edges)[1]
    assert {(r.owner, r.source_title, r.target_title): r.description for r in titled.collect()} == first and titled.count() == len(first)
    nodes = {(r.id, r.title) for r in g.nodes.collect()}
    assert all({(r.source_id, r.source_title), (r.target_id, r.target_title)} <= nodes for r in titled.collect())
    assert {"source_title", "target_title"} <= set(g.edges.columns)
    stored_ones = g.edges.drop("source_title", "target_title")
    late = upsert_graph(p.withColumn("payload", F.replace("payload", F.lit("uses"), F.lit("knows"))), as_of, g.nodes, g.links, stored_ones)
    both = graph_data(late.nodes, late.edges)[1].collect()
    assert sorted((r.relationship_type, r.owner, r.source_title, r.target_title) for r in both) == sorted(
        (kind, *key) for kind in ("uses", "knows") for key in first)
    assert graph._repeat(graph.node_mentions(p), ["owner", "title", "node_type"])


def test_first_nodes_equal_a_plain_aggregate(spark):
    """Documents without an order come first, as null does in a struct."""
    p = _mentioned_often(spark).withColumn("doc_order", F.when(F.col("document_id") % 50 != 49, F.col("document_id") - 100))
    key = ["owner", "title", "node_type"]
    plain = maintain.first_per_key(graph.node_mentions(p), key, ["doc_order", "pos"], ["description"])
    got = graph.first_nodes(p).select(*plain.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
