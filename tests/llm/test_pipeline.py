from collections import defaultdict

import pytest
from test_bm25 import plain as plain_leaks
from test_near_copies import plain_classes
from test_pseudonyms import PYTHON_ANY
from test_pseudonyms import plain as plain_pseudonym

import corpus_pipeline
from loreloom.llm.langid import Reader, fitted
from loreloom.llm.packing import Tokenizer, default_tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key int"


@pytest.fixture(scope="module")
def rows(spark):
    """The table's documents, and hard cases: nulls, no letters, repeated rows, an id with two texts, a long text."""
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    text = given[5][1]
    return given + [(None, None, None, None, None, 1), (9001, "", "en", "s", 0, 1), (9002, "12 34 !!", "en", "s", 8, 1), given[7], given[7],
                    (given[8][0], "The cat and the dog went to the river with that other man.", "en", "s", 5, 1),
                    (None, "Nobody of the house was at home in the evening and the night.", "en", "s", 5, 1), (9003, text * 60, "en", "s", 5, 1)]


def test_stages_are_those_of_plain_loops(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4).cache()
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    net = fitted(docs)
    left = []
    for row in rows:
        text = row[1] or ""
        if not any(c.isalpha() for c in text):
            continue
        if Reader(net).pooled([text.encode()])[0].max() / len(text.encode()) >= 0.3:
            left.append(row)
    stages = dict(corpus_pipeline.STAGES)

    def check(name, frame, wanted):
        out = stages[name](spark, frame, SF)
        assert out.columns == frame.columns
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, out.collect())) == sorted(map(key, wanted))
        return spark.createDataFrame(wanted, COLUMNS).repartition(3)

    docs = check("language", docs, left)
    labels = plain_classes([r[1] or "" for r in left])[1]
    members = defaultdict(list)
    for row, label in zip(left, labels, strict=True):
        members[label].append(row)
    kept, out = [], stages["near_duplicates"](spark, docs, SF)
    for group in members.values():
        least = min((r[0] for r in group if r[0] is not None), default=None)
        kept.append([r for r in group if r[0] == least])
    got = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == len(kept)
    for group in kept:
        assert sum(r in group for r in got) == 1
    docs = spark.createDataFrame(got, COLUMNS).repartition(3)
    leaking = {d for d, _ in plain_leaks([(i, r[1]) for i, r in enumerate(got)], benchmark)}
    left = [r for i, r in enumerate(got) if i not in leaking]
    assert leaking
    docs = check("decontamination", docs, left)
    left = [(r[0], PYTHON_ANY.sub(lambda m: plain_pseudonym(m[0]), r[1]), *r[2:]) for r in left]
    docs = check("pseudonyms", docs, left)
    packed = stages["packing"](spark, docs, SF).collect()
    model = Tokenizer(default_tokenizer())
    assert sum(r.length for r in packed) == sum(len(model.ids(r[1])) + 1 for r in left)
    room = defaultdict(int)
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 1


def test_whole_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
