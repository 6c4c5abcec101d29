import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreloom import constants as K
from loreloom.functions import tags as G
from loreloom.functions import text as X


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def plain_chunks(text, size, overlap):
    tokens, step, out, start = text.split(), size - overlap, [], 0
    while tokens:
        out.append(" ".join(tokens[start:start + size]))
        if start + size >= len(tokens):
            break
        start += step
    return out


TEXTS = [None, "", "   ", "\r\n", " a \r\n\n b\x0bc\x0cd ", "x\x1cy\x1dz\x1e w\x1f", "p\x85q r s", "\xa0t　",
         "one line", "tab\tinside  two"]


def test_normalize_text_equals_python(spark):
    expected = ["\n".join(s.strip() for s in (t or "").splitlines() if s.strip()) for t in TEXTS]
    assert column(spark, TEXTS, X.normalize_text) == expected


def test_words_equal_python_split(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab" + K.BLANKS) for _ in range(rng.randrange(30))) for _ in range(300)]
    assert column(spark, texts, X.words) == [(t or "").split() for t in texts]


def test_utf8_replacement(spark):
    data = [b"a\xffb", b"ok", "é".encode(), b"\xe2\x82"]
    assert column(spark, data, X.decode_utf8, "binary") == [d.decode("utf-8", "replace") for d in data]


def test_chunk_fixture_of_300_words(spark):
    text = "knowledge " * 300
    got = column(spark, [text], lambda c: X.chunk_texts(c, 120, 20))[0]
    assert [len(c.split()) for c in got] == [120, 120, 100]
    assert column(spark, [text], lambda c: X.chunk_texts(c, 120, 20))[0] == got


@pytest.mark.parametrize("size,overlap", [(1, 1), (2, 1), (5, 2), (5, 5), (5, 9), (7, None), (None, None), (None, 0)])
def test_chunk_windows_equal_a_loop(spark, size, overlap):
    resolved, step = X.chunk_window(size, overlap)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 2, 4, 5, 6, 9, 10, 11, 250, 251, 450, 451)]
    got = column(spark, texts, lambda c: X.chunk_texts(c, size, overlap))
    assert got == [plain_chunks(t, resolved, resolved - step) for t in texts]


def test_chunk_window_defaults():
    assert X.chunk_window() == (250, 200)
    assert X.chunk_window(None, 0) == (250, 200)
    assert X.chunk_window(100, 100) == (100, 80)
    assert X.chunk_window(1, 5) == (1, 1)


def test_chunks_minus_overlap_restore_words(spark):
    texts = [" ".join(str(i) for i in range(n)) for n in (1, 30, 31, 99, 100)]
    for text, chunks in zip(texts, column(spark, texts, lambda c: X.chunk_texts(c, 30, 7))):
        joined = chunks[0].split()
        for chunk in chunks[1:]:
            joined += chunk.split()[7:]
        assert joined == text.split()


def test_truncate(spark):
    values = [None, "", "abcde", "abcdef", "abc def", " abcdef", "ab\ncd efgh", "abcd efgh", "ab c\nd e"]

    def plain(v):
        v = v or ""
        return v if len(v) <= 5 else v[:5].rsplit(" ", 1)[0] + "..."

    assert column(spark, values, lambda c: X.truncate(c, 5)) == [plain(v) for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=20), min_size=1, max_size=20), st.integers(1, 12))
def test_truncate_property(spark, values, n):
    got = column(spark, values, lambda c: X.truncate(c, n))
    assert got == [v if len(v) <= n else v[:n].rsplit(" ", 1)[0] + "..." for v in values]


def test_file_suffix(spark):
    names = ["a.txt", "A.PDF", "dir.x/name", ".bashrc", "a.tar.gz", "a.", "x/.b.TXT"]
    assert column(spark, names, X.file_suffix) == [".txt", ".pdf", "", "", ".gz", "", ".txt"]


def test_upload_form(spark):
    assert column(spark, [None, "a.TXT", "b.pdf", "c"], X.upload_type) == ["note", "txt", "pdf", "pdf"]
    rows = spark.createDataFrame([("t", None, "x"), (" ", "f", None), ("t", "f", None), ("t", None, " ")],
                                 "t string, f string, r string")
    got = [r[0] for r in rows.select(X.is_submittable(F.col("t"), F.col("f"), F.col("r"))).collect()]
    assert got == [True, False, True, False]


def test_labels(spark):
    one = spark.range(1)
    lit = F.lit
    row = one.select(
        X.percent(lit(0.125)), X.percent(lit(1.0)), X.relationship_label(lit("works_on")),
        X.enum_label(lit("in_progress"), K.TASK_STATUSES), X.enum_label(lit("odd"), K.TASK_STATUSES),
        X.conversation_label(lit(7), lit("")), X.conversation_label(lit(7), lit("Hi")),
        X.conversation_label(lit(7), lit(""), "Untitled chat"), X.edge_label(lit("A"), lit("uses"), lit("B")),
        X.document_caption(lit("pdf"), lit(3)), X.chunk_label(lit("D"), lit(0)), X.node_label(lit("N"), lit("topic")),
        X.message_label(lit("user"), F.repeat(lit("x"), 100)),
    ).first()
    assert list(row) == ["13%", "100%", "works on", "In Progress", "odd", "Conversation 7", "Hi", "Untitled chat",
                         "A --[uses]--> B", "PDF · 3 chunks", "D - Chunk 0", "N (topic)", "user: " + "x" * 80]
    assert math.floor(0.125 * 100 + 0.5) == 13


def test_tags(spark):
    def plain(tags):
        out = []
        for tag in tags or []:
            value = tag.strip().lower() if tag is not None else ""
            if value and value not in out:
                out.append(value)
        return out[:12]

    lists = [None, [], ["Writing", " concise "], [f"t{i}" for i in range(13)], ["A", "a", " A\t"], ["", "  ", None, "x"]]
    assert column(spark, lists, G.normalize_tags, "array<string>") == [plain(t) for t in lists]
    texts = [None, "", " A, b ,,a", "one"]
    assert column(spark, texts, G.normalize_tag_text) == [[], [], ["a", "b"], ["one"]]
    assert column(spark, texts, G.tags_from_text) == [[], [], ["A", "b", "a"], ["one"]]
    assert column(spark, [["x", "y"]], G.tags_to_text, "array<string>") == ["x, y"]
    assert column(spark, [None, ["Web"], [None]], lambda c: G.any_tag_contains(c, F.lit("wE")), "array<string>") == \
        [False, True, False]
