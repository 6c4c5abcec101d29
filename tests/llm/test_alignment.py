import hashlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loreloom.llm.alignment import Aligned, aligned_groups, alignment_digests, links, shared_cuts
from loreloom.llm.byte_tokens import Words, byte_letters, byte_level, piece_model, text_runs, vocabulary_file

A_PATH, B_PATH = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model")
TEXTS = [
    "Hello world", None, "", "Hello world", "naïve café — 日本語のテキスト。", "two\nlines\n\nand more\t", "  spaces  ",
    "<|endoftext|> <s> <0x41>", "a▁b", "emoji 😀😀 ok", "x" * 3000, "Ünïcödé " * 400, "don't can't we'll", "\n", " ", "٣٤ ½ ﬁ",
]


@cache
def libraries(plain):
    model = Tokenizer.from_file(A_PATH)
    model.encode_special_tokens = plain
    return model, SentencePieceProcessor(model_file=B_PATH)


def plain_tokens(text):
    """[(id, bytes)] of both sides straight from the libraries; none where a side does not give the text back."""
    model, pieces = libraries(True)
    value = {c: i for i, c in enumerate(byte_letters())}
    if not text:
        return [], []
    a = [(i, bytes(value[c] for c in model.id_to_token(i))) for i in model.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())
         for i in pieces.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def plain_rows(texts):
    rows, held = [], Counter()
    for text in texts:
        a, b = plain_tokens(text)
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        a, b = spans
        pairs = [(i, j) for i, lo, hi in a for j, l2, h2 in b if lo < h2 and l2 < hi] if len(a) < 2000 else \
            [(i, j) for i, lo, hi in a for j, l2, h2 in b[max(0, lo // 20 - 5):] if lo < h2 and l2 < hi]
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in common:
            groups.append(",".join(str(i) for i, lo, hi in a if start <= lo and hi <= end) + "|"
                          + ",".join(str(j) for j, lo, hi in b if start <= lo and hi <= end))
            start = end
        held.update(set(pairs))
        rows.append((len(a), len(b), len(common), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return [(na, nb, ng, len(p), sum(held[x] == best[x[0]] for x in p), sum(held[x] for x in p), sha) for na, nb, ng, p, sha in rows]


@pytest.mark.parametrize("most_pairs", [500_000, 10])
def test_digests_are_those_of_plain_loops(spark, most_pairs):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(0, "Hello world", 1, "x"), (None, "no id", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a int, pair string").repartition(3)
    got = [tuple(r) for r in alignment_digests(docs, most_pairs=most_pairs).collect()]
    want = [(d, *r) for (d, *_), r in zip(rows, plain_rows([t for _, t, *_ in rows]), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40)),
                min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_cuts_and_links_of_any_sizes(documents):
    a_size, b_size, a_ends, b_ends = [], [], [], []
    for a, b in documents:
        gap = sum(a) - sum(b)
        a_size += [*a, -gap] if gap < 0 else a
        b_size += [*b, gap] if gap > 0 else b
        a_ends.append(len(a_size))
        b_ends.append(len(b_size))
    a_bytes, b_bytes = np.cumsum(a_size), np.cumsum(b_size)
    a_cuts, b_cuts = shared_cuts(a_bytes, b_bytes, np.array(a_ends), np.array(b_ends))
    both = sorted(set(a_bytes.tolist()) & set(b_bytes.tolist()))
    assert a_bytes[a_cuts - 1].tolist() == both == b_bytes[b_cuts - 1].tolist()
    none = np.zeros(0, int)
    at_a, at_b = links(Aligned(none, none, np.array(a_ends), np.array(b_ends), a_cuts, b_cuts, a_bytes, b_bytes))
    want = {(i, j) for i in range(len(a_size)) for j in range(len(b_size))
            if a_bytes[i] - a_size[i] < b_bytes[j] and b_bytes[j] - b_size[j] < a_bytes[i]}
    assert len(at_a) == len(want) and set(zip(at_a.tolist(), at_b.tolist(), strict=True)) == want


def test_an_interval_with_its_only_cut_far_from_the_middle():
    a, b = np.array([1, *range(3, 2001, 2), 2002]), np.array([1, *range(4, 2001, 2), 2002])
    a_cuts, b_cuts = shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
    assert a_cuts.tolist() == [1, len(a)] and b_cuts.tolist() == [1, len(b)]


def test_groups_hold_the_same_bytes(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    a_of, b_of = byte_level(A_PATH, True).token_bytes(), piece_model(B_PATH).token_bytes()
    for row in aligned_groups(docs).collect():
        assert len(row.a_cuts) == len(row.b_cuts)
        i = j = 0
        for p, q in zip(row.a_cuts, row.b_cuts, strict=True):
            assert b"".join(a_of[x] for x in row.a[i:p]) == b"".join(b_of[x] for x in row.b[j:q])
            i, j = p, q
        text = TEXTS[row.doc_id] or ""
        if text and "▁" not in text:
            assert b"".join(a_of[x] for x in row.a) == (" " + text).encode()


@given(st.lists(st.text(alphabet="ab.,'é日 \n\t\r\x1c　☃<|>", max_size=25), min_size=1, max_size=30), st.booleans())
@settings(max_examples=150, deadline=None)
def test_ids_by_words_are_those_of_whole_texts(texts, space):
    model, pieces = libraries(False)
    for start, run in text_runs(pa.array(texts), 60):
        words = Words(run, space)
        ids, counts = words.ids(byte_level(A_PATH, False))
        ends = np.cumsum(counts)
        for k in range(len(run)):
            text = (" " if space else "") + texts[start + k]
            assert ids[ends[k] - counts[k]:ends[k]].tolist() == model.encode(text, add_special_tokens=False).ids
        if space:
            ids, counts = words.ids(piece_model(B_PATH))
            ends = np.cumsum(counts)
            for k in range(len(run)):
                if texts[start + k]:
                    assert ids[ends[k] - counts[k]:ends[k]].tolist() == pieces.encode(texts[start + k])


def test_empty_and_textless_tables(spark):
    assert alignment_digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert [tuple(r)[1:] for r in alignment_digests(spark.createDataFrame([(1,)], "doc_id bigint")).collect()] == [(0, 0, 0, 0, 0, 0, "")]
