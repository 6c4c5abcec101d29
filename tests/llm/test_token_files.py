import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreloom.llm import token_files
from loreloom.llm.byte_tokens import vocabulary_file
from loreloom.llm.token_files import Codebook, code_lengths, decode_runs, read_tokens, token_digests, write_tokens

SCHEMA = "doc_id bigint, text string, n bigint, start string, ids int"


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    return cost


def plain(rows):
    """What the query has to return, from the library alone: {(doc_id, start, n, crc)} as a list."""
    model = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    return [(d, np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for d, t in rows]


@given(st.lists(st.integers(1, 10_000), min_size=2, max_size=60), st.integers(6, 18))
@settings(max_examples=150, deadline=None)
def test_code_lengths_make_a_whole_code_within_the_limit(counts, limit):
    bits = code_lengths(np.array(counts), limit)
    assert bits.max() <= limit and sum(2.0 ** -b for b in bits) == 1
    assert (bits @ counts) >= huffman_cost(counts)
    if limit == 18 and max(code_lengths(np.array(counts), 40)) <= 18:
        assert bits @ counts == huffman_cost(counts)


def test_limited_code_is_the_best_of_all_small_codes():
    counts = np.array([1, 1, 2, 3, 5, 8])
    best = min(
        sum(b * c for b, c in zip(bits, counts, strict=True))
        for bits in np.ndindex(*[3] * 6) if sum(2.0 ** -(b + 1) for b in bits) <= 1
        for bits in [[b + 1 for b in bits]])
    assert code_lengths(counts, 3) @ counts == best


def test_too_many_symbols_and_few():
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)
    assert code_lengths(np.array([7])).tolist() == [1] and code_lengths(np.array([], int)).tolist() == []


def test_canonical_codes_ascend():
    book = Codebook(np.array([9, 4, 7, 1]), np.array([2, 1, 3, 3]))
    assert book.ids.tolist() == [4, 9, 1, 7]
    assert [book.code_of[i] for i in (4, 9, 1, 7)] == [0, 0b10, 0b110, 0b111]


@given(st.lists(st.integers(0, 30), min_size=1, max_size=400))
@settings(max_examples=80, deadline=None)
def test_runs_decode_to_what_was_coded(ids):
    ids = np.array(ids)
    used, counts = np.unique(ids, return_counts=True)
    book = Codebook(used, code_lengths(counts))
    codes, runs = book.coded(ids)
    runs = np.frombuffer(runs, "<u2").astype(np.int64)
    sizes = np.full(len(runs), token_files.RUN)
    sizes[-1] = len(ids) - (len(runs) - 1) * token_files.RUN
    data = np.concatenate((np.frombuffer(codes, np.uint8), np.zeros(4, np.uint8)))
    assert decode_runs(data, np.cumsum(runs) - runs, sizes, book.table(), book.most).tolist() == ids.tolist()


def test_crc_of_parts():
    message = bytes(range(256)) * 9
    for cut in (0, 1, 4, 1000, len(message)):
        whole = token_files._shifted(zlib.crc32(message[:cut]), len(message) - cut) ^ zlib.crc32(message[cut:])
        assert whole == zlib.crc32(message)


@pytest.fixture
def rows():
    long = "один two trois   четыре\n" * 9000
    return [(5, "Hello, world! <|endoftext|> tail"), (2, None), (3, ""), (None, "no id\n\nat all"), (7, long), (4, "same"),
            (4, "same"), (4, "other"), (-3, "negative 日本語 \t end "), (9, "!!!")]


def test_files_give_back_every_document(spark, rows, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE_IDS", 700)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    docs = spark.createDataFrame([(d, t, 0, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in token_digests(docs).collect()]
    want = plain(rows)
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == sorted(
        (d is not None, d or 0, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    upto = 0
    previous = (False, 0)
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == upto and (d is not None, d or 0) >= previous
        upto, previous = upto + n, (d is not None, d or 0)


def test_ids_are_those_of_the_library(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE_IDS", 1 << 12)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    write_tokens(docs, str(tmp_path / "f"), part_ids=5000)
    pieces = sorted(read_tokens(spark, str(tmp_path / "f")).collect(), key=lambda r: (r.start, r.before))
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4")
    ordered = sorted(plain(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(ids) == sum(len(x) for _, x in ordered)
    for d, x in ordered:
        if d != 4:
            own = np.frombuffer(b"".join(bytes(r.ids) for r in pieces if r.doc_id == d), "<u4")
            assert own.tolist() == x.tolist()


def test_a_damaged_block_is_an_error(spark, tmp_path):
    folder = str(tmp_path / "f")
    write_tokens(spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string"), folder)
    block = bytearray(spark.read.parquet(f"{folder}/blocks").first().data)
    block[-1] ^= 16
    with pytest.raises(ValueError):
        token_files._decoded(bytes(block), 0, None, 1, False)


def test_empty_and_textless_tables(spark):
    assert token_digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert [r.n_tokens for r in token_digests(spark.createDataFrame([(1,), (2,)], "doc_id bigint")).collect()] == [1, 1]
