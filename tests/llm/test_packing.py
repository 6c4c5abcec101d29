import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer as Model

from loreloom.llm.packing import (CAPACITY, Tokenizer, best_fit, crossover, default_tokenizer, evolve, first_packing, pack,
                                  pack_documents)

TEXTS = ["", None, "A plain text.", "  two  blanks\n\n\nand\tlines\r\n", "É ü ñ ß İstanbul don't it's 'll ", "<|endoftext|>x <|startoftext|>",
         "a b c\u0085d\x1ce", "é ́x ﬁ 日本語 🙂", "word " * 5000, "x" * 9000, "Él's Éa, ÀB!! Aa. aA ǅ. a.b, İ. ŉ ß$$ d' d. ...", "퟿ 123 4.5e6 $$$ ### a_b"]


def test_ids_are_those_of_the_whole_text():
    own, model = Tokenizer(default_tokenizer(), remember=3), Model.from_file(default_tokenizer())
    for text in TEXTS:
        assert own.ids(text or "").tolist() == model.encode(text or "", add_special_tokens=False).ids


def test_every_latin_letter():
    own, model = Tokenizer(default_tokenizer()), Model.from_file(default_tokenizer())
    for code in range(33, 0x260):
        for text in (f"x{chr(code)}", f"{chr(code)}.", f"A{chr(code)}b!"):
            assert own.ids(text).tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_rows(spark):
    model = Model.from_file(default_tokenizer())
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 1), (None, "no id", 1)] + [(100 + i, "w " * (i * 37 % 900), 1) for i in range(80)]
    out = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string, offset int").repartition(3)).collect()
    wanted = []
    for i, text, _ in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            wanted.append((i if i is not None else -1, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(wanted)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= CAPACITY
    assert len(sequences) <= -(-sum(r.length for r in out) // CAPACITY) + 1


@pytest.mark.parametrize("block", [3000, 40])
def test_items_are_packed_once_and_tightly(spark, monkeypatch, block):
    rng = random.Random(2)
    sizes = [min(2048, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(700)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item bigint, size bigint")
    got = pack(items, block_pieces=block).collect()
    assert sorted(r.item for r in got) == list(range(700))
    filled = defaultdict(int)
    for r in got:
        filled[r.sequence_id] += sizes[r.item]
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(sizes) // 2048) * (1.02 if block == 3000 else 1.1) + 1


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    a, b = (first_packing(sizes, 100, rng, greedy) for greedy in (True, False))
    for _ in range(20):
        child = crossover(a, b, sizes, 100, rng)
        assert sorted(p for x in child for p in x) == list(range(200))
        assert all(sum(sizes[p] for p in x) <= 100 for x in child)
        a, b = child, a


def test_evolution_betters_best_fit():
    # Best fit, largest first, needs a bin more than the best packing here.
    sizes, rng = [51, 27, 26, 23] * 12 + [26, 25, 24, 25] * 6 + [49, 49, 2] * 3, random.Random(4)
    start = [first_packing(sizes, 100, rng, i == 0) for i in range(4)]
    best = evolve(sizes, 100, start, rng, children=80)[0]
    assert len(best) <= min(map(len, start)) and sorted(p for b in best for p in b) == list(range(len(sizes)))


def test_best_fit_takes_the_least_room():
    bins, free = [[0], [1]], [30, 20]
    best_fit(bins, free, [2], [70, 80, 20], 100)
    assert bins == [[0], [1, 2]] and free == [30, 0]


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
