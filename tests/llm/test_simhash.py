import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loreloom.llm.simhash import fingerprint, near_duplicates, trie_links


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, budget=3):
    """Component label (least index) of each value, over all pairs."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= budget and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("text", ["", None, " \n", "One", "Two WORDS", "É a b Ü c", "x " * 500, "a\x1cb c d e f"])
def test_fingerprint_is_the_plain_one(text):
    assert fingerprint(text) == plain_fingerprint(text)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=4), st.integers(0, 3), st.integers(0, 2**32))
def test_trie_links_span_all_near_pairs(seeds, budget, seed):
    rng = random.Random(seed)
    values = {v ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for v in seeds for _ in range(8)}
    values = np.array(sorted(v % 2**64 for v in values), np.uint64)
    a, b = trie_links(values, budget)
    label = list(range(len(values)))
    for _ in range(len(values)):
        for x, y in zip(a, b, strict=True):
            assert bin(int(values[x]) ^ int(values[y])).count("1") <= budget
            label[x] = label[y] = min(label[x], label[y])
    assert label == groups([int(v) for v in values], budget)


@pytest.mark.parametrize("hot_rows", [20_000, 3])
def test_components_match_all_pairs(spark, monkeypatch, hot_rows):
    import loreloom.llm.simhash as simhash

    monkeypatch.setattr(simhash.near_components, "__defaults__", (3, hot_rows))
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(60)) for _ in range(12)]
    texts = []
    for text in base:
        for _ in range(5):
            words = text.split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    texts += ["", None, "  ", "one", "one", base[0].upper()]
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    labels = groups(prints)
    least = {}
    for (i, _, _), g in zip(rows, labels, strict=True):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if (least.get(g), i) != (None, None) else None
    wanted = sorted((i if i is not None else -1, f"{p:016x}", least[g])
                    for (i, _, _), p, g in zip(rows, prints, labels, strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id)
                 for r in near_duplicates(frame).collect())
    assert got == wanted


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
