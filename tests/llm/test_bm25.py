import math
import random
from collections import Counter

import pytest

from loreloom.llm.bm25 import B, K1, Index, contaminated, grams, index_blocks, parts_of, words_of


def plain_scores(items, query, total_items=None):
    """Share of the item's own BM25 score that the distinct query words bring, by item place."""
    n, mean = len(items), sum(map(len, items)) / len(items)
    df = Counter(w for words in items for w in set(words))
    for place, words in enumerate(items):
        tf = Counter(words)
        part = {w: math.log1p((n - df[w] + .5) / (df[w] + .5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean))
                for w, c in tf.items()}
        yield place, sum(v for w, v in part.items() if w in query) / sum(part.values())


def build(items):
    df = Counter(w for words in items for w in set(words))
    return Index.build(list(enumerate(items)), df, len(items), sum(map(len, items)) / len(items), 64)


@pytest.mark.parametrize("seed", range(6))
def test_wand_retrieves_all_above_the_threshold(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    items = [rng.choices(vocabulary, weights, k=rng.randint(1, 30)) for _ in range(150)]
    index = build(items)
    for _ in range(40):
        query = set(rng.choices(vocabulary, weights, k=rng.randint(1, 25)))
        threshold = rng.choice([0.05, 0.3, 0.5, 0.8])
        got = dict(index.above([index.terms[w] for w in query if w in index.terms], threshold))
        wanted = {p: s for p, s in plain_scores(items, query) if s >= threshold - 1e-9}
        assert got == pytest.approx(wanted)


def width(words):
    size = 64
    while size < len(words):
        size *= 2
    return size


def plain(docs, items, threshold=0.5, q_share=0.6, a_share=0.5, n=3):
    split = [(i, words_of(t)) for i, t in items]
    kept = sorted({(i, tuple(w)) for i, w in split if w and i is not None})
    words = [list(w) for _, w in kept]
    found = {}
    for d, text in docs:
        w = words_of(text)
        for size in {width(x) for x in words}:
            for s in range(0, max(1, len(w) - size // 2), size // 2):
                for place, score in plain_scores(words, set(w[s:s + size])):
                    if score < threshold or width(words[place]) != size:
                        continue
                    around = w[max(0, s - size // 2):s + size + size // 2]
                    shares = []
                    for part in parts_of(words[place]):
                        k = min(n, len(part)) or 1
                        own = grams(part, k)
                        shares.append(len(own & grams(around, k)) / len(own) if own else 1.0)
                    if shares[0] >= q_share and shares[1] >= a_share:
                        key = (d, kept[place][0])
                        old = found.get(key, (0, 0, 0, 0))
                        found[key] = (*map(max, old, (score, *shares)), old[3] + 1)
    return found


@pytest.mark.parametrize("block_items", [5_000, 7])
def test_rows_are_those_of_a_plain_loop(spark, block_items):
    rng = random.Random(9)
    draw = lambda n: " ".join(f"w{min(rng.randrange(200), rng.randrange(200))}" for _ in range(n))
    items = [(i, draw(rng.randint(3, 50)) + ".") for i in range(25)] + [(3, "a second text of three"), (None, "no id here"), (90, ""), (91, None), (92, "one")]
    docs = [(i, draw(rng.randint(0, 300))) for i in range(30)]
    for i in range(0, 30, 2):
        words = docs[i][1].split()
        leak = items[rng.randrange(25)][1].upper().split()
        if i % 4:
            leak[1:2] = ["changed"]
        at = rng.randrange(len(words) + 1)
        docs[i] = (i, " ".join(words[:at] + leak + words[at:]))
    docs += [(100, None), (101, ""), (None, items[4][1]), (102, draw(9000) + " " + items[5][1] + " " + draw(10)), (103, items[2][1][:-8])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items + items[:2], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap, r.passages)
           for r in contaminated(frame, bench, block_items=block_items).collect()}
    wanted = plain(docs, items)
    assert len(wanted) > 10 and got.keys() == wanted.keys()
    for key, value in wanted.items():
        assert got[key] == pytest.approx(value)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert contaminated(docs.limit(0), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert contaminated(docs, bench).count() == 1
    assert list(index_blocks(bench.limit(0), 5)) == []


def test_an_unrelated_long_item_changes_nothing(spark):
    """An item whose question and answer stand 3,000 words apart isn't leaked, however long other items are; and the
    long item itself is found where it stands whole, also twice."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3_000)]
    short = [f"s{i}" for i in range(30)]
    long = [f"l{rng.randrange(5_000)}" for _ in range(8_000)]
    filler = rng.choices(vocabulary, k=3_000)
    docs = [(1, " ".join([*short[:20], *filler, *short[20:]])), (2, " ".join([*filler[:100], *short, *filler[100:200]])),
            (3, " ".join([*filler[:50], *long])), (4, " ".join([*long, *filler, *long])), (4, " ".join([*long, *filler, *long]))]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = [(1, " ".join(short)), (2, " ".join(long))]

    def found(kept):
        made = spark.createDataFrame(kept, "item_id bigint, text string")
        return {(r.doc_id, r.item_id) for r in contaminated(table, made).collect()}

    assert found(items[:1]) == {(2, 1)}
    assert found(items) == {(2, 1), (3, 2), (4, 2)}


def test_blocks_are_bounded_in_words(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50 + i))) for i in range(40)], "item_id bigint, text string")
    blocks = list(index_blocks(items, 1_000, block_words=500))
    assert len(blocks) > 2 and sorted(i for b in blocks for x in b for i in x.items) == list(range(40))
    assert all(len(w) <= x.passage < 2 * max(64, len(w)) for b in blocks for x in b for w in x.words)
