"""Benchmark decontamination: a BM25 index of test items queried with every training passage by block-max WAND."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null, stored, text_batches

K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")
#: A passage has so many words, for a longer item the next power of two; the next begins half as many later.
PASSAGE = 64
#: Slack of bounds, for sums of the same numbers in different orders.
SLACK = 1e-5
#: Postings in a block of a posting list.
BLOCK = 16
#: The items of an index fall into at most so many equal ranges, each with every term's greatest weight in it.
RANGES = 64


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def parts_of(words: list[str]) -> tuple[list[str], list[str]]:
    """(question, answer): items are one text, of which the last third (one word at least) is the answer."""
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


def passage_words(words: list[str]) -> int:
    """The width of the passages in which an item is looked for: it depends on that item alone."""
    return max(PASSAGE, 1 << (len(words) - 1).bit_length())


def grams(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Runs of ``size`` words; of fewer words, the one run they are."""
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass
class Index:
    """Posting lists in order of item, cut into blocks with their greatest weight.

    A weight is the term's BM25 part in the item's score, divided by the score of the item's own words, so that 1 is
    the score of a passage that holds the whole item."""

    items: list[int]
    words: list[list[str]]
    terms: dict[str, int]
    at: list[np.ndarray]      # by term: places of items, ascending
    weight: list[np.ndarray]  # by term: the weight in each
    greatest: np.ndarray      # by term: over all items
    block_last: list[np.ndarray]  # by term and block: the last item's place
    block_max: list[np.ndarray]
    passage: int
    cuts: np.ndarray          # first places of the ranges, and the number of items
    range_max: np.ndarray     # [terms + 1, ranges]; the last row, of zeros, is for unknown words

    @classmethod
    def build(cls, items: list[tuple[int, list[str]]], frequency: dict[str, int], total: int, mean_length: float,
              passage: int) -> Index:
        """``items`` in any order; document frequency of terms, number and mean length are those of the whole
        benchmark."""
        items = sorted(items)
        found: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for place, (_, words) in enumerate(items):
            counts: dict[str, int] = defaultdict(int)
            for w in words:
                counts[w] += 1
            bulk = K1 * (1 - B + B * len(words) / mean_length)
            parts = {w: np.log1p((total - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + bulk)
                     for w, n in counts.items()}
            own = sum(parts.values())
            for w, part in parts.items():
                found[w].append((place, part / own))
        terms = {w: i for i, w in enumerate(sorted(found))}
        cuts = np.linspace(0, len(items), min(RANGES, -(-len(items) // 8)) + 1).astype(np.int64)
        range_max = np.zeros((len(terms) + 1, len(cuts) - 1), np.float32)
        for w, i in terms.items():
            for place, part in found[w]:
                j = int(np.searchsorted(cuts, place, "right")) - 1
                range_max[i, j] = max(range_max[i, j], np.nextafter(np.float32(part), np.float32(2)))
        at = [np.array([p for p, _ in found[w]], np.int64) for w in terms]
        weight = [np.array([x for _, x in found[w]]) for w in terms]
        return cls([i for i, _ in items], [w for _, w in items], terms, at, weight,
                   np.array([w.max() for w in weight]),
                   [a[np.minimum(np.arange(BLOCK - 1, len(a) + BLOCK - 1, BLOCK), len(a) - 1)] for a in at],
                   [np.maximum.reduceat(w, np.arange(0, len(w), BLOCK)) for w in weight], passage,
                   cuts, range_max)

    def above(self, query: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """(place, score) of every item in [low, high) that scores ``threshold`` or more for the distinct terms
        ``query``.

        Block-max WAND: cursors stand in order of their items. The pivot is the first item whose cursors' list
        maxima reach the threshold; then the maxima of the blocks that hold the pivot are summed, and if they don't
        reach it, all cursors move past the nearest block end. Only what is left is scored."""
        # A hair of slack: an item just at the threshold must not be lost.
        least, high = threshold - SLACK, len(self.items) if high is None else high
        found: list[tuple[int, float]] = []
        cursors: list[list[int]] = []  # item, place in the list, term

        def place(term: int, start: int, target: int) -> None:
            start += int(np.searchsorted(self.at[term][start:], target))
            if start < len(self.at[term]) and self.at[term][start] < high:
                cursors.append([int(self.at[term][start]), start, term])

        for t in query:
            place(t, 0, low)
        while cursors:
            cursors.sort()
            reached = np.flatnonzero(np.cumsum(self.greatest[[t for _, _, t in cursors]]) >= least)
            if not len(reached):
                break
            pivot = int(reached[0])
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, ends = 0.0, []
            for _, _, t in cursors[:pivot + 1]:
                block = int(np.searchsorted(self.block_last[t], item))
                if block < len(self.block_last[t]):
                    bound += self.block_max[t][block]
                    ends.append(int(self.block_last[t][block]))
            if bound < least:
                target, moved = min([*(end + 1 for end in ends), *(c[0] for c in cursors[pivot + 1:pivot + 2])]), pivot + 1
            elif cursors[0][0] == item:
                score = float(sum(self.weight[t][p] for _, p, t in cursors[:pivot + 1]))
                if score >= threshold - 1e-9:
                    found.append((item, score))
                target, moved = item + 1, pivot + 1
            else:
                target, moved = item, sum(c[0] < item for c in cursors[:pivot + 1])
            gone = cursors[:moved]
            del cursors[:moved]
            for _, p, t in gone:
                place(t, p, target)
        return found

    def passages_above(self, words: list[str], threshold: float):
        """(first word, place, score) for every passage of a text and every item above the threshold.

        A range of items is searched only if its terms' greatest weights in that range sum to the threshold: else no
        item of it can be a pivot. The sums of all passages come from running sums, in which repeated words count each
        time; those that reach the threshold are summed anew over distinct words."""
        size = self.passage
        step = size // 2
        if not words or not self.terms:
            return
        unknown = len(self.terms)
        ids = np.array(list(map(self.terms.get, words, repeat(unknown))), np.int64)
        # Texts of any length in stretches: the running sums of a stretch are all that is held.
        for base in range(0, max(1, len(words) - step), 1024 * step):
            part = ids[base:base + 1024 * step + size]
            starts = np.arange(0, min(1024 * step, max(1, len(words) - step - base)), step)
            sums = np.zeros((len(part) + 1, self.range_max.shape[1]), np.float64)
            np.cumsum(self.range_max[part], 0, out=sums[1:])
            likely = (sums[np.minimum(starts + size, len(part))] - sums[starts] >= threshold - SLACK).any(1)
            for s in starts[likely].tolist():
                query = np.unique(part[s:s + size])
                query = query[query != unknown]
                for j in np.flatnonzero(self.range_max[query].sum(0) >= threshold - SLACK).tolist():
                    own = query[self.range_max[query, j] > 0].tolist()
                    for place, score in self.above(own, threshold, int(self.cuts[j]), int(self.cuts[j + 1])):
                        yield base + s, place, score


def _overlap(part: list[str], seen: set, size: int) -> float:
    own = grams(part, min(size, len(part)) or 1)
    return len(own & seen) / len(own) if own else 1.0


def index_blocks(benchmark: DataFrame, block_items: int, identifier: str = "item_id", text: str = "text",
                 block_words: int = 1_000_000):
    """Lists of indexes of the benchmark's items, an index for each passage width; a list has about ``block_items`` items
    and ``block_words`` words at most, and statistics of all items.

    Each is made on the driver from that many items' words; a single item is never split. Items without words or id are left out: nothing can hold
    them."""
    split = F.udf(lambda x: words_of(x), "array<string>")  # a benchmark row each, not a corpus row
    items = stored(benchmark.select(column_or_null(benchmark, identifier, "bigint").alias("item_id"),
                                    split(column_or_null(benchmark, text, "string")).alias("words"))
                   .where(F.col("item_id").isNotNull() & (F.size("words") > 0)).distinct(), "items")
    total, mean, length = items.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.size("words"))).first()
    if not total:
        return
    frequency = stored(items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "terms")
    blocks = max(-(-total // block_items), -(-length // block_words))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        terms = part.select(F.explode("words").alias("term")).distinct()
        counts = {r.term: r.n for r in frequency.join(terms, "term").toLocalIterator()}
        widths: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
        for r in part.toLocalIterator():
            widths[passage_words(r.words)].append((r.item_id, list(r.words)))
        if widths:
            yield [Index.build(rows, counts, total, mean, width) for width, rows in sorted(widths.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question_share: float = 0.6,
                 answer_share: float = 0.5, gram: int = 3, block_items: int = 5_000, identifier: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passages): the items that each document leaks.

    Every passage of every whole text (64 words, or for longer items the next power of two; the next begins half as many
    later) is a query to the items of its width, so an item's result does not hang on how long others are. An item scores its share of the score of all its words; all items with ``threshold`` or more
    are retrieved, by block-max WAND. Each is verified: of the runs of ``gram`` words of its question and of its
    answer, at least the given shares must stand in the passage or the passage before or after it. ``passages``
    counts those that pass; score and overlaps are the best of them.

    The index is broadcast in the tasks' closure, ``block_items`` items at a time; a larger benchmark takes a pass
    over the documents for each block. Repeated items (equal id and text) count once; items of one id with different
    texts each do, and the best is returned. Null and empty texts, and items without words, leak nothing. A row
    without id is reported with a null doc_id, repeated rows are one. An empty table on either side gives an empty
    table. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    rows = docs.select(column_or_null(docs, identifier, "bigint").alias("doc_id"), column_or_null(docs, text, "string").alias("text"))
    found = None
    for indexes in index_blocks(benchmark, block_items):
        part = _search(rows, spark.sparkContext.broadcast(indexes), schema, threshold, question_share, answer_share, gram)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", passages bigint")
    return found.groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"),
        F.max("answer_overlap").alias("answer_overlap"), F.count("*").alias("passages"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question_share: float = 0.6, answer_share: float = 0.5,
                  gram: int = 3, block_items: int = 5_000, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text leaks no item; see ``contaminated``. A narrow pass, or one for each block of
    items; rows keep their columns, and ids play no role."""
    spark = docs.sparkSession
    for indexes in index_blocks(benchmark, block_items):
        docs = docs.where(~_leaking(spark.sparkContext.broadcast(indexes), threshold, question_share, answer_share, gram)(
            F.col(f"`{text}`").cast("string")))
    return docs


def _leaking(shared, threshold, question_share, answer_share, gram):
    @F.pandas_udf("boolean")
    def leaking(texts):
        indexes = shared.value
        return texts.map(lambda x: any(True for _ in leaks(indexes, x, threshold, question_share, answer_share, gram))).astype(bool)

    return leaking


def leaks(indexes: list[Index], text: str | None, threshold: float, question_share: float, answer_share: float, gram: int):
    """(item, score, question overlap, answer overlap) of each passage that leaks an item."""
    words = words_of(text)
    for index in indexes:
        near, near_at = None, -1
        for s, place, score in index.passages_above(words, threshold):
            if s != near_at:
                around = words[max(0, s - index.passage // 2):s + index.passage + index.passage // 2]
                near, near_at = {n: grams(around, n) for n in range(1, gram + 1)}, s
            question, answer = parts_of(index.words[place])
            q = _overlap(question, near[min(gram, len(question)) or 1], gram)
            a = _overlap(answer, near[min(gram, len(answer)) or 1], gram)
            if q >= question_share and a >= answer_share:
                yield index.items[place], score, q, a


def _search(rows, shared, schema, threshold, question_share, answer_share, gram) -> DataFrame:
    def run(batches):
        indexes = shared.value
        for batch in batches:
            ids = batch.column(0)
            for start, texts in text_batches(batch, "text"):
                out = [(ids[start + i].as_py(), *x) for i, text in enumerate(texts)
                       for x in leaks(indexes, text, threshold, question_share, answer_share, gram)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (
                            pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return rows.mapInArrow(run, schema)
