"""Alignment of two tokenizers over the same texts: divide and conquer at byte offsets where tokens of both end."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.byte_tokens import Words, byte_level, piece_model, text_runs, vocabulary_file
from loreloom.llm.common import column_or_null, pieces_of, stored
from loreloom.operators.sizing import broadcast_if_bounded, salted_join

#: Ends looked at one by one about the middle of an interval before all of it is searched.
NEAR = 6
#: Id pairs that may be broadcast, in rows and bytes; beyond that they are shuffled.
MOST_PAIRS = 500_000
#: Words that each tokenizer of a worker remembers.
REMEMBER = 250_000


class Aligned(NamedTuple):
    """Tokens of the documents of a run, one after another, and the groups they fall into."""

    a: np.ndarray       # ids of the first tokenizer
    b: np.ndarray
    a_ends: np.ndarray  # tokens of a up to the end of each document
    b_ends: np.ndarray
    a_cuts: np.ndarray  # tokens of a up to the end of each group
    b_cuts: np.ndarray
    a_bytes: np.ndarray  # bytes up to the end of each token
    b_bytes: np.ndarray


def shared_cuts(a_bytes: np.ndarray, b_bytes: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side up to each place where tokens of both end.

    ``a_bytes`` and ``b_bytes`` (rising) are byte offsets of token ends. The intervals to begin with, documents, end at
    ``a_ends`` and ``b_ends`` tokens and have a token of each side at least; their last tokens end at the same byte. An
    interval is cut at a common end near its middle, found by bisecting the other side's ends, and both halves go on. One
    without a common end inside, such as one of a single token, is a group. All intervals of one depth are handled by
    array operations.
    """
    cuts_a, cuts_b = [a_ends], [b_ends]
    a_lo, b_lo = np.concatenate(([0], a_ends[:-1])), np.concatenate(([0], b_ends[:-1]))
    a_hi, b_hi = a_ends, b_ends
    while True:
        open_ = (a_hi - a_lo > 1) & (b_hi - b_lo > 1)
        a_lo, a_hi, b_lo, b_hi = a_lo[open_], a_hi[open_], b_lo[open_], b_hi[open_]
        if not len(a_lo):
            break
        cut_a, cut_b = _near_middle(a_bytes, b_bytes, a_lo, a_hi)
        found = cut_a >= 0
        a_lo, a_hi, b_lo, b_hi, cut_a, cut_b = (x[found] for x in (a_lo, a_hi, b_lo, b_hi, cut_a, cut_b))
        cuts_a.append(cut_a)
        cuts_b.append(cut_b)
        a_lo, a_hi = np.concatenate((a_lo, cut_a)), np.concatenate((cut_a, a_hi))
        b_lo, b_hi = np.concatenate((b_lo, cut_b)), np.concatenate((cut_b, b_hi))
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def _near_middle(a_bytes, b_bytes, a_lo, a_hi) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the tokens of a and b up to the common end nearest its middle token of a; -1 where none is."""
    cut_a, cut_b = np.full(len(a_lo), -1), np.full(len(a_lo), -1)
    middle = (a_lo + a_hi) // 2  # a cut lies between a_lo and a_hi, both excluded
    rest = np.arange(len(a_lo))
    for step in range(NEAR):
        at = middle[rest] + ((step + 1) // 2 if step % 2 else -(step // 2))
        inside = (at > a_lo[rest]) & (at < a_hi[rest])
        place, byte = rest[inside], a_bytes[at[inside] - 1]
        other = np.searchsorted(b_bytes, byte)
        same = b_bytes[other] == byte
        cut_a[place[same]], cut_b[place[same]] = at[inside][same], other[same] + 1
        rest = rest[cut_a[rest] < 0]
        if not len(rest):
            return cut_a, cut_b
    inner = a_hi[rest] - a_lo[rest] - 1
    rest, inner = rest[inner > NEAR - 1], inner[inner > NEAR - 1]
    run, place = pieces_of(inner)
    at = a_lo[rest][run] + 1 + place
    byte = a_bytes[at - 1]
    other = np.searchsorted(b_bytes, byte)
    same = b_bytes[other] == byte
    run, at, other = run[same], at[same], other[same]
    order = np.lexsort((np.abs(at - middle[rest][run]), run))
    first = order[np.unique(run[order], return_index=True)[1]]
    cut_a[rest[run[first]]], cut_b[rest[run[first]]] = at[first], other[first] + 1
    return cut_a, cut_b


def align(texts: pa.Array, a_model, b_model, a_known, b_known) -> Aligned:
    """Tokens and groups of a run of texts. ``a_known`` and ``b_known``: the bytes of each id, and how many they are. A
    text that is empty, or whose tokens don't have the bytes of a blank and the text, has no tokens."""
    words = Words(texts, True)
    (a, a_n), (b, b_n) = words.ids(a_model), words.ids(b_model)
    wrong = np.zeros(len(texts), bool)
    for ids, counts, (bytes_of, _) in ((a, a_n, a_known), (b, b_n, b_known)):
        ends = np.cumsum(counts).tolist()
        start = 0
        listed = ids.tolist()
        for i, (text, end) in enumerate(zip(texts, ends, strict=True)):
            raw = memoryview(text.as_buffer()).cast("B")
            joined = b"".join(map(bytes_of.__getitem__, listed[start:end]))
            wrong[i] |= not raw or joined[:1] != b" " or memoryview(joined)[1:] != raw
            start = end
    if wrong.any():
        a, b = a[~np.repeat(wrong, a_n)], b[~np.repeat(wrong, b_n)]
        a_n, b_n = np.where(wrong, 0, a_n), np.where(wrong, 0, b_n)
    a_bytes, b_bytes = np.cumsum(a_known[1][a]), np.cumsum(b_known[1][b])
    a_ends, b_ends = np.cumsum(a_n), np.cumsum(b_n)
    some = a_n > 0
    a_cuts, b_cuts = shared_cuts(a_bytes, b_bytes, a_ends[some], b_ends[some]) if some.any() else (a_ends[:0], b_ends[:0])
    return Aligned(a, b, a_ends, b_ends, a_cuts, b_cuts, a_bytes, b_bytes)


def links(run: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of a and of b that share bytes. Within a group each stretch between two neighbouring ends
    belongs to one pair, and each pair to one stretch."""
    a_size, b_size = np.diff(run.a_cuts, prepend=0), np.diff(run.b_cuts, prepend=0)
    single = (a_size == 1) & (b_size == 1)
    ends = np.union1d(run.a_bytes[np.repeat(~single, a_size)], run.b_bytes[np.repeat(~single, b_size)])
    return (np.concatenate((run.a_cuts[single] - 1, np.searchsorted(run.a_bytes, ends))),
            np.concatenate((run.b_cuts[single] - 1, np.searchsorted(run.b_bytes, ends))))


def _models(a_path: str, b_path: str):
    a, b = byte_level(a_path, True, REMEMBER), piece_model(b_path, REMEMBER)
    known = []
    for model in (a, b):
        of = model.token_bytes()
        known.append((of, np.fromiter(map(len, of), np.int64, len(of))))
    return a, b, *known


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocabulary_file("byte_bpe_50k.json"), b_path or vocabulary_file("piece_bpe_32k.model")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))


def aligned_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, a, b, a_cuts, b_cuts) of every document: its ids by either tokenizer, and how many of them lie before the
    end of each group. Empty arrays for a text without tokens."""
    a_path, b_path = _paths(a_path, b_path)

    def run(batches):
        models = _models(a_path, b_path)
        for batch in batches:
            for start, texts in text_runs(batch.column(1), 2 << 20):
                found = align(texts, *models)
                group = np.searchsorted(found.a_cuts, found.a_ends, "right")
                shift_a, shift_b = (np.concatenate(([0], ends[:-1])) for ends in (found.a_ends, found.b_ends))
                sizes = np.diff(group, prepend=0)

                def listed(values, ends, kind):
                    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values).cast(kind))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), listed(found.a, found.a_ends, pa.int32()), listed(found.b, found.b_ends, pa.int32()),
                     listed(found.a_cuts - np.repeat(shift_a, sizes), group, pa.int32()),
                     listed(found.b_cuts - np.repeat(shift_b, sizes), group, pa.int32())], names=["doc_id", "a", "b", "a_cuts", "b_cuts"])

    return _documents(docs).mapInArrow(run, "doc_id bigint, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>")


def _written(run: Aligned, write: list[bytes], a_size: int) -> list[str]:
    """For each document the SHA-256 of its groups as text; '' without tokens."""
    a_group, b_group = np.diff(run.a_cuts, prepend=0), np.diff(run.b_cuts, prepend=0)
    codes = np.empty(len(run.a) + len(run.b), np.int64)
    a_last, b_last = np.zeros(len(run.a), np.int64), np.zeros(len(run.b), np.int64)
    a_last[run.a_cuts - 1], b_last[run.b_cuts - 1] = 1, 1
    codes[np.arange(len(run.a)) + np.repeat(run.b_cuts - b_group, a_group)] = 2 * run.a.astype(np.int64) + a_last
    codes[np.arange(len(run.b)) + np.repeat(run.a_cuts, b_group)] = 2 * (a_size + run.b.astype(np.int64)) + b_last
    out, start = [], 0
    for end in (run.a_ends + run.b_ends).tolist():
        text = b"".join(map(write.__getitem__, codes[start:end].tolist()))
        out.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        start = end
    return out


def _digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs that are
    linked (a * 2**32 + b) with how often they are."""

    def run(batches):
        models = _models(a_path, b_path)
        a_size, b_size = len(models[2][0]), len(models[3][0])
        write = [b"%d%s" % (i, s) for i in range(a_size) for s in (b",", b"|")]
        write += [b"%d%s" % (i, s) for i in range(b_size) for s in (b",", b";")]
        for batch in batches:
            for start, texts in text_runs(batch.column(1), 2 << 20):
                found = align(texts, *models)
                at_a, at_b = links(found)
                doc = np.searchsorted(found.a_ends, at_a, "right")
                # Document and pair in one number: vocabularies have far fewer than 2**20 ids, a run fewer than 2**22 texts.
                key = (doc << 40) | (found.a[at_a].astype(np.int64) * b_size + found.b[at_b])
                key, times = np.unique(key, return_counts=True)
                pair = key & ((1 << 40) - 1)
                upto = pa.array(np.searchsorted(key >> 40, np.arange(len(texts) + 1)), pa.int32())
                group = np.diff(np.searchsorted(found.a_cuts, found.a_ends, "right"), prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(np.diff(found.a_ends, prepend=0)), pa.array(np.diff(found.b_ends, prepend=0)),
                     pa.array(group), pa.array(np.bincount(doc, minlength=len(texts))), pa.array(_written(found, write, a_size)),
                     pa.ListArray.from_arrays(upto, pa.array((pair // b_size << 32) | pair % b_size)),
                     pa.ListArray.from_arrays(upto, pa.array(times, pa.int32()))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return _documents(docs).mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
             "pairs array<bigint>, times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) over ``pairs`` of all rows: the rows that hold the pair, and whether no other pair of its id of the
    first tokenizer has more. Counts are added up before they are shuffled."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty, or that a tokenizer does not give back have no tokens: zeros and ''. Each row of the table
    counts as a document, repeated ones too; null ids stay null. Other columns are ignored; an empty table gives an empty
    table.

    Texts are encoded once; rows with their distinct pairs are stored. Counts of pairs are broadcast when they are few;
    else pairs are joined with them by a shuffle in which a frequent pair is dealt to several tasks.
    """
    found = stored(_digests(docs, *_paths(a_path, b_path)).withColumn("place", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(found), "pair-ranks")
    held = found.select("place", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("place", "x.pairs", "x.times") \
        .withColumnRenamed("pairs", "pair")
    if counts.limit(most_pairs + 1).count() <= most_pairs:
        linked = held.join(broadcast_if_bounded(counts, most_pairs), "pair")
    else:
        linked = salted_join(held, counts, ["pair"], F.col("place"))
    sums = linked.groupBy("place").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("bigint")
    return found.drop("pairs", "times").join(sums, "place", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
