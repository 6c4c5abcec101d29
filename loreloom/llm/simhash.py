"""SimHash fingerprints and a binary-trie self-join under a Hamming budget."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null, stored, text_batches
from loreloom.llm.components import connected_components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
# Bits set in each byte value, most significant bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
SEED = 42


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text: bit i is set if over half of its shingles' hashes have it.

    Shingles repeat as they do in the text. A text of fewer words has one shingle, all its words; a text without
    words (or null) has fingerprint 0.
    """
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle_words + 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in
                              zip(starts[:n].tolist(), ends[shingle_words - 1:].tolist(), strict=True)), np.uint64, n)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _row_key(rows: DataFrame, identifier: str, text: str):
    """Equal for rows of equal id and text only; never null."""
    return F.md5(F.concat(F.coalesce(column_or_null(rows, identifier, "string"), F.lit("-")), F.lit("|"),
                          F.coalesce(column_or_null(rows, text, "string"), F.lit(""))))


def _fingerprints(rows: DataFrame, identifier: str, text: str, shingle_words: int) -> DataFrame:
    """(doc_id, key, fingerprint) of every row, one row each."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for start, texts in text_batches(batch, "text"):
                prints = [f"{fingerprint(x, shingle_words):016x}" for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array(prints, pa.string())],
                    names=["doc_id", "key", "fingerprint"])

    return rows.select(column_or_null(rows, identifier, "bigint").alias("doc_id"), _row_key(rows, identifier, text).alias("key"),
                       column_or_null(rows, text, "string").alias("text")).mapInArrow(
                           run, "doc_id bigint, key string, fingerprint string")


def trie_links(values: np.ndarray, budget: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal or near values (unsigned 64-bit, sorted, distinct) that span their links.

    Binary trie self-join: a node is the run of sorted values that share a prefix. Pairs of nodes go
    down together, bit by bit; a pair that takes different branches spends one of ``budget`` bits, and
    a pair that has spent more is dropped with all below it. The first ``skip`` bits are known to be
    equal. All pairs at one depth are handled by array operations.

    Values under one node whose remaining bits fit in the budget left are linked to one of them
    instead of pairwise: the links returned connect exactly what all pairs within the budget connect.
    """
    n = len(values)
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A pair of nodes is [a_lo, a_hi) x [b_lo, b_hi) with the bits spent; a == b for a node with itself.
    lo = np.flatnonzero(np.concatenate(([True], values[1:] >> np.uint64(64 - skip) != values[:-1] >> np.uint64(64 - skip)))) \
        if skip else np.zeros(1, np.int64)
    hi = np.concatenate((lo[1:], [n]))
    keep = hi - lo > 1
    a_lo, a_hi = lo[keep], hi[keep]
    b_lo, b_hi = a_lo.copy(), a_hi.copy()
    spent = np.zeros(len(a_lo), np.int64)
    for depth in range(skip, 64):
        if not len(a_lo):
            break
        rest = 64 - depth
        near = spent + rest <= budget  # whatever follows fits
        if near.any():
            _star(found_a, found_b, a_lo[near], a_hi[near], b_lo[near], b_hi[near])
            a_lo, a_hi, b_lo, b_hi, spent = (x[~near] for x in (a_lo, a_hi, b_lo, b_hi, spent))
        bit = np.uint64(63 - depth)
        ones = np.concatenate(([0], np.cumsum((values >> bit) & np.uint64(1)).astype(np.int64)))
        a_mid = a_hi - (ones[a_hi] - ones[a_lo])
        b_mid = b_hi - (ones[b_hi] - ones[b_lo])
        own = a_lo == b_lo
        pairs = [
            (a_lo, a_mid, b_lo, b_mid, spent, np.ones(len(a_lo), bool)),
            (a_mid, a_hi, b_mid, b_hi, spent, np.ones(len(a_lo), bool)),
            (a_lo, a_mid, b_mid, b_hi, spent + 1, spent < budget),
            (a_mid, a_hi, b_lo, b_mid, spent + 1, (spent < budget) & ~own),
        ]
        a_lo, a_hi, b_lo, b_hi, spent, ok = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ok &= (a_hi > a_lo) & (b_hi > b_lo) & ~((a_lo == b_lo) & (a_hi - a_lo < 2))
        a_lo, a_hi, b_lo, b_hi, spent = (x[ok] for x in (a_lo, a_hi, b_lo, b_hi, spent))
    if len(a_lo):
        _star(found_a, found_b, a_lo, a_hi, b_lo, b_hi)
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _star(found_a, found_b, a_lo, a_hi, b_lo, b_hi) -> None:
    """Links of each pair of nodes that is near throughout: first of a to all of b, first of b to all of a."""
    for own_lo, lo, hi in ((a_lo, b_lo, b_hi), (b_lo, a_lo, a_hi)):
        size = hi - lo
        run = np.repeat(np.arange(len(size)), size)
        place = lo[run] + np.arange(len(run)) - (np.cumsum(size) - size)[run]
        found_a.append(own_lo[run])
        found_b.append(place)


def near_components(fingerprints: DataFrame, budget: int = 3, hot_rows: int = 20_000) -> DataFrame:
    """(fingerprint, root) for the distinct fingerprints that have a partner within ``budget`` bits.

    A 64-bit value is cut into budget + 1 blocks. Two values within the budget agree on one block at
    least, so for each block the values are rotated to begin with it, grouped by it, and joined by a
    trie that starts below it. A block value that more than ``hot_rows`` fingerprints share is split:
    its next ten bits are the trie's upper levels, walked by a join, and each pair of subtrees within
    the budget is a group of its own. No group is capped and no pair is left out.
    """
    prints = stored(fingerprints.select(F.conv("fingerprint", 16, -10).cast("bigint").alias("v"))
                    .where(F.col("v").isNotNull()).distinct(), "fingerprints")
    width = 64 // (budget + 1)
    turns = [i * width for i in range(budget + 1)]
    turned = prints.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("turn"),
                 (F.shiftleft("v", t).bitwiseOR(F.shiftrightunsigned("v", 64 - t)) if t else F.col("v")).alias("v"))
        for t in turns])).alias("x")).select("x.*").withColumn("block", F.shiftrightunsigned("v", 64 - width))
    hot = stored(turned.groupBy("turn", "block").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
                 .select("turn", "block"), "hot-blocks")
    few = hot.limit(100_001).count()
    if few == 0:
        grouped = turned.select("turn", "block", F.lit(0).alias("pair"), "v")
    else:
        keys = F.broadcast(hot) if few <= 100_000 else hot
        grouped = turned.join(keys, ["turn", "block"], "left_anti").select("turn", "block", F.lit(0).alias("pair"), "v") \
            .unionByName(_split_hot(turned.join(keys, ["turn", "block"], "left_semi"), width, budget))

    def run(batches):
        turn, block, pair, value = ([] for _ in range(4))
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            key_change = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
                                        | (columns[2][1:] != columns[2][:-1])) + 1
            cut = 0
            if len(turn) and batch.num_rows and (turn[-1][-1], block[-1][-1], pair[-1][-1]) != tuple(x[0] for x in columns[:3]):
                yield from emit(turn, block, pair, value)
                turn, block, pair, value = ([] for _ in range(4))
            if len(key_change):  # all groups but the last are whole
                cut = key_change[-1]
                for kept, x in zip((turn, block, pair, value), columns, strict=True):
                    kept.append(x[:cut])
                yield from emit(turn, block, pair, value)
                turn, block, pair, value = ([] for _ in range(4))
            for kept, x in zip((turn, block, pair, value), columns, strict=True):
                if len(x[cut:]):
                    kept.append(x[cut:])
        if turn:
            yield from emit(turn, block, pair, value)

    def emit(turn, block, pair, value):
        turn, block, pair, value = (np.concatenate(x) for x in (turn, block, pair, value))
        order = np.lexsort((value.view(np.uint64), pair, block, turn))
        turn, block, pair, value = turn[order], block[order], pair[order], value[order].view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], (turn[1:] != turn[:-1]) | (pair[1:] != pair[:-1]))))
        first = first if not pair.any() else np.flatnonzero(np.concatenate((
            [True], (turn[1:] != turn[:-1]) | (block[1:] != block[:-1]) | (pair[1:] != pair[:-1]))))
        for lo, hi in zip(first, [*first[1:], len(value)], strict=True):
            values = value[lo:hi]
            if len(values) < 2:
                continue
            a, b = trie_links(values, budget, width)
            if len(a):
                t = np.uint64(turn[lo])
                back = (values >> t) | (values << (np.uint64(64) - t)) if t else values
                yield pa.RecordBatch.from_arrays(
                    [pa.array(back[a].view(np.int64)), pa.array(back[b].view(np.int64))], names=["a", "b"])

    links = grouped.repartition("turn", "block", "pair").sortWithinPartitions("turn", "block", "pair", "v") \
        .mapInArrow(run, "a bigint, b bigint")
    return connected_components(links).select(
        F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), F.lower(F.lpad(F.hex("root"), 16, "0")).alias("root"))


def _split_hot(hot: DataFrame, width: int, budget: int, bits: int = 10) -> DataFrame:
    """Rows of hot blocks once for every pair of subtrees, ``bits`` levels down, that they belong to."""
    own = F.shiftrightunsigned(F.shiftleft("v", width), 64 - bits).cast("int")
    masks = [m for m in range(1 << bits) if bin(m).count("1") <= budget]
    other = own.bitwiseXOR(F.col("mask"))
    return hot.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks]))).select(
        "turn", "block",
        (F.least(own, other) * F.lit(1 << bits) + F.greatest(own, other) + F.lit(1)).cast("int").alias("pair"), "v")


def near_duplicates(docs: DataFrame, identifier: str = "doc_id", text: str = "text", budget: int = 3,
                    shingle_words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_root.

    component_id is the smallest doc_id reachable over links of at most ``budget`` differing bits, itself included;
    component_root is the component's smallest fingerprint (as a signed number), which never is null. Equal
    fingerprints always are linked.

    Null and empty texts have fingerprint 0 and are linked like any other. A row whose doc_id is null
    takes part; its component_id is null only if no member has an id. Repeated rows stay, one result
    row each. Other columns are ignored. An empty table gives an empty table.
    """
    prints = stored(_fingerprints(docs, identifier, text, shingle_words), "simhash")
    classes = _classes(prints, budget)
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id", "component_root")


def _classes(prints: DataFrame, budget: int) -> DataFrame:
    """(fingerprint, component_id, component_root) of every distinct fingerprint of (doc_id, fingerprint)."""
    roots = near_components(prints, budget)
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = stored(least.join(roots, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"), "roots")
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        "fingerprint", "component_id", F.col("root").alias("component_root"))


def without_near_duplicates(docs: DataFrame, identifier: str = "doc_id", text: str = "text", budget: int = 3,
                            shingle_words: int = 3) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that with the smallest doc_id. Columns are
    kept.

    Ties (rows of one id with different texts) go to the smallest digest of id and text, and of rows that are equal
    in both any one stays. A component without ids is a component like any other."""
    prints = stored(_fingerprints(docs, identifier, text, shingle_words), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key")
    keys = prints.groupBy("fingerprint", "doc_id", "key").agg(F.count("*").alias("n"))
    kept = keys.join(_classes(prints, budget).select("fingerprint", "component_root"), "fingerprint") \
        .groupBy("component_root").agg(F.min_by(F.struct("key", "n"), first).alias("kept")).select("kept.*")
    kept = stored(kept, "kept")
    # The row goes as one struct: no column of it can clash with those added here.
    left = docs.select(F.struct("*").alias("row"), _row_key(docs, identifier, text).alias("key")).join(kept, "key")
    if kept.where("n > 1").limit(1).count():
        left = left.where("n = 1").unionByName(left.where("n > 1").dropDuplicates(["key"]))
    return left.select("row.*")
