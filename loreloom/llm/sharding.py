"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null, stored

SHARDS = 24
_AT = "_shuffle_at"


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` taken without putting back, for numbers of any size.

    Inversion outwards from the mode: about as many steps as standard deviations are wide."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while left >= 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left < 0:
                return down
    return mode


def communication_matrix(counts: list[int], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """How many rows of each part go to each shard in a uniform shuffle: row sums ``counts``, column sums ``sizes``.
    """
    room, matrix = list(sizes), []
    for count in counts:
        left, rest, row = count, sum(room), []
        for j, free in enumerate(room):
            rest -= free
            took = hypergeometric(rng, free, rest, left)
            row.append(took)
            room[j] -= took
            left -= took
        matrix.append(row)
    return matrix


def _part(splits: int, total: int, part_rows: int, most: int) -> Column:
    """The part of a place: up to ``part_rows`` neighbouring rows of an input partition, of several partitions where
    there are more than ``most``. About ``most`` parts at least hold more rows each, so that there are not more than
    about twice as many."""
    part_rows = max(part_rows, -(-total // most))
    merged = -(-splits // most)
    piece = F.floor(F.col(_AT).bitwiseAND((1 << 33) - 1) / F.lit(max(1, part_rows // merged))).cast("bigint")
    return F.shiftleft(piece, 20) + F.pmod(F.shiftright(_AT, 33), F.lit(min(most, 1 << 20)))


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = 0, slot_rows: int = 65_536, most_parts: int = 16_384) -> DataFrame:
    """``rows`` with shard (0 to shards - 1) and slot (gapless from 0 in a shard): a uniform random permutation, cut
    into shards whose row counts differ by one at most.

    The rows are written once with a place number, so that a recomputed task deals as its first attempt did. Parts of
    ``slot_rows`` rows (more, where that makes over ``most_parts`` parts; a large input partition is several parts, many
    small ones share one) are counted, and the matrix of part-to-shard counts is drawn on the driver from these counts,
    at most about twice ``most_parts`` of them. A part permutes its places (by a hash of place and seed) and deals
    them to shards as its line of the matrix says: where the permutation goes on to the next shard is all that its rows
    need to know. Whole rows move once, to their shard's buckets, each about ``slot_rows`` rows,
    and are permuted again there. No task sees more than a part or a bucket, whatever the rows hold: keys and equal
    rows play no role.

    Every row is dealt, repeated and null ones too. Columns named shard or slot are replaced. An empty table stays
    empty.
    """
    spark = rows.sparkSession
    # The row goes as one struct: no column of it can clash with those added here.
    placed = stored(rows.drop("shard", "slot").select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias(_AT)), "shuffled")
    splits, total = placed.agg(F.coalesce(F.max(F.shiftright(_AT, 33)), F.lit(0)) + 1, F.count("*")).first()
    part = _part(splits, total, slot_rows, most_parts)
    counted = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    known = sorted(counted)
    matrix = communication_matrix([counted[p] for p in known], sizes, random.Random(f"{seed}/{total}"))
    ends = [[sum(row[:j + 1]) for j in range(shards)] for row in matrix]
    lines = spark.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps([{"_part": p, "_end": e} for p, row in zip(known, ends, strict=True) for e in row])),
        "array<struct<_part: bigint, _end: bigint>>")).alias("l")).select("l.*")
    first, second = (F.xxhash64(F.lit(f"{seed}/{k}"), F.col(_AT)) for k in ("part", "shard"))
    # Where a part's permutation goes on to the next shard: its last place before, by hash. Shards that
    # no row is before have none; the last one always has.
    ranked = placed.select(part.alias("_part"), first.alias("_first"), _AT).withColumn(
        "_end", F.row_number().over(Window.partitionBy("_part").orderBy("_first", _AT)).cast("bigint"))
    cuts = stored(ranked.join(F.broadcast(lines), ["_part", "_end"]).groupBy("_part").agg(
        F.collect_list(F.struct("_first", _AT)).alias("_cuts")), "cuts")
    behind = lambda cut: (cut["_first"] < F.col("_hash")) | ((cut["_first"] == F.col("_hash")) & (cut[_AT] < F.col(_AT)))
    dealt = placed.withColumns({"_part": part, "_hash": first}).join(F.broadcast(cuts), "_part").withColumn(
        "shard", F.lit(shards) - F.size("_cuts") + F.size(F.filter("_cuts", behind)))
    buckets = max(1, -(-total // (shards * slot_rows)))
    # The buckets of a shard are in order of the high bits of a hash, their rows in order of all of it.
    dealt = dealt.withColumn("_order", F.shiftrightunsigned(second, 1)).withColumn(
        "_bucket", F.floor(F.shiftrightunsigned("_order", 31) * F.lit(buckets) / F.lit(2**32)).cast("bigint")) \
        .drop("_part", "_cuts", "_hash")
    sizes_of = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes_of.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_order", _AT)
    return dealt.withColumn("_row", F.row_number().over(inside)).join(offsets, ["shard", "_bucket"]).withColumn(
        "slot", (F.col("_first") + F.col("_row") - 1).cast("bigint")).select("row.*", "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """A folder for each shard, rows in order of their slots, in files of neighbouring slots."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.mode("errorifexists").partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: the shards' row counts are at most one apart. size is the text's UTF-8 bytes and 8; a null text
    has no bytes and the checksum of none. A uniform shuffle keeps no groups together: equal texts are dealt one by
    one. grown_shard is null. Repeated rows and rows without id are dealt like others; other columns are ignored.
    Documents pass through the exchange with their texts: size and checksum are those of the row that arrived."""
    whole = docs.select(column_or_null(docs, "doc_id", "bigint").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(whole, shards, seed).select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
