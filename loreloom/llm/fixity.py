"""Fixity audit of WARC replicas: Merkle trees over ordered offset ranges, compared from their roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import column_or_null, stored

#: Bytes of a file that one leaf of its tree covers, and children of a node.
RANGE_BYTES = 1 << 16
FANOUT = 16
#: Pages in one WARC file of the registered query.
FILE_PAGES = 256


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record: version, named fields, an empty line, the block, and two line ends. Nulls are
    empty."""
    block = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")).cast("binary")


def laid_out(records: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """``records`` (with page_id and length) with the file and the offset each is written at: end to end,
    ``file_pages`` neighbouring page_ids to a file, in their order. Only what is given is sorted: give digests, not
    records.

    Repeated ids follow each other. Records without id are in files of their own, with negative numbers, one for
    each partition they were in."""
    placed = stored(records.withColumn("_at", F.monotonically_increasing_id()), "laid-out")
    file = F.coalesce(F.floor(F.col("page_id") / file_pages).cast("bigint"), -1 - F.shiftright("_at", 33))
    in_file = Window.partitionBy("file").orderBy("page_id", "_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("file", file).withColumn("offset", F.coalesce(F.sum("length").over(in_file), F.lit(0)).cast("bigint")).drop("_at")


def digests(records: DataFrame) -> DataFrame:
    """(file, offset, length, digest) of records (file, offset, record): SHA-256 of the bytes, one narrow pass."""
    return records.select(column_or_null(records, "file", "bigint").alias("file"), column_or_null(records, "offset", "bigint").alias("offset"),
                          F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))


def tree(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (file, node, hash) of the trees of all files of a digest table, leaves first, roots last.

    A leaf covers the records that begin in ``range_bytes`` bytes of a file, in order of their offsets; a node
    covers ``fanout`` neighbours. Both hash the places and hashes of what they cover, so an empty range differs from
    a lost one. Every group is bounded: a range by the records that begin in it, a node by the fanout. The levels
    are as many as the longest file needs."""
    ranges = leaves.groupBy("file", F.floor(F.col("offset") / range_bytes).alias("node")).agg(F.sha2(F.concat_ws(
        "\n", F.transform(F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))), lambda x: F.concat_ws(
            " ", x["offset"].cast("string"), x["length"].cast("string"), x["digest"]))), 256).alias("hash"))
    levels = [stored(ranges, "merkle")]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        nodes = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(F.sha2(F.concat_ws(
            "\n", F.transform(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), "hash"))), lambda x: F.concat_ws(
                " ", x["at"].cast("string"), x["hash"]))), 256).alias("hash"))
        levels.append(stored(nodes, "merkle"))
        top //= fanout
    return levels


def audit(original: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, length, replica_length, fault): the records in which two digest tables (file, offset, length,
    digest) differ.

    fault is ``changed`` (other bytes of the same length), ``resized``, ``lost`` (not in the replica) or ``foreign``
    (only there). Roots are compared, then the children of nodes that differ, down to the leaf ranges; only the
    records of differing ranges are compared one by one. Trees of replicas that have levels of different number are
    compared at all nodes of the higher levels. A record that stands twice at one offset is compared as often as it
    does. Files or offsets that are null, records of no bytes, and empty tables on either side are compared like any
    other."""
    left, right = (stored(side.select(F.coalesce("file", F.lit(-1)).alias("file"), F.coalesce("offset", F.lit(0)).alias("offset"), "length", "digest"), "fixity")
                   for side in (original, replica))
    trees = [tree(side, range_bytes, fanout) for side in (left, right)]
    height = max(map(len, trees))
    suspects = None  # (file, node) of the level in hand that may differ; None: all
    for level in range(height - 1, -1, -1):
        nodes = [t[level] if level < len(t) else None for t in trees]
        if nodes[0] is None or nodes[1] is None:
            continue  # the higher tree's upper levels have no counterpart
        if suspects is not None:
            nodes = [side.join(suspects, [F.floor(side["node"] / fanout) == F.col("above"), side["file"] == F.col("in_file")], "left_semi") for side in nodes]
        differ = nodes[0].alias("a").join(nodes[1].alias("b"), ["file", "node"], "full").where(
            ~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select("file", "node")
        suspects = stored(differ, "suspects").select(F.col("file").alias("in_file"), F.col("node").alias("above"))
    wrong = suspects
    sides = [side.join(wrong, (F.floor(side["offset"] / range_bytes) == F.col("above")) & (side["file"] == F.col("in_file")), "left_semi")
             .groupBy("file", "offset", "length", "digest").agg(F.count("*").alias("n")) for side in (left, right)]
    # What both hold alike is taken away; what is left at one place of a file faces what is left there in the other.
    both = sides[0].alias("a").join(sides[1].alias("b"), ["file", "offset", "length", "digest"], "full").select(
        "file", "offset", "length", "digest", F.coalesce("a.n", F.lit(0)).alias("here"), F.coalesce("b.n", F.lit(0)).alias("there"))
    numbered = Window.partitionBy("file", "offset").orderBy("length", "digest")
    only = [both.where(F.col(x) > F.col(y)).withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col(x) - F.col(y)).cast("int"))))
            .withColumn("k", F.row_number().over(numbered)).select("file", "offset", "k", "length") for x, y in (("here", "there"), ("there", "here"))]
    return only[0].alias("a").join(only[1].alias("b"), ["file", "offset", "k"], "full").select(
        "file", "offset", F.col("a.length").alias("length"), F.col("b.length").alias("replica_length"),
        F.when(F.col("b.length").isNull(), "lost").when(F.col("a.length").isNull(), "foreign")
        .when(F.col("a.length") != F.col("b.length"), "resized").otherwise("changed").alias("fault"))


def damaged(page_id: Column, record: Column) -> Column:
    """The record as bad storage gives it back, the same at every run: of each 97 pages (by a digest of the id) one
    record is lost (null), one has its middle byte changed, one is cut short by 7 bytes."""
    dice = F.coalesce(F.conv(F.substring(F.md5(page_id.cast("string")), 1, 8), 16, 10).cast("bigint") % 97, F.lit(0))
    length = F.octet_length(record)
    half = F.floor(length / 2).cast("int")
    middle = F.substring(record, half + 1, F.lit(1))
    other = F.unhex(F.lpad(F.hex((F.conv(F.hex(middle), 16, 10).cast("int") + 1) % 256), 2, "0"))
    return F.when(dice == 10, F.lit(None).cast("binary")).when(
        dice == 11, F.concat(F.substring(record, F.lit(1), half), other, F.substring(record, half + 2, length))).when(
        dice == 12, F.substring(record, F.lit(1), length - 7)).otherwise(record)


def audit_pages(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """page_id, file, offset, length, replica_length, fault: an audit of the pages' WARC files against a damaged
    replica of them.

    Whole records are hashed in both replicas, in one narrow pass; from there on only digests and places move.
    Readers look for a record where the original has it, so the replica's records have the original's offsets.
    Repeated pages are records of their own; nulls are empty; other columns are ignored. An empty table gives an
    empty table."""
    page_id = column_or_null(pages, "page_id", "bigint")
    record = warc_record(page_id, column_or_null(pages, "url", "string"), column_or_null(pages, "html", "string"))
    replica = damaged(page_id, record)
    hashed = pages.select(page_id.alias("page_id"), F.octet_length(record).cast("bigint").alias("length"), F.sha2(record, 256).alias("digest"),
                          F.octet_length(replica).cast("bigint").alias("replica_length"), F.sha2(replica, 256).alias("replica_digest"))
    placed = stored(laid_out(hashed, file_pages), "replicas")
    found = stored(audit(placed.select("file", "offset", "length", "digest"), placed.where("replica_digest IS NOT NULL").select(
        "file", "offset", F.col("replica_length").alias("length"), F.col("replica_digest").alias("digest"))), "faults")
    return found.join(placed.select("page_id", "file", "offset"), ["file", "offset"]).select(
        "page_id", "file", "offset", "length", "replica_length", "fault")


ORACLE = f"""
WITH records AS (
    SELECT page_id, concat(
        'WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
        'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: application/http; msgtype=response', chr(13), chr(10), 'Content-Length: ',
        strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS record
    FROM pages
), sized AS (
    SELECT page_id, page_id // {FILE_PAGES} AS file, strlen(record) AS length,
           CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 97 AS dice
    FROM records
), placed AS (
    SELECT *, CAST(coalesce(sum(length) OVER (
        PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM sized
)
SELECT page_id, file, "offset", length, CASE dice WHEN 11 THEN length WHEN 12 THEN length - 7 END AS replica_length,
       CASE dice WHEN 10 THEN 'lost' WHEN 11 THEN 'changed' ELSE 'resized' END AS fault
FROM placed
WHERE dice BETWEEN 10 AND 12
"""
