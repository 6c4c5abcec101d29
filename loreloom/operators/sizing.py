"""Size checks, salting and paging shared by the operators."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def small_frame(rows: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """A frame for a broadcast join: None when empty, broadcast when at most ``max_rows`` rows.

    Runs ``rows`` once, stopping at ``max_rows + 1``; beyond the bound the frame comes back as it
    was and the join shuffles. Meant for narrow frames of keys and counters.
    """
    head = rows.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return rows
    return F.broadcast(rows.sparkSession.createDataFrame(head, rows.schema)) if head.num_rows else None


def broadcast_if_bounded(rows: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when ``rows`` holds at most ``max_rows`` rows and ``max_bytes`` bytes; without it the join
    shuffles.

    For frames that are cheap to measure: stored tables, key lists.
    """
    width = F.lit(16 * len(rows.columns))
    for field in rows.schema:
        if not isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            width = width + F.coalesce(F.length(F.col(f"`{field.name}`").cast("string")), F.lit(0))
    n, size = rows.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(rows) if n <= max_rows and size <= max_bytes else rows


def attach_pages(parents: DataFrame, pages: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Parents with their pages (id, page, ``column``); a parent without any gets an empty page 0.

    ``keys`` (id) are the parents that have pages. An inner join can split a parent with very many
    pages, which an outer join could not.
    """
    empty = F.array().cast(pages.schema[column].dataType)
    bare = parents.join(keys.distinct(), "id", "left_anti").withColumns({"page": F.lit(0).cast("bigint"), column: empty})
    return pages.join(parents, "id").select(*bare.columns).unionByName(bare)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column,
                salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are split over ``salts`` tasks.

    ``big`` rows get a salt hashed from ``spread`` (a column that varies within a key);
    ``small`` (one row or few per key) is repeated once per salt.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def exact_rank(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column],
               name: str = "rank", fine: Column | None = None, most: int = 100_000) -> DataFrame:
    """1-based position of every row within ``keys`` without sorting a key in one task.

    ``bucket`` must not decrease along ``order``. Buckets are counted first; a running
    sum over the (few) bucket rows gives each bucket its offset, and rows are numbered
    inside their bucket only, so a hot key is spread over its buckets. A bucket of more than ``most`` rows is
    split by ``fine``, which must not decrease along ``order`` either.
    """
    bucketed = rows.withColumn("_bucket", F.struct(bucket.alias("coarse")))
    if fine is not None:
        crowded = small_frame(rows.groupBy(*keys, bucket.alias("coarse")).agg(F.count("*").alias("_n"))
                              .filter(F.col("_n") > most).select(*keys, "coarse", F.lit(True).alias("_crowded")))
        if crowded is not None:
            bucketed = rows.withColumn("coarse", bucket).join(crowded, [*keys, "coarse"], "left").withColumn(
                "_bucket", F.struct("coarse", F.when(F.col("_crowded"), fine).alias("fine"))).drop("coarse", "_crowded")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        bucketed.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )


def page_of_rank(rank: Column, page_rows: int) -> Column:
    return F.floor((rank - 1) / F.lit(page_rows)).cast("bigint")


def id_range(identifier: Column, width: int = 10_000) -> Column:
    """Order-preserving bucket of an integer id: at most ``width`` distinct ids each."""
    return F.floor(identifier / F.lit(width)).cast("bigint")


def ordered_list(item: Column, *order: Column) -> Column:
    """Aggregate: the group's ``item`` values in ``order``. Only for bounded groups."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)],
                                                item.alias("item"))))
    return F.transform(rows, lambda row: row["item"])
