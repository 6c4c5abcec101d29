"""Parquet tables with fixed schemas."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.schemas import TABLES
from loreloom.session import shared_folder


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order and type; absent ones are null."""
    def column(f: T.StructField) -> Column:
        if f.name not in rows.columns:
            return F.lit(None).cast(f.dataType)
        # Equal types need no cast, which nullable elements would forbid.
        same = rows.schema[f.name].dataType.simpleString() == f.dataType.simpleString()
        return F.col(f.name) if same else F.col(f.name).cast(f.dataType)

    return rows.select(*[column(f).alias(f.name) for f in schema])


def append_table(rows: DataFrame, root: str, name: str) -> None:
    """Append. A table with owners has a folder for each, so one tenant's scan skips the others' files."""
    writer = conform(rows, TABLES[name]).write.mode("append")
    if "owner" in TABLES[name].names:
        writer = writer.partitionBy("owner")
    writer.parquet(f"{root.rstrip('/')}/{name}")


def _folder_name(value: str) -> str:
    """A partition value as Spark writes it in a folder name."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)


def replace_owner(changed: dict[str, DataFrame], root: str, owner: str) -> None:
    """Give tables new contents for one owner; all other owners' folders stay untouched.

    All new rows are written to the shared folder first, as they derive from the files they replace, and swapped in
    when every table's are complete. A swap that broke off is repeated by calling this again with the same rows:
    contents, not changes, are written."""
    staged = {name: stored(conform(rows, TABLES[name]).drop("owner"), f"staged-{name}") for name, rows in changed.items()}
    for name, rows in staged.items():
        rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/owner={_folder_name(owner)}")


def write_table(rows: DataFrame, path: str, sort_by: tuple[str, ...] = (),
                partition_by: tuple[str, ...] = ()) -> None:
    """Write to a new folder. Sorting within files makes row-group statistics selective."""
    if sort_by:
        rows = rows.sortWithinPartitions(*sort_by)
    writer = rows.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Use all cores for costly row work when a scan has fewer splits than cores.

    A large table has more splits than cores and comes back unchanged, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def stored(rows: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``rows`` to the shared checkpoint folder and read them back: a table several steps
    scan is computed once, and a lost executor costs no recomputation. ``codec``: another compression than the session's, for
    what would fill the disk."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(path, compression=codec)
    return spark.read.schema(rows.schema).parquet(path)


def with_new_ids(rows: DataFrame, existing: DataFrame | None, name: str = "id") -> DataFrame:
    """``rows`` with ids above all of ``existing``, gapless, one each, and no row in a window of all others.

    The rows are stored first: a recomputed task can't give a row another id."""
    start = (existing.agg(F.max(name)).first()[0] if existing is not None else None) or 0
    placed = stored(rows.drop(name).select("*", F.monotonically_increasing_id().alias("_place")), "numbered")
    part = F.shiftright("_place", 33)
    # A row for each partition of the input.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        name, (F.lit(start + 1) + F.col("_before") + F.col("_place") - F.shiftleft(F.col("_part"), 33)).cast("bigint")).drop(
        "_place", "_part", "_before")


def as_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias(column))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
