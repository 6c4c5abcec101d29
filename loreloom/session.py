"""Session settings this package relies on, for callers without a configured session."""

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  name: str = "loreloom") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str | None:
    """The shared folder the cluster names; ``default`` only where it names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or default


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A folder of this machine stands in only in local mode."""
    named = checkpoint_dir(spark)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    return tempfile.mkdtemp(prefix="loreloom-")
