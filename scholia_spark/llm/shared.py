"""Tables in the shared folder, checked broadcasts and Arrow batch bounds."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia_spark.session import read_spread, ship_package

#: Keys that may be broadcast: 16 bytes each at most, about 40 MB with their hash table. Beyond it a shuffle join is used.
BROADCAST_IDS = 500_000
#: Rows of an Arrow batch.
_OWN: dict[str, str] = {}


def base_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset on a single machine. Elsewhere that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="scholia-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table that ``keep`` wrote, once nothing reads it any more; other frames and None are left alone."""
    path = getattr(df, "_kept_at", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done: its cleaner acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: texts may be very long, and a batch is what a Python worker holds. Also ships the code.

    Frames read the setting when they run, so it is only ever lowered: to the one bound of all operators.
    """
    ship_package(spark)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_only(df: DataFrame, ids: DataFrame, key: str | list[str], n_ids: int, how: str = "left_semi") -> DataFrame:
    """``df`` where ``key`` is in ``ids`` (kept table of ``n_ids`` distinct values): broadcast below the bound, else shuffled."""
    side = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    return df.join(side, key, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_spread(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)
