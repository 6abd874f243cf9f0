"""Session helpers: defaults for a local session, and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch at most: texts may be very long, and a batch with what is made of it is what a Python worker holds.
BATCH_ROWS = 500


def lower_batches(spark: SparkSession) -> None:
    """Frames read the setting when they run, so it is only ever lowered: to the one bound of all operators."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def ship_package(spark: SparkSession) -> None:
    """Once an application: send this package to the Python workers, so that functions of its modules unpickle there. Each time:
    bound their batches."""
    lower_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="scholia-code-")
    atexit.register(shutil.rmtree, folder, True)  # Spark reads it for as long as the application runs
    name = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def ship_active() -> None:
    """The same for the active session, by functions that make column expressions."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


#: Bytes of a text table that is dealt out anew where it has fewer files than there are cores.
SPREAD_FROM, SPREAD_TO = 4 << 20, 256 << 20


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of texts. One in fewer files than cores, and no larger than ``SPREAD_TO``, is dealt to all cores by one
    shuffle, as a file of one row group is read by one task; larger tables are read as they are."""
    df = spark.read.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p)
    cores = spark.sparkContext.defaultParallelism
    few = SPREAD_FROM <= found.getLength() <= SPREAD_TO and found.getFileCount() < cores
    return df.repartition(cores) if few else df


_OWN: dict[str, str] = {}


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder of spark.checkpoint.dir and read it back: cuts lineage and survives lost executors. Where that is
    unset a folder of this machine is used, but only by a local master."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="scholia-tables-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``shared_table`` wrote; other frames are left alone."""
    path = getattr(df, "_shared_at", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("scholia-spark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
