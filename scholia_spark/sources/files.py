"""File sources and sinks: TSV lists, JSONL ledgers, bulk members, generations behind a pointer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_list(spark: SparkSession, path: str, bucket: str | None = None) -> DataFrame:
    """SRC14: a TSV list by column names; optionally one bucket."""
    df = spark.read.csv(path, sep="\t", header=True)
    return df.where(F.col("bucket") == bucket) if bucket else df


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: append-only JSON lines; the last outcome of each id wins. Broken lines are left out."""
    schema = "id string, seq bigint, outcome string, _corrupt_record string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record IS NULL AND id IS NOT NULL").groupBy("id").agg(F.max_by("outcome", "seq").alias("outcome"), F.max("seq").alias("seq"))


def failure_stage(outcome: Column) -> Column:
    """Fourth field of an outcome."""
    return F.nullif(F.split_part(outcome, F.lit(":"), F.lit(4)), F.lit(""))


def pending(rows: DataFrame, ledger: DataFrame, redo: list[str], retry: bool, skip_stages: list[str]) -> DataFrame:
    """rows not in the ledger, listed again, or failed where a retry is asked for and their stage isn't skipped."""
    df = rows.join(ledger.select("id", "outcome"), "id", "left")
    failed = F.col("outcome").startswith("failed") & ~F.coalesce(failure_stage(F.col("outcome")).isin(*skip_stages or [""]), F.lit(False))
    return df.where(F.col("outcome").isNull() | F.col("id").isin(*redo or [""]) | (F.lit(retry) & failed)).select(*rows.columns)


def member_id(name: Column) -> Column:
    """SRC13: (paper_id, version) of a bulk member's name, such as 2101/2101.00001v2.pdf."""
    base = F.regexp_extract(name, r"(\d{4}\.\d{4,5})(?:v(\d+))?\.[A-Za-z.]+$", 1)
    version = F.regexp_extract(name, r"(\d{4}\.\d{4,5})(?:v(\d+))?\.[A-Za-z.]+$", 2)
    return F.when(base != "", F.struct(base.alias("paper_id"), F.when(version == "", 1).otherwise(version.cast("int")).alias("version")))


def in_window(updated: Column, published: Column, since: Column, until: Column) -> Column:
    """SRC6: after ``since`` (exclusive) and up to ``until`` (inclusive, null: open)."""
    ts = F.coalesce(updated, published, since)
    return (ts > since) & (until.isNull() | (ts <= until))


#: Folders of a raw cache; a lookup reads only those of the papers it names.
BUCKETS = 256


def put_raw(rows: DataFrame, path: str) -> None:
    """SRC17: add raw bytes to a cache. rows: paper_id, version, tier, data, put_at. Nothing is overwritten: the newest wins when read."""
    rows.select("paper_id", "version", "tier", "data", "put_at", F.pmod(F.xxhash64("paper_id"), F.lit(BUCKETS)).cast("int").alias("bucket")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def get_raw(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """SRC17: wanted (paper_id, version, tier) with ``data``, null where the cache has none; the newest put wins.

    The bytes move last: the newest put is found by its time alone.
    """
    keys = ["paper_id", "version", "tier"]
    asked = wanted.select(*keys).distinct().withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(BUCKETS)).cast("int"))
    held = spark.read.parquet(path)
    newest = held.select("bucket", *keys, "put_at").join(asked, ["bucket", *keys], "left_semi").groupBy("bucket", *keys).agg(F.max("put_at").alias("put_at"))
    found = held.join(newest, ["bucket", *keys, "put_at"]).dropDuplicates(keys).select(*keys, "data")
    return asked.drop("bucket").join(found, keys, "left")


def loss_within(outcomes: DataFrame, most: float) -> DataFrame:
    """Outcomes (paper_id, outcome: indexed, excluded or failed) of a reparse as one row: counts, bad_ratio (1 for no papers), and whether the loss is within its budget."""
    n = {o: F.count_if(F.col("outcome") == o) for o in ("indexed", "excluded", "failed")}
    ratio = F.when(F.count("*") > 0, (n["excluded"] + n["failed"]) / F.count("*")).otherwise(1.0)
    return outcomes.agg(*[c.alias(o) for o, c in n.items()], ratio.alias("bad_ratio"), (ratio <= most).alias("within"))


POINTER = "CURRENT"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, folder: str, generation: str, least: int) -> bool:
    """SNK4: write a generation, and point the folder to it only if it holds at least ``least`` rows.

    The pointer is a file beside the generations that names the current one; it is replaced by a rename, so readers see the
    old generation or the new one, and other sessions and later runs see the same.
    """
    spark = df.sparkSession
    path = f"{folder}/generation={generation}"
    df.write.mode("overwrite").parquet(path)
    if spark.read.parquet(path).count() < least:
        return False
    draft, fs = _file_system(spark, f"{folder}/{POINTER}.{generation}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(generation.encode()))
    out.close()
    pointer, _ = _file_system(spark, f"{folder}/{POINTER}")
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, pointer, options)
    return True


def current(spark: SparkSession, folder: str) -> DataFrame:
    """SNK4: the generation that the folder's pointer names; an error where nothing is published."""
    name = spark.read.text(f"{folder}/{POINTER}", wholetext=True).head()
    if name is None:
        raise ValueError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/generation={name[0].strip()}")
