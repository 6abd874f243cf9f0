"""Places within large groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.session import shared_table


def places(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row (from 1) in its group of ``keys`` by ``order``, like row_number over those.

    Rows are dealt by ranges of keys and order, so a group of any size lies in as many partitions as it needs; a row's place is
    its place within its partition and group, plus the rows of the group in the partitions before, which are counted. Ties beyond
    ``order`` have any order. Null keys are a group.
    """
    dealt = shared_table(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "places")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_before")  # a row a partition and group
    offsets = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_key_part"), before)
    on = F.col("_part") == F.col("_key_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return local.join(offsets, on).select(*df.columns, (F.col("_before") + F.col("_local")).cast("int").alias(name))
