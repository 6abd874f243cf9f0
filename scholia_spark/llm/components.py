"""Connected components by alternating large-star and small-star steps; every step is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia_spark.llm import shared


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node (u > v) hangs on one node, and those hang on none: then the components are found."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): component is the smallest node that links reach.

    Self-links are ignored and repeated links count once; an empty table gives no rows. Nulls must not occur.
    """
    now = shared.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _are_stars(now):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        then = shared.keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        shared.forget(now)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
