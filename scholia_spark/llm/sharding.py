"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly; equal texts stay together.

Groups of equal texts are dealt over blocks by hash. Each block streams its groups from the largest down (by the greatest of
their shares of bytes, tokens and rows) and puts each where the dot product of its sizes with the residual capacities is
highest, among bins with room. The bins of all blocks are then packed into the shards by the same rule: a task sees a block
of about ``BLOCK_GROUPS`` groups, and the last step blocks x shards rows. Groups of many rows are one row until their place is known; it is then sent to their rows by
broadcast (texts of more than a ``HOT`` share of all rows, at most 1 / HOT of them), so that no task gathers a group.

Law: ``bytes`` (sizes near equal). Groups are whole unless ``split_above`` is given: the share of a shard's bytes beyond which
a group is dealt in pieces by document. A group larger than a shard must unbalance the shards if it stays whole.

Defined cases: a null text has 8 bytes of size (no text), crc 0, and is a group apart from the empty text; repeated rows
are rows of their own with slots of their own; null ids are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia_spark.llm import shared

#: Groups of a block, and the fewest blocks (fewer leave too few bins to even out the shards).
BLOCK_GROUPS = 100_000
LEAST_BLOCKS = 64
#: Rows of one shard that are numbered together.
SLOT_ROWS = 200_000
HOT = 1 / 2000


def pack(sizes: np.ndarray, capacity: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Bin of each row of ``sizes``, in the given order; ``load`` (bins, dimensions) is updated.

    Where no bin has room, that which overflows least in its worst dimension is taken.
    """
    scale = 1.0 / np.maximum(capacity, 1.0)
    relative, used = sizes * scale, load * scale
    out = np.empty(len(sizes), np.int64)
    for i, x in enumerate(relative):
        residual = 1.0 - used
        room = (residual >= x).all(axis=1)
        value = np.where(room, residual @ x, -np.inf) if room.any() else (residual - x).min(axis=1)
        b = int(value.argmax())
        out[i] = b
        used[b] += x
    np.add.at(load, out, sizes)
    return out


def _pack_blocks(it, bins: int):
    """Rows come sorted by block and falling share of what they take most of, with the block's totals; a block may span batches."""
    now, load = None, None
    for pdf in it:
        parts = []
        for block, g in pdf.groupby("block", sort=False):
            if block != now:
                now, load = block, np.zeros((bins, 3))
            capacity = g[["all_bytes", "all_tokens", "all_rows"]].iloc[0].to_numpy(float) / bins
            parts.append(g.assign(bin=pack(g[["bytes", "tokens", "n"]].to_numpy(float), capacity, load)))
        if parts:
            yield pd.concat(parts)[["h", "piece", "block", "bin", "bytes", "tokens", "n"]]


def _pack_bins(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    sizes = pdf[["bytes", "tokens", "n"]].to_numpy(float)
    most = (sizes / np.maximum(sizes.sum(axis=0), 1.0)).max(axis=1)
    pdf = pdf.assign(most=most).sort_values(["most", "block", "bin"], ascending=[False, True, True])
    sizes = pdf[["bytes", "tokens", "n"]].to_numpy(float)
    return pdf.assign(shard=pack(sizes, sizes.sum(axis=0) / shards, np.zeros((shards, 3))))[["block", "bin", "shard"]]


def _in_pieces(rows: DataFrame, limit: float) -> DataFrame:
    """``rows`` with piece: groups of more than ``limit`` bytes are cut by a hash of the id, the others are piece 0."""
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    large = groups.where((F.col("bytes") > limit) & (F.col("n") > 1)).select("h", F.ceil(F.col("bytes") / limit).cast("long").alias("pieces"))
    rows = rows.drop("piece").join(F.broadcast(large), "h", "left")  # at most shards / split_above groups exceed the limit
    return rows.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.expr("pmod(xxhash64(doc_id), pieces)")).cast("long")).drop("pieces")


def assign_shards(docs: DataFrame, shards: int = 24, split_above: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens of every row."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("h"),
        F.lit(0).cast("long").alias("piece"),
    )
    rows = shared.keep(rows, "sharding-rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
    if split_above is not None:
        rows = _in_pieces(rows, max(1.0, total["bytes"] / shards * split_above))

    units = rows.groupBy("h", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    units = shared.keep(units.withColumn("k", F.xxhash64("h", "piece")), "sharding-units")
    blocks = max(LEAST_BLOCKS, -(-units.count() // BLOCK_GROUPS))
    dealt = units.withColumn("block", F.expr(f"cast(pmod(k, {blocks}) as int)"))
    sums = dealt.groupBy("block").agg(F.sum("bytes").alias("all_bytes"), F.sum("tokens").alias("all_tokens"), F.sum("n").alias("all_rows"))
    dealt = dealt.join(F.broadcast(sums), "block")  # a row a block
    most = F.greatest(*[F.col(x) / F.greatest(F.col(t), F.lit(1)) for x, t in (("bytes", "all_bytes"), ("tokens", "all_tokens"), ("n", "all_rows"))])
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", most.desc(), "h", "piece")
    binned = dealt.mapInPandas(lambda it: _pack_blocks(it, shards), "h string, piece long, block int, bin int, bytes long, tokens long, n long")
    binned = shared.keep(binned, "sharding-bins")
    bins = binned.groupBy("block", "bin").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    packed = bins.groupBy(F.lit(0).alias("one")).applyInPandas(lambda pdf: _pack_bins(pdf, shards), "block int, bin int, shard int")  # blocks x shards rows
    places = shared.keep(binned.join(F.broadcast(packed), ["block", "bin"]).select("h", "piece", "shard", "n"), "sharding-places")

    hot = places.where(F.col("n") > HOT * total["n"]).drop("n")
    cold = places.where(F.col("n") <= HOT * total["n"]).drop("n")
    spread = rows.join(F.broadcast(hot), ["h", "piece"])
    rest = rows.join(F.broadcast(hot.select("h", "piece")), ["h", "piece"], "left_anti").join(cold, ["h", "piece"])
    part = F.expr(f"cast(pmod(xxhash64(doc_id, text_crc32), {-(-total['n'] // (shards * SLOT_ROWS))}) as int)").alias("part")
    placed = shared.keep(spread.union(rest).select("doc_id", "size", "text_crc32", "tokens", "shard", part), "sharding-placed")
    for used in (rows, units, binned, places):
        shared.forget(used)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))  # parts x shards rows
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    out = placed.withColumn("local", local).join(F.broadcast(offsets), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("local")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
