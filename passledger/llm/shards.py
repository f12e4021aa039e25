"""Sharding by jump consistent hashing, in built-in column functions only.

A key draws a row of random numbers from its own hash. It starts in shard 0 and, at each draw r, jumps from shard b to
floor((b + 1) / r); its shard is the last one below the number of shards. No table of shards is needed, and one more shard
takes from each of the others just the keys whose next jump lands in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import cut, rank_in_groups


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (int, from 0) of a key of any type. Null is a key like any other.

    The n-th draw is a number in (0, 1] from the top 53 bits of a 64-bit hash of key and n. A jump goes up by one at least,
    so `shards` draws are enough; draws after the last jump change nothing.
    """

    def step(state: Column, n: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, n), 11) + 1) / F.lit(float(1 << 53))
        jump = F.least(F.floor((state["next"] + 1) / draw), F.lit(shards).cast("long"))
        landed = state["next"] < shards
        return F.struct(
            F.when(landed, state["next"]).otherwise(state["at"]).alias("at"),
            F.when(landed, jump).otherwise(state["next"]).alias("next"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def shard_plan(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    size: UTF-8 bytes of the text (null: none) and 8; text_crc32 of a null text is that of an empty one, 0; slot: the place
    in the shard, gapless from 0; grown_shard: where the row would be with one more shard. Rows that repeat a doc_id share
    its shard and take a slot each; rows without doc_id share one shard.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id").cast("long"), shards).alias("shard"),
        jump_shard(F.col("doc_id").cast("long"), shards + 1).alias("grown_shard"),
    ))
    placed = rank_in_groups(narrow, ["shard"], ["doc_id", "text_crc32"], ["doc_id", "text_crc32"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, shards: int = 24) -> None:
    """Write all columns of `docs` as Parquet, one folder (shard=k) per shard."""
    (docs.withColumn("shard", jump_shard(F.col("doc_id").cast("long"), shards))
     .write.partitionBy("shard").parquet(folder))
