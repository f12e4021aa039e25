"""Shared parts: tables, small text batches, ranks inside groups, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passledger.session import cut

__all__ = ["components", "cut", "rank_in_groups", "roots", "table", "text_slices", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made from `names` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    mark = "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `limit` bytes of text (one row at least): bounds a worker's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = held = 0
        for k, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


def rank_in_groups(df: DataFrame, group: list[str], spread: list[str], order: list[str], rank: str, block_rows: int = 20_000) -> DataFrame:
    """Add `rank`: gapless from 0 inside each group, also where one group holds most rows.

    Rows of a group fall into blocks by a hash of `spread`; each block is numbered by itself and starts where the blocks
    before it end. The number of blocks follows the number of rows, so a block stays small. `df` must be a stored table:
    it is read for the counts and again for the rows.
    """
    blocks = df.count() // block_rows + 1
    dealt = df.withColumn("__block", F.pmod(F.xxhash64(*spread), F.lit(blocks)))
    keys = [*group, "__block"]
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(*(F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)), "__start")
    )
    numbered = dealt.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same = [F.col(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)]
    return (
        numbered.join(starts, same)
        .withColumn(rank, (F.col("__row") + F.col("__start")).cast("long"))
        .drop("__block", "__row", "__start", *(f"__s{i}" for i in range(len(keys))))
    )


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of n rows that each is connected with by the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as (u, v), v the smallest id that u is connected with among them."""
    held = [b for b in batches if b.num_rows]
    if held:
        edges = pa.Table.from_batches(held)
        u, v = edges.column("u").to_numpy(), edges.column("v").to_numpy()
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(ids), place[: len(u)], place[len(u) :])
        inner = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[inner]), pa.array(ids[root[inner]])], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", edges_per_task: int = 500_000) -> DataFrame:
    """(id, component_id): the smallest id reachable over the edges, for every id that has an edge to another id.

    Each round first solves the edges of each task by itself (`edges_per_task` of them at most, about), which leaves one edge
    per id and task, and ends if one task held them all. Else a large-star and a small-star step bring edges of different
    tasks together, and the next round follows, until a round changes nothing. Edges are stored after each step. Minima are
    partial aggregates, so an id with very many edges costs no single task; the joins back are left to skew handling.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    while True:
        stored = cut(now)
        tasks = stored.count() // edges_per_task + 1
        now = cut(stored.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
        if tasks == 1:
            break
        known = _state(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        )
        now = cut(small)
        if _state(now) == known:
            break
    tails = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    return tails.unionByName(tails.select(F.col("component_id").alias("id"), "component_id").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
