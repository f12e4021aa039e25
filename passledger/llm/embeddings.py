"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosines.

A normalised vector is projected on random normal directions; each projection, shifted and divided by a bucket width, is
rounded down, and `projections` of these integers make the vector's key in one of `tables` tables. Vectors of one label
that share a key in some table are compared exactly. At cosine 0.98 the distance is 0.2, so with the defaults below a pair
at the very threshold meets in some table with probability 0.995, and unrelated vectors with 6 in a million.

Equal vectors are taken together first. A key with very many vectors is cut into blocks, and each pair of blocks is one
matrix product; no row is made per pair. A block pair gives a row per vector: how many vectors it is linked to there, and the
smallest vector it is connected with. A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.llm.common import components, cut, roots

TABLES, PROJECTIONS, WIDTH = 40, 12, 1.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _directions(dimension: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=dimension))
    return rng.standard_normal((dimension, tables * projections)), rng.random(tables * projections)


def table_keys(unit: np.ndarray, salt: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """(vectors x tables) 64-bit keys of unit vectors; vectors of another salt (label) or dimension get other keys."""
    direction, shift = _directions(unit.shape[1], tables, projections)
    cells = np.floor(unit @ direction / width + shift).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    h = salt.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, tables + 1, dtype=np.uint64) * _MIX + np.uint64(unit.shape[1])
    for k in range(projections):
        h = (h ^ cells[:, :, k]) * _MIX
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each dimension."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[offsets[rows][:, None] + np.arange(size)]


def _linked(rows: dict[str, np.ndarray], least: float) -> dict[str, np.ndarray]:
    """rep, root, links of the linked vectors of one pair of blocks (or of one block with itself)."""
    order = np.argsort(rows["rep"], kind="stable")
    rep, copies, block, vectors, keys = (rows[c][order] for c in ("rep", "copies", "block", "vector", "keys"))
    a, b = int(rows["low"][0]), int(rows["high"][0])
    length = np.sqrt((vectors * vectors).sum(axis=1))
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    cosine = (vectors[left] @ vectors[right].T) / (length[left][:, None] * length[right][None, :])
    i, j = np.nonzero(cosine >= least)
    i, j = left[i], right[j]
    if a == b:
        i, j = i[i < j], j[i < j]
    t = int(rows["table"][0])
    if t and len(i):
        fresh = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
        root, i, j = roots(len(rep), i, j), i[fresh], j[fresh]
    else:
        root = roots(len(rep), i, j)
    links = np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
    there = (links > 0) | (root != np.arange(len(rep)))
    return {"rep": rep[there], "root": rep[root[there]], "links": links[there].astype(np.int64)}


def _pairs_of_blocks(classes: DataFrame, least: float, block_rows: int) -> DataFrame:
    """rep, root, links over all keys of all tables; classes: rep, salt, copies, embedding."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _by_dimension(batch.column("embedding")):
                unit = matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]
                found = table_keys(unit, batch.column("salt").to_numpy()[rows])
                for k in range(0, len(rows), 2000):
                    part = found[k : k + 2000]
                    reps = np.repeat(batch.column("rep").to_numpy()[rows[k : k + 2000]], TABLES)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(part))), pa.array(part.ravel()), pa.array(reps)], ["table", "key", "rep"])

    keyed = cut(classes.select("rep", "salt", "embedding").mapInArrow(keys, "table int, key long, rep long"))
    shared = (
        keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("table", "key", F.ceil(F.col("n") / block_rows).alias("blocks"))
    )
    met = keyed.join(shared, ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = (
        met.join(classes.select("rep", "salt", "copies", "embedding"), "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("table", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "salt", "copies", "embedding")
    )
    group = ["table", "key", "low", "high"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            rows = {c: whole.column(c).to_numpy() for c in ("table", "low", "high", "block", "rep", "copies", "salt")}
            ((_, rows["vector"]),) = _by_dimension(whole.column("embedding"))
            unit = rows["vector"] / np.sqrt((rows["vector"] ** 2).sum(axis=1))[:, None]
            rows["keys"] = table_keys(unit, rows["salt"])
            out = _linked(rows, least)
            if len(out["rep"]):
                yield pa.RecordBatch.from_pydict(out)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in group]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            bounds = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                at = tuple(int(c[a]) for c in cols)
                if at != last and held:
                    yield from done()
                    held = []
                last = at
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return dealt.repartition(*group).sortWithinPartitions(*group, "rep").mapInArrow(link, "rep long, root long, links long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, block_rows: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their dimensions are equal and their cosine in double precision
    is `least` or more. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows
    that repeat a vector link with it and each other; a null vec_id keeps its row and links with nothing.
    """
    ok = F.expr(
        "vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("__ok", F.coalesce(ok, F.lit(False)))
    rows = rows.withColumns({"__e1": F.xxhash64("embedding"), "__e2": F.xxhash64(F.lit(1), "embedding"), "salt": F.xxhash64("label")})
    keys = ["salt", "__e1", "__e2"]
    classes = cut(rows.where("__ok").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")))
    found = cut(_pairs_of_blocks(classes, least, block_rows))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ends = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = (
        classes.drop("embedding").join(links, "rep", "left").join(ends.withColumnRenamed("id", "rep"), "rep", "left")
        .select(*(F.col(k).alias(f"{k}_") for k in keys), "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "rep").alias("c"))
    )
    joined = rows.join(by_class, [F.col("__ok"), *(F.col(k) == F.col(f"{k}_") for k in keys)], "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
