"""Exact ranks that do not put a group into one task, and deterministic hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passledger import constants as C
from passledger.functions import audit_seed, stable_id
from passledger.session import cut


def ordinal(df: DataFrame, group: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """1-based position within ``group`` by ``order`` (unique within the group), for groups of any size.

    Rows are stored once (finding the ranges reads them a second time), range-partitioned on group and order, sorted and
    numbered inside each partition, and shifted by the number of rows of the group in earlier partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df).repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    # such an id is the partition's number times 2^33 plus the row's place in it
    fixed = cut(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = fixed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        fixed.join(offsets, group + ["_part"])
        .withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("bigint"))
        .drop("_part", "_at", "_first", "_before")
    )


def batches(pending: DataFrame, group: list[str], order: list[str], size: int = C.BATCH_SIZE) -> DataFrame:
    """Number pending rows in order and cut them into batches of ``size`` (batch 0 first)."""
    return ordinal(pending, group, order).withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("bigint"))


def hash_draw(
    df: DataFrame, id_col: str, k: int = C.DRAW_SIZE, eligible: Column | None = None, group: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The k eligible ids with the smallest sha256 per group, and the ineligible rows ranked before the last of them.

    An id that occurs several times is drawn once, with the row whose hash is smallest. Only rows of the k best ids per
    task and group are shuffled (the rank limit is pushed down).
    """
    group = group or []
    hashed = df.withColumn("draw_hash", F.sha2(F.col(id_col).cast("string"), 256)).withColumn(
        "_ok", F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    )
    place = Window.partitionBy(*group).orderBy("draw_hash")
    best = hashed.filter("_ok").withColumn("draw_ord", F.dense_rank().over(place)).filter(F.col("draw_ord") <= k).drop("_ok")
    keys = [*group, "draw_hash", "draw_ord"]
    rest = [c for c in best.columns if c not in keys]
    drawn = (
        best.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_r")).select(*keys, "_r.*")
        .withColumn("draw_ord", F.col("draw_ord").cast("bigint")).select(*df.columns, "draw_hash", "draw_ord")
    )
    last = drawn.groupBy(*group).agg(F.max("draw_hash").alias("_last"), F.count("*").alias("_n"))
    ineligible = hashed.filter("NOT _ok").drop("_ok")
    limited = ineligible.join(last, group, "left") if group else ineligible.join(F.broadcast(last))
    skipped = limited.filter((F.coalesce(F.col("_n"), F.lit(0)) < k) | (F.col("draw_hash") < F.col("_last"))).drop("_last", "_n")
    return drawn, skipped


def first_per_id(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """First row per id by ``order`` (an aggregate, so repeated ids shrink before the shuffle)."""
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(id_col, "_r.*")


def mixed_draw(slots: DataFrame, k: int = C.DRAW_SIZE) -> DataFrame:
    """k planted slots in sha256('slot-N') order plus the first k historical slots by number."""
    planted = slots.filter("NOT historical").withColumn(
        "_o", F.sha2(F.concat(F.lit("slot-"), F.col("slot").cast("string")), 256)
    ).orderBy("_o").limit(k).drop("_o")
    historical = slots.filter("historical").orderBy("slot").limit(k)
    return planted.unionByName(historical)


def audit_sample(findings: DataFrame, files: DataFrame, run: str, k: int = C.AUDIT_SIZE, prefix: str = "OBS-") -> DataFrame:
    """k findings in sha256(seed || id) order: does the id re-derive, does its file exist."""
    seed = audit_seed(F.lit(run))
    drawn = (
        findings.withColumn("seed", seed)
        .withColumn("_o", F.sha2(F.concat("seed", "id"), 256)).orderBy("_o", "id").limit(k)
    )
    known = files.select("path").distinct().withColumn("path_exists", F.lit(True))
    return drawn.join(known, "path", "left").select(
        "id", "path", "line", "seed",
        (stable_id("path", "line", "category", prefix) == F.col("id")).alias("id_ok"),
        F.coalesce("path_exists", F.lit(False)).alias("path_exists"),
    )


def with_lags(df: DataFrame, key: list[str], order: list[str], lags: dict[str, tuple[str, int]]) -> DataFrame:
    """Add ``name -> lag(column, n)`` per key in ``order``, for keys of any size.

    Rows are range-partitioned on key and order; a partition looks back within itself, and the last rows of a key in the
    partitions before are carried to it, as many as the longest lag.
    """
    back = max(n for _, n in lags.values())
    fixed = cut(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*key, "_part").orderBy(*order)
    from_end = Window.partitionBy(*key, "_part").orderBy(*[F.desc(c) for c in order])
    columns = list(dict.fromkeys(c for c, _ in lags.values()))
    tails = (
        fixed.select(*key, "_part", *columns, (-F.row_number().over(from_end)).alias("_from_end")).filter(F.col("_from_end") >= -back)
        .groupBy(*key, "_part").agg(F.sort_array(F.collect_list(F.struct("_from_end", *columns))).alias("_tail"))
    )
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(-back, -1)
    carried = tails.select(*key, "_part", F.flatten(F.collect_list("_tail").over(earlier)).alias("_carried")).filter(F.size("_carried") > 0)
    met = fixed.withColumn("_at", F.row_number().over(here)).withColumns({name: F.lag(c, n).over(here) for name, (c, n) in lags.items()})
    joined = met.join(carried.select(*[carried[k].alias(f"_c_{k}") for k in [*key, "_part"]], "_carried"), [met[k].eqNullSafe(F.col(f"_c_{k}")) for k in [*key, "_part"]], "left")

    def value(name: str, column: str, n: int):
        missing = (F.col("_at") - 1 - n).cast("int")  # -1: the last row carried
        return F.when(F.col("_at") > n, F.col(name)).otherwise(F.try_element_at("_carried", missing)[column])

    return joined.withColumns({name: value(name, c, n) for name, (c, n) in lags.items()}).select(*df.columns, *lags)
