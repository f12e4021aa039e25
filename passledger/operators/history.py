"""Pass history: observed ids per slot, first sight, new serious ids, unit modes, laps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger import constants as C


def _slot_key(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("phase") == "sweep", F.lit("sweep")).otherwise(F.lit("pass"))
    number = F.when(F.col("phase") == "sweep", F.lit(-1)).otherwise(F.col("pass")).cast("bigint")
    return rows.withColumn("phase", kind).withColumn("pass", number)


def slot_table(keyed: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct (pass, phase) with its ordinal ``slot``; the one sweep slot follows the first numbered pass."""
    scope = scope or []
    seen = keyed.select(*scope, "pass", "phase").distinct()
    first = F.min(F.when(F.col("phase") != "sweep", F.col("pass"))).over(Window.partitionBy(*scope))
    place = F.when(F.col("phase") == "sweep", F.coalesce(first, F.lit(1))).otherwise(F.col("pass"))
    placed = seen.withColumn("slot_pass", place).withColumn("_sweep", (F.col("phase") == "sweep").cast("int"))
    order = Window.partitionBy(*scope).orderBy("slot_pass", "_sweep")
    return placed.withColumn("slot", F.dense_rank().over(order).cast("bigint")).drop("_sweep")


def observed_ids(rows: DataFrame, fold_map: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """(slot, slot_pass, phase, candidate_id, sev_rank): distinct ids of a slot with their highest rank there.

    Rows carry pass, phase, id and sev_rank. They are reduced per slot and raw id before the map is joined.
    """
    scope = scope or []
    reduced = _slot_key(rows).groupBy(*scope, "pass", "phase", "id").agg(F.max("sev_rank").alias("sev_rank"))
    slots = slot_table(_slot_key(rows), scope)
    if not scope:  # a handful of rows; a join by these keys would deal all ids over as many tasks as there are slots
        slots = F.broadcast(slots)
    placed = reduced.join(slots, scope + ["pass", "phase"])
    if fold_map is None:  # a slot is one (pass, phase), so its ids are distinct already
        return placed.select(*scope, "slot", "slot_pass", "phase", F.col("id").alias("candidate_id"), "sev_rank")
    mapped = placed.join(fold_map, scope + ["id"], "left").withColumn("candidate_id", F.coalesce("candidate_id", "id"))
    # dealt by id of the candidate alone, which serves the windows of ``mark_new`` too
    return (
        mapped.select(*scope, "slot", "slot_pass", "phase", "candidate_id", "sev_rank").repartition(*scope, "candidate_id")
        .groupBy(*scope, "slot", "slot_pass", "phase", "candidate_id")
        .agg(F.max("sev_rank").alias("sev_rank"))
    )


def mark_new(observed: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Add ``is_new`` (first slot of the id) and ``is_new_serious`` (first time its highest rank reaches HIGH)."""
    scope = scope or []
    earlier = (
        Window.partitionBy(*scope, "candidate_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.max("sev_rank").over(earlier), F.lit(0))
    seen = F.count("*").over(earlier)
    return observed.withColumns(
        {
            "is_new": seen == 0,
            "is_new_serious": (before < C.SERIOUS_RANK) & (F.col("sev_rank") >= C.SERIOUS_RANK),
        }
    )


def unit_modes(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Lenses per (pass, unit) -> mode: 1 confirm, 4 or more full, else partial. Sweeps set no mode."""
    scope = scope or []
    per = (
        rows.filter("phase <> 'sweep' AND unit_id IS NOT NULL")
        .groupBy(*scope, "pass", "unit_id")
        .agg(F.count_distinct("lens").alias("lenses"), F.max((F.col("phase") == "restored").cast("int")).alias("_full"))
    )
    mode = (
        F.when((F.col("_full") == 1) | (F.col("lenses") >= 4), "full").when(F.col("lenses") == 1, "confirm").otherwise("partial")
    )
    return per.withColumn("mode", mode).drop("_full")


def lap_history(marked: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per slot: cumulative serious ids seen, their share of all serious ids, and new serious ids.

    An id counts as serious by its highest rank over all slots; a slot contributes the ids it saw first.
    """
    scope = scope or []
    ids = marked.groupBy(*scope, "candidate_id").agg(
        F.min("slot").alias("slot"), F.max("sev_rank").alias("top")
    ).filter(F.col("top") >= C.SERIOUS_RANK)
    firsts = ids.groupBy(*scope, "slot").agg(F.count("*").alias("first_seen"))
    slots = marked.groupBy(*scope, "slot").agg(F.sum(F.col("is_new_serious").cast("bigint")).alias("novel"))
    table = slots.join(firsts, scope + ["slot"], "left").fillna({"first_seen": 0})
    running = Window.partitionBy(*scope).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*scope)
    return (
        table.withColumn("seen", F.sum("first_seen").over(running))
        .withColumn("total", F.sum("first_seen").over(whole))
        .withColumn("bound", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("seen") / F.col("total")))
        .select(*scope, "slot", "novel", "seen", "total", "bound")
    )


def restore_lanes(history: DataFrame, candidates: DataFrame, observed: str = "observed") -> DataFrame:
    """Rebuild lane rows from a history of id arrays: one candidate row per observed id and slot."""
    exploded = history.select("slot", "slot_pass", "phase", F.explode(observed).alias("candidate_id"))
    name = F.when(F.col("phase") == "sweep", F.lit("lane-sweep-restored.jsonl")).otherwise(
        F.concat(F.lit("lane-pass"), F.col("slot_pass").cast("string"), F.lit("-restored.jsonl"))
    )
    return exploded.join(candidates, "candidate_id").withColumn("lane_file", name)
