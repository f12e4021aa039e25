"""Set comparisons of scopes, read-sets, censuses, plans and done work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visitation(scope: DataFrame, readsets: DataFrame, item: str = "item") -> DataFrame:
    """(item, state): read, missing (in scope, read by nobody) or ghost (read, not in scope). '#' lines are comments."""
    def clean(df):
        text = F.trim(F.col(item).cast("string"))
        return df.filter((text != "") & ~text.startswith("#")).select(item).distinct()

    s = clean(scope).withColumn("_s", F.lit(True))
    r = clean(readsets).withColumn("_r", F.lit(True))
    state = F.when(F.col("_r").isNull(), "missing").when(F.col("_s").isNull(), "ghost").otherwise("read")
    return s.join(r, item, "full_outer").select(item, state.alias("state"))


def visitation_totals(states: DataFrame, readsets: DataFrame) -> DataFrame:
    counts = states.agg(
        F.count_if(F.col("state") == "read").alias("visited"), F.count_if(F.col("state") != "ghost").alias("in_scope"),
        F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "ghost").alias("ghost"),
    )
    lanes = readsets.agg(F.count_distinct("lane").alias("lanes"))
    return counts.join(F.broadcast(lanes)).withColumn("clean", (F.col("missing") == 0) & (F.col("ghost") == 0))


def census_coverage(fresh: DataFrame, listed: DataFrame) -> DataFrame:
    """opened = fresh census files that are listed; census = all fresh files. Listings never change the denominator."""
    known = listed.select("path").distinct().withColumn("_l", F.lit(1))
    return fresh.select("path").distinct().join(known, "path", "left").agg(F.count("_l").alias("opened"), F.count("*").alias("census"))


def outside_coverage(planted: DataFrame, current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Planted paths outside (baseline intersect current)."""
    covered = current.select("path").distinct().join(baseline.select("path").distinct(), "path", "left_semi")
    return planted.join(covered, "path", "left_anti")


def backlog(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned items without a completed output."""
    return planned.join(done.select(*key).distinct(), key, "left_anti")


def plan_items(units: DataFrame, lenses: list[str]) -> DataFrame:
    """One item per unit and lens (the lens list is fixed and small)."""
    return units.select("unit_id").distinct().withColumn("lens", F.explode(F.array(*[F.lit(x) for x in lenses])))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Keys on one side only, with the side; empty when both cover exactly the same."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right")
    return left.join(right, key, "full_outer").select(key, side.alias("side")).filter("side IS NOT NULL")
