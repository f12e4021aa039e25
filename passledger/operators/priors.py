"""Historical findings: tolerant path resolution, neighbour exclusion, dispositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger import functions as fn
from passledger.session import cut


def _followers(files: DataFrame, targets: DataFrame) -> DataFrame:
    """t, first, second: for each reversed target the two reversed file paths that come next in sorted order.

    Files and targets are range-partitioned together; a target at the end of a partition looks on into the next ones,
    of which two files each are known.
    """
    rows = files.select(F.col("r"), F.lit(1).alias("is_file")).unionByName(targets.select(F.col("r"), F.lit(0).alias("is_file")))
    placed = cut(rows.repartitionByRange("r", "is_file").withColumn("_part", F.spark_partition_id()))
    path = F.when(F.col("is_file") == 1, F.col("r"))
    from_end = Window.partitionBy("_part").orderBy(F.desc("r"), F.desc("is_file")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.last(path, ignorenulls=True).over(from_end)
    pair = F.when(F.col("is_file") == 1, F.struct(F.col("r").alias("first"), F.col("_next").alias("second")))
    local = placed.withColumn("_next", nearest).withColumn("_pair", F.last(pair, ignorenulls=True).over(from_end)).filter("is_file = 0")
    heads = _heads(placed)
    return (
        local.join(F.broadcast(heads), "_part", "left")  # one row per partition
        .select(F.col("r").alias("t"), F.coalesce("_pair.first", "after_first").alias("first"),
                F.when(F.col("_pair").isNull(), F.col("after_second")).otherwise(F.coalesce("_pair.second", "after_first")).alias("second"))
    )


def _heads(placed: DataFrame) -> DataFrame:
    """_part, after_first, after_second: the first two files behind each partition."""
    first = Window.partitionBy("_part").orderBy("r")
    two = placed.filter("is_file = 1").withColumn("_n", F.row_number().over(first)).filter("_n <= 2")
    heads = two.groupBy("_part").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    parts = placed.select("_part").distinct().join(heads, "_part", "left")
    behind = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    none = F.array().cast("array<string>")
    seen = F.slice(F.concat("rs", F.coalesce(F.last("rs", ignorenulls=True).over(behind), none)), 1, 2)
    after = F.last("_seen", ignorenulls=True).over(behind)
    known = parts.withColumn("_seen", seen).withColumn("_after", F.coalesce(after, none))
    return known.select("_part", F.try_element_at("_after", F.lit(1)).alias("after_first"), F.try_element_at("_after", F.lit(2)).alias("after_second"))


def resolve_paths(targets: DataFrame, files: DataFrame, aligned: bool = False) -> DataFrame:
    """Add ``resolved``: the exact path, else the only file ending in it, else the only file of that name, else null.

    Suffixes are plain string suffixes (``aligned`` asks for a segment boundary). Read backwards, a suffix is a prefix, and in
    sorted order the files that have it come right behind it: the next file fits and the one after does not, if there is
    just one. So each target meets two files, however many end in it.
    """
    paths = files.select("path").distinct()
    wanted = targets.filter("path IS NOT NULL").select(F.col("path").alias("t")).distinct().withColumn("base", fn.file_name("t"))
    exact = paths.select(F.col("path").alias("t"), F.lit(True).alias("is_exact"))
    by_name = paths.groupBy(fn.file_name("path").alias("base")).agg(F.count("*").alias("n_base"), F.min("path").alias("p_base"))
    ending = F.when(F.col("t").startswith("/"), F.col("t")).otherwise(F.concat(F.lit("/"), "t")) if aligned else F.col("t")
    wanted = wanted.withColumn("ending", F.reverse(ending))
    ends = _followers(paths.select(F.reverse("path").alias("r")), wanted.select(F.col("ending").alias("r")).distinct())
    only = F.when(F.col("first").startswith(F.col("t")) & ~F.coalesce(F.col("second").startswith(F.col("t")), F.lit(False)), F.reverse("first"))
    suffixes = ends.select(F.col("t").alias("ending"), only.alias("p_suffix"))
    resolved = (
        wanted.join(exact, "t", "left").join(suffixes, "ending", "left").join(by_name, "base", "left")
        .select(
            F.col("t").alias("path"),
            F.coalesce(F.when(F.col("is_exact"), F.col("t")), F.col("p_suffix"), F.when(F.col("n_base") == 1, F.col("p_base"))).alias("resolved"),
        )
    )
    return targets.join(resolved, "path", "left")


def heat_split(resolved: DataFrame, drawn: DataFrame) -> DataFrame:
    """Add ``reason`` why a prior is withheld, null when it may be briefed.

    Unresolved; drawn itself; in the file of a drawn item; in its directory with its family. The first drawn item in
    draw order decides. ``drawn``: id, family, resolved, draw_ord.
    """
    near = drawn.select(
        fn.dir_name("resolved").alias("_dir"), F.col("resolved").alias("_file"), F.col("family").alias("_family"), "draw_ord"
    )
    ids = drawn.select("id").distinct().withColumn("_drawn", F.lit(True))
    reason = F.when(F.col("resolved") == F.col("_file"), "same-file").when(
        F.col("family") == F.col("_family"), "same-directory-and-family"
    )
    neighbour = (
        resolved.filter("resolved IS NOT NULL").withColumn("_dir", fn.dir_name("resolved")).join(near, "_dir")
        .withColumn("_reason", reason).filter("_reason IS NOT NULL")
        .groupBy("id").agg(F.min_by("_reason", F.struct("draw_ord")).alias("_near"))
    )
    return resolved.join(ids, "id", "left").join(neighbour, "id", "left").withColumn(
        "reason",
        F.when(F.col("resolved").isNull(), "unresolved").when(F.col("_drawn"), "drawn").otherwise(F.col("_near")),
    ).drop("_drawn", "_near")


def heat_lines(heated: DataFrame, unit_files: DataFrame, marker: str = "no historical heat for this unit") -> DataFrame:
    """(unit_id, seed): 'path:line family title' per briefed prior of the unit, or one marker row."""
    files = unit_files.select("unit_id", "path").distinct()
    text = F.concat("resolved", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "family", F.lit(" "), "title")
    seeds = heated.select(F.col("resolved").alias("path"), text.alias("seed"))
    placed = files.join(seeds, "path").select("unit_id", "seed")
    empty = files.select("unit_id").distinct().join(placed.select("unit_id").distinct(), "unit_id", "left_anti")
    return placed.unionByName(empty.withColumn("seed", F.lit(marker)))


def dispositions(resolved: DataFrame, findings: DataFrame, briefed: DataFrame | None = None) -> DataFrame:
    """REFOUND (verified findings first, then finding order) or NOT-EVIDENCED with its sub-class.

    ``findings``: id, path, lens, category, title, status, ord. They shrink to the best one per (path, family) first.
    """
    options = findings.withColumn("family", F.explode(fn.compatible_families("lens", "category", "title")))
    order = F.struct((F.col("status") != "verified").alias("v"), F.col("ord"), F.col("id"))
    best = options.groupBy(F.col("path").alias("resolved"), "family").agg(
        F.min_by(F.struct(F.col("id").alias("finding_id"), F.col("status").alias("finding_status")), order).alias("m")
    )
    out = resolved.join(best, ["resolved", "family"], "left").select(
        "id", "family", "resolved",
        F.when(F.col("m").isNotNull(), "REFOUND").otherwise("NOT-EVIDENCED").alias("disposition"),
        F.when(F.col("resolved").isNull(), "locus-not-found").when(F.col("m").isNull(), "defect-not-present").alias("sub_class"),
        F.col("m.finding_id").alias("finding_id"), F.col("m.finding_status").alias("finding_status"),
    )
    if briefed is None:
        return out.withColumn("briefed", F.lit(None).cast("boolean"))
    flags = briefed.select("id").distinct().withColumn("briefed", F.lit(True))
    return out.join(flags, "id", "left").withColumn("briefed", F.coalesce("briefed", F.lit(False)))


def disposition_totals(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """staged, refound (blind; verified, refuted, folded), not evidenced."""
    hit = F.col("disposition") == "REFOUND"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy(*(scope or [])).agg(
        F.count("*").alias("staged"), n(hit).alias("refound"),
        n(hit & ~F.coalesce("briefed", F.lit(False))).alias("blind_refound"), n(~hit).alias("not_evidenced"),
        n(~hit & F.col("sub_class").isNotNull()).alias("not_evidenced_receipted"),
        n(hit & (F.col("finding_status") == "verified")).alias("refound_verified"),
        n(hit & (F.col("finding_status") == "refuted")).alias("refound_refuted"),
        n(hit & ~F.col("finding_status").isin("verified", "refuted")).alias("refound_folded"),
    )
