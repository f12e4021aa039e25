"""Scoring against an answer key: one-to-one slot matching, misses explained, totals, calibration."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn
from passledger.session import by_key, cut


def near_flag(loci: DataFrame, hits: DataFrame, window: int, name: str) -> DataFrame:
    """Add boolean ``name``: some hit on the same path at most ``window`` lines away.

    With buckets of window + 1 lines a hit in the own bucket always counts; of the neighbours only the last or first hit
    matters. So hits shrink to one row per bucket and each locus meets exactly one row.
    """
    width = window + 1
    per = hits.groupBy("path", F.floor(F.col("line") / width).alias("b")).agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    around = per.select(
        "path", F.explode(F.array(*[F.struct((F.col("b") + d).alias("b"), F.lit(d).alias("d")) for d in (-1, 0, 1)])).alias("t"), "lo", "hi"
    ).groupBy("path", F.col("t.b").alias("_b")).agg(
        F.max(F.col("t.d") == 0).alias("_own"),
        F.min(F.when(F.col("t.d") == -1, F.col("lo"))).alias("_next"),
        F.max(F.when(F.col("t.d") == 1, F.col("hi"))).alias("_prev"),
    )
    flag = (
        F.coalesce("_own", F.lit(False))
        | F.coalesce(F.col("line") - F.col("_prev") <= window, F.lit(False))
        | F.coalesce(F.col("_next") - F.col("line") <= window, F.lit(False))
    )
    return loci.withColumn("_b", F.floor(F.col("line") / width)).join(around, ["path", "_b"], "left").withColumn(name, flag).drop(
        "_b", "_own", "_next", "_prev"
    )


def _pairs(slots: DataFrame, candidates: DataFrame, scope: list[str], window: int) -> DataFrame:
    """(scope, path, slot, slot_line, candidate_id, c_line, distance) for compatible candidates in the window.

    Candidates are spread over the families they can score for; a folded ledger holds at most one candidate per lens and
    eleven lines, so a slot meets a bounded number of them.
    """
    width = window + 1
    options = candidates.select(
        *scope, "path", F.col("candidate_id"), F.col("line").alias("c_line"),
        F.explode(fn.compatible_families("lens", "category", "title")).alias("family"),
    ).withColumn("b", F.floor(F.col("c_line") / width))
    wanted = slots.select(
        *scope, "path", "family", "slot", F.col("line").alias("slot_line"),
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + F.floor(F.col("line") / width))).alias("b"),
    )
    joined = wanted.join(by_key(options), scope + ["path", "family", "b"])
    return joined.withColumn("distance", F.abs(F.col("c_line") - F.col("slot_line"))).filter(F.col("distance") <= window).drop("b")


def _with_islands(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """Split each path where no pair spans: slots and candidates of different islands never compete."""
    spans = pairs.select(
        *scope, "path", F.least("slot_line", "c_line").alias("lo"), F.greatest("slot_line", "c_line").alias("hi"),
    ).groupBy(*scope, "path", "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy(*scope, "path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*scope, "path").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    starts = spans.withColumn("_s", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-1))).cast("int"))
    islands = starts.withColumn("island", F.sum("_s").over(upto)).select(*scope, "path", "lo", "island")
    return pairs.withColumn("lo", F.least("slot_line", "c_line")).join(by_key(islands), scope + ["path", "lo"]).drop("lo")


SALTS = 32


def _slot_pairs(slots: DataFrame, candidates: DataFrame, scope: list[str], window: int) -> DataFrame:
    """Pairs of the slots that can be matched at all, for keys with many slots on one locus.

    Slots of one (path, family, line) see the same candidates, so the matched ones are the first of them and number at
    most the candidates in the window. Loci are paired with candidates once; each locus brings its own bound, and slots are
    ranked against it in salted parts first, so no locus is one task.
    """
    locus = scope + ["path", "family", "line"]
    loci = slots.select(*locus).distinct().withColumn("slot", F.lit(0))
    options = cut(_pairs(loci, candidates, scope, window).drop("slot").withColumnRenamed("slot_line", "line"))
    bounds = options.groupBy(*locus).agg(F.count("*").alias("_most"))
    ranked = slots.select(*locus, "slot").join(by_key(bounds), locus).withColumn("_salt", F.pmod(F.xxhash64("slot"), F.lit(SALTS)))
    for keys in ([*locus, "_salt"], locus):
        ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("slot"))).filter(F.col("_r") <= F.col("_most"))
    return ranked.select(*locus, "slot").join(by_key(options), locus).withColumnRenamed("line", "slot_line").drop("family")


def match_slots(
    slots: DataFrame, candidates: DataFrame, scope: list[str] | None = None, window: int = C.MATCH_WINDOW
) -> DataFrame:
    """One-to-one greedy match: slots in slot order, each takes its nearest unclaimed compatible candidate.

    ``slots``: slot, family, path, line (and scope columns); ``candidates``: candidate_id, path, line, lens, category,
    title. Ties go to the earlier candidate in (line, id) order. Claims cannot cross a path island, so islands are the
    unit of work; the walk streams over sorted pairs and remembers only the claims of the current island.
    """
    scope = scope or []
    pairs = _with_islands(cut(_slot_pairs(slots, candidates, scope, window)), scope)
    group = scope + ["path", "island"]
    ordered = pairs.repartition(*group).sortWithinPartitions(*group, "slot", "distance", "c_line", "candidate_id")

    def run(batches_):
        current, slot_done, claimed = None, None, set()
        for batch in batches_:
            cols = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in group + ["slot", "candidate_id"]}
            mask = []
            for key, slot, cand in zip(zip(*[cols[g] for g in group]), cols["slot"], cols["candidate_id"]):
                if key != current:
                    current, slot_done, claimed = key, None, set()
                take = slot != slot_done and cand not in claimed
                if take:
                    slot_done = slot
                    claimed.add(cand)
                mask.append(take)
            yield batch.filter(pa.array(mask, type=pa.bool_()))

    matches = ordered.mapInArrow(run, ordered.schema).select(
        *scope, "slot", F.col("candidate_id").alias("matched_id"), F.col("distance").alias("line_distance")
    )
    return slots.join(by_key(matches), scope + ["slot"], "left").withColumn("found", F.col("matched_id").isNotNull())


def diagnose_misses(
    scored: DataFrame, candidates: DataFrame, radius: int = C.FOLD_RADIUS, window: int = C.MATCH_WINDOW
) -> DataFrame:
    """(slot, mechanism, shadowed_by) for missed planted slots: fold-shadow, claim-shadow or cold-miss."""
    planted = scored.filter("NOT historical")
    missed = planted.filter("NOT found").select("slot", "family", "path", "line")
    two = Window.partitionBy("path", "family", "line").orderBy("slot")
    per_line = planted.withColumn("_r", F.row_number().over(two)).filter("_r <= 2").select(
        "path", "family", F.col("line").alias("o_line"), F.col("slot").alias("o_slot")
    )
    width = radius + 1
    reach = per_line.withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + F.floor(F.col("o_line") / width))))
    sibling = (
        missed.withColumn("b", F.floor(F.col("line") / width)).join(by_key(reach), ["path", "family", "b"])
        .filter((F.abs(F.col("o_line") - F.col("line")) <= radius) & (F.col("o_slot") != F.col("slot")))
        .groupBy("slot").agg(F.min("o_slot").alias("shadowed_by"))
    )
    claimed = scored.filter("found").select(F.col("matched_id").alias("candidate_id")).distinct().withColumn("_c", F.lit(True))
    nearby = (
        _pairs(missed, candidates, [], window).join(by_key(claimed), "candidate_id", "left")
        .groupBy("slot").agg(F.min(F.coalesce("_c", F.lit(False))).alias("all_claimed"))
    )
    return missed.select("slot").join(by_key(sibling), "slot", "left").join(by_key(nearby), "slot", "left").select(
        "slot",
        F.when(F.col("shadowed_by").isNotNull(), "fold-shadow")
        .when(F.coalesce("all_claimed", F.lit(False)), "claim-shadow").otherwise("cold-miss").alias("mechanism"),
        "shadowed_by",
    )


def mislabelled(scored: DataFrame, candidates: DataFrame, window: int = C.MATCH_WINDOW) -> DataFrame:
    """Missed historical slots with any candidate in the window, whatever its family: the first one in (line, id) order."""
    width = window + 1
    per_line = candidates.groupBy("path", F.col("line").alias("c_line")).agg(F.min("candidate_id").alias("candidate_id"))
    placed = per_line.withColumn("b", F.floor(F.col("c_line") / width))
    # missed slots are few, candidates many: the slots go to the three buckets that may hold one
    missed = scored.filter("historical AND NOT found").withColumn(
        "b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + F.floor(F.col("line") / width))))
    return (
        missed.join(by_key(placed), ["path", "b"]).filter(F.abs(F.col("c_line") - F.col("line")) <= window)
        .groupBy("slot", "family").agg(F.min_by("candidate_id", F.struct("c_line", "candidate_id")).alias("refound_as"))
    )


def score_delta(current: DataFrame, previous: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Carry provenance over: found now but missed before = cured; a stored mint error holds only while still missed.

    ``previous``: slot, found, cured, mint_error. ``overrides`` (slot) are newly attested mint errors.
    """
    before = previous.select(
        "slot", F.col("found").alias("_found"), F.coalesce("cured", F.lit(False)).alias("_cured"),
        F.coalesce("mint_error", F.lit(False)).alias("_mint"),
    )
    some = previous.agg((F.count("*") > 0).alias("_any"))
    out = current.join(before, "slot", "left").join(F.broadcast(some))
    if overrides is not None:
        out = out.join(overrides.select("slot").distinct().withColumn("_over", F.lit(True)), "slot", "left")
    else:
        out = out.withColumn("_over", F.lit(False))
    newly = F.col("found") & ~F.coalesce("_found", F.lit(False)) & F.col("_any")
    return out.withColumn("cured", (F.coalesce("_cured", F.lit(False)) | newly) & F.col("found")).withColumn(
        "mint_error", ~F.col("found") & (F.coalesce("_mint", F.lit(False)) | F.coalesce("_over", F.lit(False)))
    ).drop("_found", "_cured", "_mint", "_any", "_over")


def saturation(candidates: DataFrame, lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """candidate_count against max(64, lines div 100)."""
    scope = scope or []
    counted = candidates.groupBy(*scope).agg(F.count("*").alias("candidate_count"))
    joined = counted.join(lines, scope, "full_outer") if scope else counted.join(F.broadcast(lines))
    limit = F.greatest(F.lit(C.SATURATION_FLOOR).cast("bigint"), F.floor(F.coalesce("scannable_lines", F.lit(0)) / C.SATURATION_LINES))
    return joined.fillna({"candidate_count": 0}).withColumn("saturation_limit", limit).withColumn(
        "saturated", F.col("candidate_count") > F.col("saturation_limit")
    )


def recall_totals(
    scored: DataFrame, saturated: DataFrame | None = None, scope: list[str] | None = None, expected: int = C.SLOT_TOTAL
) -> DataFrame:
    """found, cold, cured, mint_error, totals and status (INVALID over SATURATED over PASS over FAIL).

    ``scored``: found, historical, cured, mint_error, drift.
    """
    scope = scope or []
    plant = ~F.col("historical")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    totals = scored.groupBy(*scope).agg(
        n(plant & F.col("found")).alias("found"), n(plant & F.col("cured")).alias("cured"),
        n(plant & F.col("mint_error")).alias("mint_error"), n(plant).alias("total"),
        n(F.col("historical")).alias("historical_total"), n(F.col("historical") & F.col("found")).alias("historical_found"),
        n(F.col("drift") & ~F.coalesce("mint_error", F.lit(False))).alias("blocking_drift"),
    ).withColumn("cold", F.col("found") - F.col("cured"))
    if saturated is not None:
        side = saturated.select(*scope, "saturated")
        totals = totals.join(side, scope, "left") if scope else totals.join(F.broadcast(side))
    else:
        totals = totals.withColumn("saturated", F.lit(False))
    whole = (F.col("found") + F.col("mint_error") == F.col("total")) & (F.col("total") == expected)
    status = (
        F.when(F.col("blocking_drift") > 0, "INVALID").when(F.coalesce("saturated", F.lit(False)), "SATURATED")
        .when(whole, "PASS").otherwise("FAIL")
    )
    return totals.withColumn("status", status)


def family_spread(slots: DataFrame, per_family: int = 2, scope: list[str] | None = None) -> DataFrame:
    """Per family: slots, distinct files, whether both rules hold."""
    return slots.groupBy(*(scope or []), "family").agg(
        F.count("*").alias("slots"), F.count_distinct("path").alias("files")
    ).withColumn("count_ok", F.col("slots") == per_family).withColumn("files_ok", F.col("slots") == F.col("files"))


def calibrate(keys: DataFrame, jitters: list[int] | None = None) -> DataFrame:
    """Replay a perfect reader per key through fold and match for every jitter; the worst jitter per key.

    ``keys``: key_id, slot, family, path, line, title, historical. Any number of keys runs in one job.
    """
    from passledger.operators.fold import fold_observations

    jitters = C.CALIBRATION_JITTERS if jitters is None else jitters
    planted = keys.filter("NOT historical")
    options = F.array(*[F.struct(F.lit(i).alias("jitter_ord"), F.lit(j).alias("jitter")) for i, j in enumerate(jitters)])
    runs = planted.withColumn("j", F.explode(options)).select("*", "j.*").drop("j")
    category = F.concat("family", F.lit(" replay probe slot "), F.col("slot").cast("string"))
    rows = runs.select(
        "key_id", "jitter_ord", "path", F.greatest(F.lit(1).cast("bigint"), F.col("line") + F.col("jitter")).alias("line"),
        F.col("family").alias("lens"), category.alias("category"), F.lit("HIGH").alias("severity"), F.lit(3).alias("sev_rank"),
        F.coalesce("title", F.lit("replay probe")).alias("title"), F.lit("replay row").alias("evidence"),
        F.lit("replay").alias("reach_basis"), F.col("slot").alias("seq"),
    )
    rows = rows.withColumn("id", fn.stable_id("path", "line", "category"))
    scope = ["key_id", "jitter_ord"]
    folded = fold_observations(rows, scope).candidates
    scored = match_slots(runs.select(*scope, "jitter", "slot", "family", "path", "line"), folded, scope)
    per = scored.groupBy(*scope, "jitter").agg(F.count_if("found").alias("matched"), F.count("*").alias("total"))
    worst = per.groupBy("key_id").agg(F.min_by(F.struct("jitter", "matched", "total"), F.struct("matched", "jitter_ord")).alias("w"))
    return worst.select("key_id", "w.*").withColumn("passed", (F.col("matched") == F.col("total")) & (F.col("total") > 0))
