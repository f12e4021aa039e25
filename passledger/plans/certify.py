"""Certification metrics: measures of many runs as one row per run, then the run suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.expect.run import INT_FIELDS


def certification_metrics(
    runs: DataFrame,
    coverage: DataFrame | None = None,
    states: DataFrame | None = None,
    recall: DataFrame | None = None,
    priors: DataFrame | None = None,
    ledger: DataFrame | None = None,
    attribution: DataFrame | None = None,
    key: str = "run_id",
) -> DataFrame:
    """``runs`` (run_id, completion) joined on run_id with per-run measures:

    coverage (opened, census); states (run_id, unit_id, state); recall (cold, cured, mint_error, historical_total);
    priors (disposition totals); ledger (deaths, redispatched, adopted, unreconciled); attribution (run_id, disposition).
    Output has the columns the run suite reads.
    """
    out = runs
    if coverage is not None:
        out = out.join(coverage.select(key, F.col("opened").alias("files_opened"), F.col("census").alias("census_files")), key, "left")
    if states is not None:
        quiet = states.groupBy(key).agg(F.count("*").alias("units"), F.count_if(F.col("state") == "quiet").alias("units_quiet"))
        out = out.join(quiet, key, "left")
    if recall is not None:
        out = out.join(recall.select(
            key, F.col("cold").alias("plants_found"), F.col("cured").alias("plants_cured"), F.col("mint_error").alias("plants_mint_error"),
            F.col("historical_total").alias("canary_historical")), key, "left")
    if priors is not None:
        out = out.join(priors.select(
            key, F.col("staged").alias("priors_staged"), F.col("refound").alias("priors_refound"), F.col("not_evidenced").alias("priors_not_evidenced"),
            F.col("not_evidenced_receipted").alias("priors_not_evidenced_receipted"), F.col("refound_verified").alias("priors_refound_verified"),
            F.col("refound_refuted").alias("priors_refound_refuted"), F.col("refound_folded").alias("priors_refound_folded")), key, "left")
    if ledger is not None:
        out = out.join(ledger.select(
            key, F.col("deaths").alias("lane_deaths"), F.col("redispatched").alias("lane_redispatched"), F.col("adopted").alias("lane_adopted"),
            F.col("unreconciled").alias("lane_deaths_unreconciled")), key, "left").withColumn("orphans", F.lit(0).cast("bigint"))
    if attribution is not None:
        done = attribution.groupBy(key).agg(
            F.count("*").alias("planted_file_candidates"), F.count("disposition").alias("candidates_dispositioned"),
            F.count_if(F.col("disposition") == "unresolved").alias("dispositions_unresolved"))
        out = out.join(done, key, "left").withColumn("_attributed", F.col("planted_file_candidates").isNotNull())
    have = set(out.columns)
    out = out.withColumns({f: F.lit(None).cast("bigint") for f in INT_FIELDS if f not in have})
    from passledger.expect.run import DISPOSITION_TAG

    attributed = F.col("_attributed") if "_attributed" in out.columns else F.lit(False)
    return out.withColumns({
        "mistyped": F.array().cast("array<string>"), "unreconciled_is_bool": F.lit(False), "disposition_present": attributed,
        "disposition_schema": F.when(attributed, DISPOSITION_TAG),
    }).drop("_attributed")
