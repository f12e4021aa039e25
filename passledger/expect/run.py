"""Run certification suite (C0-C6) over metric receipts, its roll-up, completeness and mint mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger import constants as C
from passledger.expect.core import row_violations

INT_FIELDS = [
    "files_opened", "census_files", "units", "units_quiet", "plants_found", "plants_cured", "plants_mint_error", "priors_staged",
    "priors_refound", "priors_not_evidenced", "priors_not_evidenced_receipted", "priors_refound_verified", "priors_refound_refuted",
    "priors_refound_folded", "canary_historical", "lane_deaths", "lane_redispatched", "lane_adopted", "lane_deaths_unreconciled",
    "orphans", "planted_file_candidates", "candidates_dispositioned", "dispositions_unresolved",
]
REQUIRED = ["files_opened", "census_files", "units", "units_quiet", "plants_found", "lane_deaths", "lane_redispatched", "orphans", "lane_deaths_unreconciled"]
REQUIRED_WITH_PRIORS = ["canary_historical", "priors_refound", "priors_not_evidenced", "priors_not_evidenced_receipted"]
DISPOSITION_TAG = "dispositions/v1"
CHECKS = ["C1", "C2", "C3", "C4", "C5", "C6"]


def receipt_columns(receipts: DataFrame, text: str = "receipt") -> DataFrame:
    """JSON receipts -> one bigint column per field plus ``mistyped`` (fields that are neither integer nor boolean)."""
    doc = F.try_parse_json(text)
    kind = lambda f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant"))
    value = lambda f: F.try_variant_get("_v", f"$.{f}", "bigint")
    out = receipts.withColumn("_v", doc)
    mistyped = F.array_compact(F.array(*[F.when(~kind(f).isin("BIGINT", "BOOLEAN", "VOID"), F.lit(f)) for f in INT_FIELDS]))
    return out.select(
        *receipts.columns, mistyped.alias("mistyped"), *[value(f).alias(f) for f in INT_FIELDS],
        (kind("lane_deaths_unreconciled") == "BOOLEAN").alias("unreconciled_is_bool"),
        (F.coalesce(kind("disposition_receipt_present") == "BOOLEAN", F.lit(False))
         & F.coalesce(F.try_variant_get("_v", "$.disposition_receipt_present", "boolean"), F.lit(False))).alias("disposition_present"),
        F.try_variant_get("_v", "$.disposition_receipt_schema", "string").alias("disposition_schema"),
    )


def run_suite(metrics: DataFrame, key: str = "run_id", expected: int = C.SLOT_TOTAL, tag: str = DISPOSITION_TAG) -> DataFrame:
    """(run_id, rule, message). ``metrics`` comes from ``receipt_columns`` plus ``completion`` text.

    A run with a mistyped field reports only that.
    """
    z: callable = lambda f: F.coalesce(F.col(f), F.lit(0))
    typed = F.size("mistyped") == 0
    staged = z("priors_staged") != 0
    split = [F.col(f"priors_refound_{k}") for k in ("verified", "refuted", "folded")]
    some = split[0].isNotNull() | split[1].isNotNull() | split[2].isNotNull()
    every = split[0].isNotNull() & split[1].isNotNull() & split[2].isNotNull()

    def rule(name: str, message: str, cond: Column):
        return name, message, typed & F.coalesce(cond, F.lit(False))

    rules = [("C0", "mistyped field", ~typed)]
    rules += [rule("C0", f"missing {f}", F.col(f).isNull()) for f in REQUIRED]
    rules += [rule("C0", f"missing {f}", staged & F.col(f).isNull()) for f in REQUIRED_WITH_PRIORS]
    rules += [
        rule("C1", "opened differs from census", F.col("files_opened") != F.col("census_files")),
        rule("C2", "units not quiet", F.col("units_quiet") != F.col("units")),
        rule("C3", "slots not accounted for", F.col("plants_found") + z("plants_cured") + z("plants_mint_error") != expected),
        rule("C3", "too few historical slots", staged & (F.col("canary_historical") < C.DRAW_SIZE)),
        rule("C4", "refound and not evidenced differ from staged", staged & (F.col("priors_refound") + F.col("priors_not_evidenced") != F.col("priors_staged"))),
        rule("C4", "bare not-evidenced verdicts", staged & (F.col("priors_not_evidenced_receipted") != F.col("priors_not_evidenced"))),
        rule("C4", "disposition split required", staged & ~some),
        rule("C4", "disposition split incomplete", staged & some & ~every),
        rule("C4", "disposition split differs from refound", staged & every & (split[0] + split[1] + split[2] != F.col("priors_refound"))),
        rule("C5", "unreconciled must be an integer", F.col("unreconciled_is_bool")),
        rule("C5", "lane deaths without closure", ~F.col("unreconciled_is_bool") & (F.col("lane_deaths_unreconciled") != 0)),
        rule("C5", "orphaned lanes", F.col("orphans") != 0),
        rule("C5", "disposition evidence missing", ~F.col("disposition_present")),
        rule("C5", "disposition tag", F.col("disposition_present") & ~F.coalesce(F.col("disposition_schema") == tag, F.lit(False))),
        rule("C5", "candidates not dispositioned", z("planted_file_candidates") != z("candidates_dispositioned")),
        rule("C5", "unresolved dispositions", z("dispositions_unresolved") != 0),
        rule("C6", "no card gate line", ~F.coalesce(F.col("completion"), F.lit("")).rlike(r"(?i)SEAL-?\s?(CARD|TOKEN)[^\n]*(PASS|[0-9a-f]{16})")),
        rule("C6", "no report gate line", ~F.coalesce(F.col("completion"), F.lit("")).rlike(r"(?i)SCAN-?REPORT GATE[^\n]*PASS")),
    ]
    return row_violations(metrics, [key], rules)


def check_rollup(metrics: DataFrame, violations: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run and check: ok / fail / not-applicable and the sorted messages of its violations."""
    runs = metrics.select(key, (F.coalesce(F.col("priors_staged"), F.lit(0)) == 0).alias("_no_priors")).withColumn(
        "check", F.explode(F.array(*[F.lit(c) for c in CHECKS]))
    )
    failed = violations.groupBy(key, F.col("rule").alias("check")).agg(
        F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("detail")
    )
    state = F.when(F.col("detail").isNotNull(), "fail").when((F.col("check") == "C4") & F.col("_no_priors"), "not-applicable").otherwise("ok")
    return runs.join(failed, [key, "check"], "left").select(key, "check", state.alias("state"), "detail")


def completeness(artifacts: DataFrame, runs: DataFrame, required: list[str] | None = None, key: str = "run_id") -> DataFrame:
    """(run_id, problem): missing artifacts, leftover staging, no recall line, changed target.

    ``artifacts``: run_id, name; ``runs``: run_id, completion, baseline_fingerprint, current_fingerprint.
    """
    required = required or ["COMPLETION.md", "FINDINGS.md", "findings.jsonl", "candidates.jsonl"]
    have = artifacts.select(key, "name").distinct()
    wanted = runs.select(key, F.explode(F.array(*[F.lit(r) for r in required])).alias("name"))
    missing = wanted.join(have, [key, "name"], "left_anti").select(key, F.concat(F.lit("missing "), "name").alias("problem"))
    staging = have.filter("name = 'staging'").select(key, F.lit("staging not deleted").alias("problem"))
    line = F.coalesce("completion", F.lit(""))
    rules = [
        ("line", "no recall line", ~(line.contains("RECALL: EXTERNAL-PENDING") | line.rlike(r"RECALL: \d+/8"))),
        ("target", "target changed", ~F.col("baseline_fingerprint").eqNullSafe(F.col("current_fingerprint"))),
    ]
    rest = row_violations(runs, [key], rules).select(key, F.col("message").alias("problem"))
    return missing.unionByName(staging).unionByName(rest)


def mint_mix(slots: DataFrame, priors: DataFrame, key: str = "run_id", families: list[str] | None = None, per_family: int = 2) -> DataFrame:
    """(run_id, problem): at least four historical slots where priors exist; the fixed family spread of planted slots."""
    families = families or C.LENSES
    n_hist = slots.filter("historical").groupBy(key).agg(F.count("*").alias("n"))
    thin = priors.select(key).distinct().join(n_hist, key, "left").filter(F.coalesce("n", F.lit(0)) < C.DRAW_SIZE).select(
        key, F.lit("too few historical slots").alias("problem")
    )
    counts = slots.filter("NOT historical").groupBy(key, "family").agg(F.count("*").alias("n"))
    wanted = slots.select(key).distinct().withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    spread = wanted.join(counts, [key, "family"], "full_outer").filter(
        (F.coalesce("n", F.lit(0)) != per_family) | ~F.col("family").isin(*families)
    ).select(key, F.concat(F.lit("family spread "), "family").alias("problem"))
    return thin.unionByName(spread)
