"""Verdicts: choice, validity, join with candidates, conservation, chains, attribution, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn

FIELDS = ["verdict", "severity", "proposed_severity", "cwe", "disproof_attempt", "basis", "reach_basis", "fix"]


def pick_verdict(docs: DataFrame, key: str = "candidate_id", per_file: str = "per_file", n_keys: str = "n_keys", order: str = "ord") -> DataFrame:
    """One document per candidate: a per-candidate file beats the shared file; in a file most keys wins (first on tie);
    in the shared file the later line wins. An aggregate, so repeated verdicts shrink before the shuffle."""
    rank = F.struct(
        F.when(F.col(per_file), 0).otherwise(1).alias("a"),
        F.when(F.col(per_file), -F.col(n_keys)).otherwise(-F.col(order)).alias("b"),
        F.when(F.col(per_file), F.col(order)).otherwise(F.lit(0)).alias("c"),
    )
    rest = [c for c in docs.columns if c != key]
    return docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_d")).select(key, "_d.*")


def verdict_is_valid(verdict: Column, severity: Column) -> Column:
    return F.coalesce(
        F.upper(verdict).isin(*C.VERDICTS) & F.upper(severity).isin(*C.SEVERITY_RANKS), F.lit(False)
    )


def pending_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Serious candidates that need a verdict: none, invalid, or judged below their present severity."""
    docs = verdicts.select("candidate_id", F.col("verdict").alias("v"), F.col("severity").alias("vs"), F.col("proposed_severity").alias("vp"))
    joined = candidates.filter(F.col("sev_rank") >= C.SERIOUS_RANK).join(docs, "candidate_id", "left")
    why = (
        F.when(F.col("v").isNull(), "missing").when(~verdict_is_valid(F.col("v"), F.col("vs")), "invalid")
        .when(F.col("vp").isNotNull() & (F.col("sev_rank") > fn.severity_rank("vp")), "stale")
    )
    return joined.withColumn("why", why).filter("why IS NOT NULL").drop("v", "vs", "vp")


def normalise_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Invalid or missing documents become CONDITIONAL at the proposed severity, never a refutation."""
    docs = verdicts.select("candidate_id", *[F.col(c).alias(f"_{c}") for c in FIELDS if c in verdicts.columns and c != "proposed_severity"])
    ok = verdict_is_valid(F.col("_verdict"), F.col("_severity"))
    fallback = {
        "cwe": F.lit(C.DEFAULT_CWE),
        "disproof_attempt": F.lit("the verdict was missing or broke its form, so the proposed severity stands"),
        "basis": F.lit("static-reasoned"),
        "reach_basis": F.col("reach_basis"),
        "fix": F.lit("A person should look at this place."),
    }
    out = candidates.join(docs, "candidate_id", "left")
    columns = {
        name: F.when(ok, F.col(f"_{name}") if f"_{name}" in out.columns else F.lit(None).cast("string")).otherwise(value)
        for name, value in fallback.items()
    }
    return out.select(
        "candidate_id",
        F.when(ok, F.upper("_verdict")).otherwise("CONDITIONAL").alias("verdict"),
        F.when(ok, F.upper("_severity")).otherwise(F.col("severity")).alias("severity"),
        F.col("severity").alias("proposed_severity"),
        *[c.alias(n) for n, c in columns.items()],
        ok.alias("was_valid"),
    )


def verdict_violations(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Why finalisation must be refused: serious candidates without a verdict, off-enum verdicts or severities."""
    docs = verdicts.select("candidate_id", F.col("verdict").alias("v"), F.coalesce(F.col("severity"), F.lit("")).alias("vs"))
    joined = candidates.filter(F.col("sev_rank") >= C.SERIOUS_RANK).select("candidate_id").join(docs, "candidate_id", "left")
    problem = (
        F.when(F.col("v").isNull(), "no verdict").when(~F.upper("v").isin(*C.VERDICTS), "off-enum verdict")
        .when((F.col("vs") != "") & ~F.upper("vs").isin(*C.SEVERITY_RANKS), "off-enum severity")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("candidate_id", "problem")


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings: serious candidates take status, severity and texts of their verdict, the rest are conditional."""
    have = [c for c in FIELDS if c in verdicts.columns and c != "proposed_severity"]
    docs = verdicts.select("candidate_id", *[F.col(c).alias(f"_{c}") for c in have])
    joined = candidates.join(docs, "candidate_id", "left")
    serious = F.col("sev_rank") >= C.SERIOUS_RANK

    def text(name, default):
        source = F.col(f"_{name}") if name in have else F.lit(None).cast("string")
        return F.when(serious, F.coalesce(source, default))

    severity = F.when(serious, F.upper(F.coalesce("_severity", F.col("severity")))).otherwise(F.col("severity"))
    return (
        joined.withColumn("status", F.when(serious, fn.lookup(F.upper("_verdict"), C.VERDICT_STATUS)).otherwise("conditional"))
        .withColumn("cwe", text("cwe", F.lit("CWE-000")))
        .withColumn("disproof_attempt", text("disproof_attempt", F.lit("")))
        .withColumn("verification_basis", text("basis", F.lit("static-reasoned")))
        .withColumn("fix", text("fix", F.lit("No code change required; refuted claim.")))
        .withColumn("reach_basis", F.coalesce(text("reach_basis", F.col("reach_basis")), F.col("reach_basis")))
        .withColumn("severity", severity)
        .withColumn("sev_rank", fn.severity_rank("severity"))
        .drop(*[f"_{c}" for c in have])
    )


def restore_verdicts(findings: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdict rows rebuilt from findings with the originally proposed severity; findings without a source row apart."""
    names = {v: k for k, v in C.VERDICT_STATUS.items()}
    source = candidates.select("candidate_id", F.col("severity").alias("proposed_severity"))
    rows = findings.withColumn("verdict", fn.lookup(F.col("status"), names)).filter("verdict IS NOT NULL")
    joined = rows.join(source, "candidate_id", "left")
    safe = fn.is_safe_id("candidate_id")
    problem = F.when(~safe, "unsafe id").when(F.col("proposed_severity").isNull(), "no source candidate")
    flagged = joined.withColumn("problem", problem)
    good = flagged.filter("problem IS NULL").drop("problem")
    return good, flagged.filter("problem IS NOT NULL").select("candidate_id", "problem")


EMITTED = ["verified", "conditional", "conditional-court"]


def conservation(findings: DataFrame, candidates: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """candidates = emitted + refuted, as one row per scope with ``conserved``."""
    scope = scope or []
    f = findings.groupBy(*scope).agg(
        F.count_if(F.col("status").isin(*EMITTED)).alias("emitted"), F.count_if(F.col("status") == "refuted").alias("refuted")
    )
    c = candidates.groupBy(*scope).agg(F.count("*").alias("candidates"))
    both = c.join(f, scope, "left") if scope else c.join(F.broadcast(f))
    both = both.fillna({"emitted": 0, "refuted": 0})
    return both.withColumn("conserved", F.col("emitted") + F.col("refuted") == F.col("candidates"))


def disposition_conservation(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Count per terminal class; anything unknown is residue; conserved needs rows and no residue."""
    known = [c for c in C.DISPOSITION_CLASSES if c != "residue"]
    counts = [F.count_if(F.coalesce(F.col("disposition") == c, F.lit(False))).alias(c) for c in known]
    residue = F.count_if(~F.coalesce(F.col("disposition").isin(*known), F.lit(False))).alias("residue")
    out = rows.groupBy(*(scope or [])).agg(F.count("*").alias("total"), *counts, residue)
    return out.withColumn("conserved", (F.col("total") > 0) & (F.col("residue") == 0))


def tier_tally(findings: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Emitted rows per tier; court-conditional rows are their own tier."""
    wp = F.col("status") == "conditional-court"
    tiers = [
        F.count_if(~wp & (F.upper("severity") == s)).alias(key) for s, key in C.SEVERITY_TIER_KEYS.items()
    ]
    emitted = findings.filter(F.col("status").isin(*EMITTED))
    return emitted.groupBy(*(scope or [])).agg(F.count("*").alias("total"), F.count_if(wp).alias("wp"), *tiers)


def published_totals(findings: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Totals without synthetic rows (their number apart), per tier, verified, conditional, refuted, executed evidence."""
    real = ~F.coalesce("synthetic", F.lit(False))
    out = F.col("status").isin(*EMITTED)
    wp = F.col("status") == "conditional-court"
    tiers = [
        F.count_if(out & ~wp & real & (F.upper("severity") == s)).alias(key) for s, key in C.SEVERITY_TIER_KEYS.items()
    ]
    return findings.groupBy(*(scope or [])).agg(
        F.count_if(out & real).alias("emitted"), F.count_if(out & ~real).alias("synthetic"),
        F.count_if((F.col("status") == "verified") & real).alias("verified"), F.count_if(wp).alias("conditional_court"),
        F.count_if(F.col("status") == "refuted").alias("refuted"),
        F.count_if(out & (F.col("verification_basis") == "hermetic-executed")).alias("executed"), *tiers,
    )


def validate_chains(hops: DataFrame, findings: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """(chain_id, n_hops, status, missing, refuted): confirmed, conditional or dropped.

    ``hops``: chain_id, hop_ord, finding_key; ``findings``: finding_key, status. ``chains`` (chain_id, title) adds the
    malformed rule for empty ids and titles. A chain needs two hops, all known, none refuted.
    """
    known = findings.groupBy("finding_key").agg(F.min("status").alias("status"))
    joined = hops.join(known, "finding_key", "left")
    per = joined.groupBy("chain_id").agg(
        F.count("*").alias("n_hops"),
        F.count_if(F.col("status").isNull()).alias("missing"),
        F.count_if(F.coalesce(F.col("status") == "refuted", F.lit(False))).alias("refuted"),
        F.min(F.coalesce(F.col("status") == "verified", F.lit(False))).alias("all_verified"),
    )
    bad_text = F.lit(False)
    if chains is not None:
        per = chains.select("chain_id", "title").join(per, "chain_id", "left").fillna({"n_hops": 0, "missing": 0, "refuted": 0})
        bad_text = (F.trim(F.coalesce(F.col("chain_id").cast("string"), F.lit(""))) == "") | (F.trim(F.coalesce("title", F.lit(""))) == "")
    status = (
        F.when(bad_text | (F.col("n_hops") < 2), "malformed").when((F.col("missing") > 0) | (F.col("refuted") > 0), "dropped")
        .when(F.col("all_verified"), "confirmed").otherwise("conditional")
    )
    return per.withColumn("status", status).drop("all_verified")


def close_chains(hops: DataFrame, report_rows: DataFrame) -> DataFrame:
    """Chains whose every hop is in the report."""
    present = report_rows.select("finding_key").distinct().withColumn("_in", F.lit(1))
    return hops.join(present, "finding_key", "left").groupBy("chain_id").agg(
        F.count("*").alias("n_hops"), F.count("_in").alias("present")
    ).filter("n_hops = present").select("chain_id", "n_hops")


def attribute_candidates(candidates: DataFrame, files: DataFrame, matched: DataFrame, clean: DataFrame) -> DataFrame:
    """Disposition of candidates in modified files: matched -> synthetic; else PRESENT genuine, ABSENT synthetic, none unresolved.

    ``clean``: candidate_id, clean_verdict, basis. Anything but PRESENT or ABSENT counts as no verdict.
    """
    inside = candidates.join(files.select("path").distinct(), "path", "left_semi")
    hit = matched.select("candidate_id").distinct().withColumn("_m", F.lit(True))
    answers = clean.filter(F.col("clean_verdict").isin("PRESENT", "ABSENT")).groupBy("candidate_id").agg(
        F.max("clean_verdict").alias("_v"), F.max("basis").alias("_b")
    )
    joined = inside.join(hit, "candidate_id", "left").join(answers, "candidate_id", "left")
    return joined.select(
        "candidate_id",
        F.when(F.col("_m"), "synthetic").when(F.col("_v") == "PRESENT", "genuine").when(F.col("_v") == "ABSENT", "synthetic")
        .otherwise("unresolved").alias("disposition"),
        F.when(F.col("_m").isNull(), F.col("_v")).alias("clean_verdict"),
        F.when(F.col("_m"), "matched to a scored slot").when(F.col("_v").isNotNull(), F.substring("_b", 1, 400))
        .otherwise("no parseable verdict").alias("basis"),
    )


def apply_dispositions(findings: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Set ``synthetic`` to exactly what the dispositions say, in both directions; ``changed`` marks rewritten rows."""
    flags = dispositions.filter("disposition = 'synthetic'").select("candidate_id").distinct().withColumn("_s", F.lit(True))
    out = findings.withColumn("_old", F.coalesce("synthetic", F.lit(False))).drop("synthetic").join(flags, "candidate_id", "left")
    return out.withColumn("synthetic", F.coalesce("_s", F.lit(False))).withColumn(
        "changed", F.col("synthetic") != F.col("_old")
    ).drop("_s", "_old")


def findings_near(findings: DataFrame, changed: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` findings per changed path in report order (the brief shows no more)."""
    w = Window.partitionBy("path").orderBy(F.desc("sev_rank"), "line", "candidate_id")
    near = findings.join(changed.select("path").distinct(), "path", "left_semi")
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def candidate_tally(candidates: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return candidates.groupBy(*(scope or [])).agg(
        F.count("*").alias("total"), F.count_if(fn.is_serious("severity")).alias("serious")
    )


def verdict_tally(verdicts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return verdicts.groupBy(*(scope or [])).agg(
        *[F.count_if(F.coalesce(F.upper("verdict") == v, F.lit(False))).alias(v.lower()) for v in C.VERDICTS]
    )
