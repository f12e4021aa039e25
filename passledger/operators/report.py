"""Report rows and their serial forms. Rows stay rows; documents are written as ordered lines, never built in one cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn
from passledger.session import by_key

REACH_COLUMNS = {"reach_domain": "edge", "reach_stage": "route", "reach_method": "exposure", "reach_authorizer": "authorizer"}
TIERS = list(C.SEVERITY_TIER_KEYS.values())
DEFAULT_REASON = "All top-tier clauses evidenced by the verification verdict; see the verdict table."


def report_filter(findings: DataFrame) -> DataFrame:
    """Drop refuted, synthetic and off-enum rows."""
    return findings.filter(
        (F.col("status") != "refuted") & ~F.coalesce("synthetic", F.lit(False)) & F.upper("severity").isin(*C.SEVERITY_RANKS)
    )


def report_rows(findings: DataFrame, estate: Column | None = None, scope: list[str] | None = None) -> DataFrame:
    """Findings -> report rows (id, severity, repo, path 'rel:line', title, cwe_canonical, fix, status, pc_reason)."""
    rows = report_filter(findings).withColumn("severity", F.upper("severity"))
    locus = fn.split_repo("path", estate if estate is not None else F.lit("estate"))
    title = fn.repair_title("title")
    top = F.col("severity") == "PRIORITIZED_CRITICAL"
    disproof = F.trim(F.coalesce("disproof_attempt", F.lit("")))
    reason = F.when(disproof != "", disproof).otherwise(F.coalesce("reach_basis", F.lit("")))
    return rows.withColumn("_l", locus).withColumn("_t", title).select(
        *(scope or []), "id", "severity", F.col("_l.repo").alias("repo"),
        F.concat(F.col("_l.rel"), F.lit(":"), F.col("line").cast("string")).alias("path"), F.col("_t").alias("title"),
        fn.canonical_cwe(F.coalesce("cwe", F.lit("")), "category", F.col("_t")).alias("cwe_canonical"),
        fn.fix_or_fallback("fix", "category", F.col("_l.rel"), "line").alias("fix"),
        F.when(F.col("status") == "verified", "verified").otherwise("conditional").alias("status"),
        F.when(top, F.when(reason != "", reason).otherwise(DEFAULT_REASON)).alias("pc_reason"),
    )


def report_order() -> list[Column]:
    """Severity descending, then path, line, id."""
    return [F.desc("sev_rank"), F.asc("path"), F.asc("line"), F.asc("id")]


def declared_counts(rows: DataFrame, scope: list[str], chains: DataFrame | None = None) -> DataFrame:
    out = rows.groupBy(*scope).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(k) for s, k in C.SEVERITY_TIER_KEYS.items()]
    )
    if chains is None:
        return out.withColumn("chains", F.lit(0).cast("bigint"))
    return out.join(chains.groupBy(*scope).agg(F.count("*").alias("chains")), scope, "left").fillna({"chains": 0})


def _place(df: DataFrame, column: str) -> Column:
    """A text that sorts as the column does: whole numbers of any size and sign become 20 digits."""
    if dict(df.dtypes)[column] not in ("int", "bigint"):
        return F.col(column).cast("string")
    return F.lpad((F.col(column).cast("decimal(21,0)") + F.lit("10000000000000000000").cast("decimal(21,0)")).cast("string"), 20, "0")


def _listed(rows: DataFrame, doc: str, section: int, order: list[str], payload: Column) -> DataFrame:
    """JSON array members as lines in ``order``; every member but the first of its document starts with a comma.

    Members that share a place are numbered within it, so each has a place of its own. The first place of a document is met
    by document and place, as the numbering is, so a document with very many members is not one task.
    """
    shared = rows.select(doc, F.lit(section).alias("section"), F.concat_ws("\u0001", *[_place(rows, c) for c in order]).alias("place"), payload.alias("payload"))
    shared = shared.filter(F.col(doc).isNotNull())
    own = lambda tie: F.concat_ws("\u0001", "place", F.lpad(tie.cast("string"), 20, "0"))
    first = shared.groupBy(doc).agg(F.min_by("place", own(F.lit(1))).alias("place")).withColumn("_first", F.lit(True))
    tied = shared.withColumn("_tie", F.row_number().over(Window.partitionBy(doc, "place").orderBy("payload")))
    comma = F.when(F.col("_first") & (F.col("_tie") == 1), "").otherwise(",")
    return tied.join(by_key(first), [doc, "place"], "left").select(doc, "section", own(F.col("_tie")).alias("place"), F.concat(comma, "payload").alias("line"))


def report_document(rows: DataFrame, counts: DataFrame, identity: DataFrame, doc: str, run: str, version: str, chains: DataFrame | None = None, hops: DataFrame | None = None) -> DataFrame:
    """(doc, section, place, line): lines of each report document; concatenated in (section, place) order they are its JSON.

    ``identity``: doc, app_id, app_name, estate; ``chains``: doc, chain_id, title, status; ``hops``: doc, chain_id, hop_ord,
    finding_id. A chain is an opening line, one line per hop and a closing line.
    """
    app = F.struct(F.col("app_id").alias(C.REPORT_APP_ID), "app_name", "estate", F.lit(run).alias("scan_run"), F.lit(version).alias("scanner_version"))
    head = counts.join(identity, doc).select(
        doc, F.lit(0).alias("section"), F.lit("").alias("place"),
        F.concat(F.lit('{"schema_version":"2.0","app":'), F.to_json(app), F.lit(',"declared_counts":'),
                 F.to_json(F.struct("total", *TIERS, "chains")), F.lit(',"findings":[')).alias("line"),
    )
    fields = ["id", "severity", "repo", "path", "title", "cwe_canonical", "fix", "status", "pc_reason"]
    ranked = rows.withColumn("_tier", F.lit(5) - fn.severity_rank("severity"))
    findings = _listed(ranked, doc, 1, ["_tier", "repo", "path", "id"], F.to_json(F.struct(*fields)))
    middle = counts.select(doc, F.lit(2).alias("section"), F.lit("").alias("place"), F.lit('],"chains":[').alias("line"))
    tail = counts.select(doc, F.lit(4).alias("section"), F.lit("").alias("place"), F.lit("]}").alias("line"))
    out = head.unionByName(findings).unionByName(middle).unionByName(tail)
    if chains is not None:
        key = F.col("chain_id").cast("string")
        opening = F.concat(F.regexp_replace(F.to_json(F.struct(key.alias("id"), "title", "status")), r"\}$", ""), F.lit(',"hops":['))
        opened = _listed(chains, doc, 3, ["chain_id"], opening)
        mark = lambda df, c, part: df.withColumn("place", F.concat_ws("\u0001", c, F.lit(part)))
        opened = mark(opened, F.col("place"), "0")
        width = _place(chains, "chain_id")
        at = F.concat_ws("\u0001", width, F.lit("1"), _place(hops, "hop_ord"))
        kept = hops.join(chains.select(doc, "chain_id"), [doc, "chain_id"], "left_semi")
        tie = F.row_number().over(Window.partitionBy(doc, "chain_id", "hop_ord").orderBy("finding_id"))
        placed = kept.withColumn("place", F.concat_ws("\u0001", at, F.lpad(tie.cast("string"), 20, "0")))
        first = placed.groupBy(doc, "chain_id").agg(F.min("place").alias("_first"))
        comma = F.when(F.col("place") == F.col("_first"), "").otherwise(",")
        hop_lines = placed.join(first, [doc, "chain_id"]).select(
            doc, F.lit(3).alias("section"), "place", F.concat(comma, F.to_json(F.struct("finding_id"))).alias("line"))
        closed = chains.select(doc, F.lit(3).alias("section"), F.concat_ws("\u0001", width, F.lit("2")).alias("place"), F.lit("]}").alias("line"))
        out = out.unionByName(opened).unionByName(hop_lines).unionByName(closed)
    return out


def sarif_results(rows: DataFrame, prefix: str = "review/", fingerprint: str = "reviewId", scope: list[str] | None = None) -> DataFrame:
    """Flat SARIF results: rule_id, level, message, uri, start_line, severity, security_severity, status, fingerprint."""
    locus = fn.split_locus("path")
    return rows.withColumn("_l", locus).select(
        *(scope or []), F.concat(F.lit(prefix), "cwe_canonical").alias("rule_id"), fn.sarif_level("severity").alias("level"),
        F.concat("title", F.lit(" Fix: "), "fix").alias("message"), F.concat("repo", F.lit("/"), F.col("_l.path")).alias("uri"),
        F.col("_l.line").alias("start_line"), "severity", fn.security_severity("severity").alias("security_severity"), "status",
        F.col("id").alias(fingerprint),
    )


def sarif_rules(rows: DataFrame, prefix: str = "review/", scope: list[str] | None = None) -> DataFrame:
    """Distinct rules: rule_id, name, short_description, help_uri."""
    cwe = F.col("cwe_canonical")
    return rows.select(*(scope or []), cwe).distinct().select(
        *(scope or []), F.concat(F.lit(prefix), cwe).alias("rule_id"), F.regexp_replace(cwe, "-", "").alias("name"), cwe.alias("short_description"),
        F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.split(cwe, "-")[1], F.lit(".html")).alias("help_uri"),
    )


def sarif_document(rows: DataFrame, doc: str, tool: str, version: str, run: str, prefix: str = "review/", fingerprint: str = "reviewId") -> DataFrame:
    """(doc, section, place, line): SARIF 2.1.0 text of each document as ordered lines."""
    results = sarif_results(rows, prefix, fingerprint, [doc])
    rules = sarif_rules(rows, prefix, [doc])
    docs = rows.select(doc).distinct()
    fixed = lambda section, text: docs.select(doc, F.lit(section).alias("section"), F.lit("").alias("place"), F.lit(text).alias("line"))
    head = ('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool
            + '","version":"' + version + '","rules":[')
    rule = F.to_json(F.struct(F.col("rule_id").alias("id"), "name", F.struct(F.col("short_description").alias("text")).alias("shortDescription"), F.col("help_uri").alias("helpUri")))
    location = F.struct(F.struct(
        F.struct(F.col("uri"), F.lit("SRCROOT").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region"),
    ).alias("physicalLocation"))
    result = F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.struct(fingerprint).alias("partialFingerprints"),
        F.struct("severity", F.col("security_severity").alias("security-severity"), "status").alias("properties"), F.array(location).alias("locations"),
    ))
    return (
        fixed(0, head).unionByName(_listed(rules, doc, 1, ["rule_id"], rule))
        .unionByName(fixed(2, ']}},"automationDetails":{"id":"' + run + '"},"results":['))
        .unionByName(_listed(results, doc, 3, ["uri", "start_line", fingerprint], result)).unionByName(fixed(4, "]}]}"))
    )


def findings_text(findings: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(section, sev_rank, path, line, id, text): findings, then synthetic rows, then refutations, one text block per row."""
    locus = F.concat(F.lit("- Location: `"), "path", F.lit(":"), F.col("line").cast("string"), F.lit("`"))
    synthetic = F.coalesce("synthetic", F.lit(False))
    section = F.when(F.col("status") == "refuted", 3).when(synthetic, 2).otherwise(1)
    real = F.concat_ws("\n", F.concat(F.lit("## "), "severity", F.lit(": "), "title"), F.lit(""), locus,
                       F.concat(F.lit("- Category: `"), "category", F.lit("`")), F.concat(F.lit("- Status: `"), "status", F.lit("`")), F.lit(""), "evidence", F.lit(""))
    planted = F.concat_ws("\n", F.concat(F.lit("## SYNTHETIC ("), "severity", F.lit("): "), "title"), F.lit(""), locus, F.lit(""))
    refuted = F.concat_ws("\n", F.concat(F.lit("## REFUTED: "), "title"), F.lit(""), locus,
                          F.concat(F.lit("- Disproof: "), F.coalesce("disproof_attempt", F.lit(""))), F.lit(""))
    out = findings.withColumn("section", section)
    return out.select(*(scope or []), "section", "sev_rank", "path", "line", "id",
                      F.when(F.col("section") == 1, real).when(F.col("section") == 2, planted).otherwise(refuted).alias("text"))


def evidence_rows(findings: DataFrame) -> DataFrame:
    """key, tier and the four reach columns of emitted findings, spreadsheet formulas neutralised."""
    emitted = findings.filter(F.col("status").isin("verified", "conditional", "conditional-court"))
    tier = F.when(F.col("status") == "conditional-court", "WP").when(F.upper("severity") == "PRIORITIZED_CRITICAL", "CRITICAL").otherwise(F.upper("severity"))
    pairs = emitted.withColumn("_kv", fn.parse_kv("reach_basis"))
    return pairs.select(
        fn.neutralise_formula("id").alias("key"), fn.neutralise_formula(tier).alias("tier"),
        *[fn.neutralise_formula(F.coalesce(F.col("_kv")[name], F.lit(""))).alias(column) for column, name in REACH_COLUMNS.items()],
    )


def verdict_map(findings: DataFrame) -> DataFrame:
    """key, verdict of judged findings."""
    return findings.filter(F.col("status").isin("verified", "conditional-court", "refuted")).select(
        F.col("id").alias("key"), F.col("status").alias("verdict")
    )


def sorted_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Row as JSON with keys in alphabetical order; nulls are left out."""
    return F.to_json(F.struct(*sorted(columns or df.columns)))
