"""Verdict choice, finalisation, conservation, chains, attribution, tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from passledger.catalog import query
from passledger.catalog.history import SLOTS, _modes, _rows
from passledger.operators import convergence as cv
from passledger.operators import history as hist
from passledger.operators import ranking
from passledger.operators import verdicts as ve
from passledger.views import view

CAND = """
cands AS (SELECT *, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS candidate_id FROM f2_valid),
docs AS (SELECT c.candidate_id, CASE o.o_orderkey % 13 WHEN 0 THEN 'MAYBE' WHEN 1 THEN lower(o.verdict) ELSE o.verdict END AS verdict,
  CASE o.o_orderkey % 17 WHEN 0 THEN 'BLOCKER' ELSE o.severity END AS severity, CASE o.o_orderkey % 3 WHEN 0 THEN 'HIGH' END AS proposed_severity,
  concat('tried ', o.o_custkey) AS disproof_attempt
  FROM cands c JOIN f4 o ON o.o_orderkey = c.l_orderkey WHERE o.o_orderkey % 19 <> 0)"""


def candidates(spark, sf):
    return view(spark, sf, "f2_valid").withColumn(
        "candidate_id", F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))


def documents(spark, sf):
    c = candidates(spark, sf).select("candidate_id", F.col("l_orderkey").alias("o_orderkey"))
    j = c.join(view(spark, sf, "f4"), "o_orderkey").filter("o_orderkey % 19 <> 0")
    return j.select(
        "candidate_id", F.expr("CASE o_orderkey % 13 WHEN 0 THEN 'MAYBE' WHEN 1 THEN lower(verdict) ELSE verdict END AS verdict"),
        F.expr("CASE o_orderkey % 17 WHEN 0 THEN 'BLOCKER' ELSE severity END AS severity"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' END AS proposed_severity"),
        F.concat(F.lit("tried "), F.col("o_custkey").cast("string")).alias("disproof_attempt"))


OK = "upper(d.verdict) IN ('VERIFIED', 'CONDITIONAL', 'REFUTED') AND upper(d.severity) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'PRIORITIZED_CRITICAL')"


@query("pick_verdict", "J3", """
WITH d AS (SELECT o_custkey AS candidate_id, o_orderkey % 3 > 0 AS per_file, o_orderkey % 5 AS n_keys, o_orderkey AS ord, o_orderstatus AS verdict FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY CASE WHEN per_file THEN 0 ELSE 1 END, CASE WHEN per_file THEN -n_keys ELSE -ord END, ord) AS r FROM d)
SELECT candidate_id, ord, verdict FROM r WHERE r = 1""")
def pick_verdict(spark, sf):
    d = view(spark, sf, "orders").selectExpr("o_custkey AS candidate_id", "o_orderkey % 3 > 0 AS per_file", "o_orderkey % 5 AS n_keys", "o_orderkey AS ord", "o_orderstatus AS verdict")
    return ve.pick_verdict(d).select("candidate_id", "ord", "verdict")


@query("pending_verdicts", "J4", f"""
WITH {CAND} SELECT c.candidate_id, CASE WHEN d.verdict IS NULL THEN 'missing' WHEN NOT ({OK}) THEN 'invalid' ELSE 'stale' END AS why
FROM cands c LEFT JOIN (SELECT DISTINCT * FROM docs) d ON d.candidate_id = c.candidate_id WHERE c.sev_rank >= 3 AND (d.verdict IS NULL OR NOT ({OK}) OR (d.proposed_severity IS NOT NULL AND c.sev_rank > 3))""")
def pending_verdicts(spark, sf):
    return ve.pending_verdicts(candidates(spark, sf), documents(spark, sf).distinct()).select("candidate_id", "why")


@query("normalise_verdicts", "J5", f"""
WITH {CAND} SELECT c.candidate_id, CASE WHEN {OK} THEN upper(d.verdict) ELSE 'CONDITIONAL' END AS verdict, CASE WHEN {OK} THEN upper(d.severity) ELSE c.severity END AS severity, c.severity AS proposed_severity,
  CASE WHEN {OK} THEN d.disproof_attempt ELSE 'the verdict was missing or broke its form, so the proposed severity stands' END AS disproof_attempt, coalesce({OK}, false) AS was_valid
FROM cands c LEFT JOIN (SELECT DISTINCT * FROM docs) d ON d.candidate_id = c.candidate_id""")
def normalise_verdicts(spark, sf):
    out = ve.normalise_verdicts(candidates(spark, sf), documents(spark, sf).distinct())
    return out.select("candidate_id", "verdict", "severity", "proposed_severity", "disproof_attempt", "was_valid")


@query("verdict_violations", "J2", f"""
WITH {CAND} SELECT c.candidate_id, CASE WHEN d.verdict IS NULL THEN 'no verdict' WHEN upper(d.verdict) = 'MAYBE' THEN 'off-enum verdict' ELSE 'off-enum severity' END AS problem
FROM cands c LEFT JOIN (SELECT DISTINCT * FROM docs) d ON d.candidate_id = c.candidate_id WHERE c.sev_rank >= 3 AND (d.verdict IS NULL OR d.verdict = 'MAYBE' OR d.severity = 'BLOCKER')""")
def verdict_violations(spark, sf):
    return ve.verdict_violations(candidates(spark, sf), documents(spark, sf).distinct())


def findings(spark, sf):
    clean = view(spark, sf, "f4").select(F.col("o_orderkey").alias("l_orderkey"), "verdict", "severity")
    c = candidates(spark, sf)
    docs = c.select("candidate_id", "l_orderkey").distinct().join(clean, "l_orderkey").drop("l_orderkey")
    return ve.apply_verdicts(c, docs)


@query("apply_verdicts", "J2 K2", "SELECT finding_id AS candidate_id, status, final_severity AS severity, CASE WHEN sev_rank >= 3 THEN 'CWE-000' END AS cwe, reach_basis FROM findings")
def apply_verdicts(spark, sf):
    return findings(spark, sf).select("candidate_id", "status", "severity", "cwe", "reach_basis")


@query("conservation", "A7 K2", """
SELECT unit_id, count(*) AS candidates, count(*) FILTER (WHERE status <> 'refuted') AS emitted, count(*) FILTER (WHERE status = 'refuted') AS refuted, true AS conserved FROM findings GROUP BY unit_id""")
def conservation(spark, sf):
    return ve.conservation(findings(spark, sf), candidates(spark, sf), ["unit_id"])


@query("finalize", "K2", """
WITH c AS (SELECT conv_id AS chain_id, turn AS hop_ord, (conv_id * 200 + turn) % 900 AS k FROM conversations), s AS (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders WHERE o_orderkey % 7 > 0)
SELECT 'findings' AS part, status AS key, count(*) AS n FROM findings GROUP BY status
UNION ALL SELECT 'conserved', 'true', count(*) FROM findings""")
def finalize(spark, sf):
    from passledger.plans.finalize import finalize as run

    clean = view(spark, sf, "f4").select(F.col("o_orderkey").alias("l_orderkey"), "verdict", "severity")
    c = candidates(spark, sf)
    docs = c.select("candidate_id", "l_orderkey").distinct().join(clean, "l_orderkey").drop("l_orderkey").withColumns(
        {"per_file": F.lit(True), "n_keys": F.lit(3), "ord": F.lit(1)})
    out = run(c, docs)
    counts = out.findings.groupBy(F.lit("findings").alias("part"), F.col("status").alias("key")).agg(F.count("*").alias("n"))
    total = out.conservation.select(F.lit("conserved").alias("part"), F.col("conserved").cast("string").alias("key"), F.col("candidates").alias("n"))
    return counts.unionByName(total)


@query("disposition_conservation", "A8", """
WITH d AS (SELECT l_suppkey % 10 AS run, CASE l_partkey % 6 WHEN 0 THEN 'folded' WHEN 1 THEN 'census' WHEN 2 THEN 'screened' WHEN 3 THEN 'refuted' WHEN 4 THEN CASE WHEN l_suppkey % 10 = 3 THEN 'lost' ELSE 'folded' END ELSE CASE WHEN l_suppkey % 10 <> 5 THEN 'census' END END AS disposition FROM lineitem)
SELECT run, count(*) AS total, count(*) FILTER (WHERE disposition = 'folded') AS folded, count(*) FILTER (WHERE disposition = 'census') AS census, count(*) FILTER (WHERE disposition = 'screened') AS screened,
  count(*) FILTER (WHERE disposition = 'refuted') AS refuted, count(*) FILTER (WHERE disposition IS NULL OR disposition = 'lost') AS residue, count(*) FILTER (WHERE disposition IS NULL OR disposition = 'lost') = 0 AS conserved FROM d GROUP BY run""")
def disposition_conservation(spark, sf):
    d = view(spark, sf, "lineitem").selectExpr("l_suppkey % 10 AS run", "CASE l_partkey % 6 WHEN 0 THEN 'folded' WHEN 1 THEN 'census' WHEN 2 THEN 'screened' WHEN 3 THEN 'refuted' WHEN 4 THEN CASE WHEN l_suppkey % 10 = 3 THEN 'lost' ELSE 'folded' END ELSE CASE WHEN l_suppkey % 10 <> 5 THEN 'census' END END AS disposition")
    return ve.disposition_conservation(d, ["run"])


TIERS = "count(*) FILTER (WHERE {w} AND s = 'PRIORITIZED_CRITICAL') AS pc, count(*) FILTER (WHERE {w} AND s = 'CRITICAL') AS critical, count(*) FILTER (WHERE {w} AND s = 'HIGH') AS high, count(*) FILTER (WHERE {w} AND s = 'MEDIUM') AS medium, count(*) FILTER (WHERE {w} AND s = 'LOW') AS low"


@query("tier_tally", "A6", f"""
WITH f AS (SELECT unit_id, status, final_severity AS s FROM findings WHERE status <> 'refuted')
SELECT unit_id, count(*) AS total, count(*) FILTER (WHERE status = 'conditional-court') AS wp, {TIERS.replace('{w}', "status <> 'conditional-court'")} FROM f GROUP BY unit_id""")
def tier_tally(spark, sf):
    return ve.tier_tally(findings(spark, sf), ["unit_id"])


@query("published_totals", "A27 A22", f"""
WITH f AS (SELECT unit_id, status, final_severity AS s, synthetic, CASE WHEN sev_rank >= 3 AND l_suppkey % 4 = 0 THEN 'hermetic-executed' ELSE 'static-reasoned' END AS b FROM findings)
SELECT unit_id, count(*) FILTER (WHERE status <> 'refuted' AND NOT synthetic) AS emitted, count(*) FILTER (WHERE status <> 'refuted' AND synthetic) AS synthetic, count(*) FILTER (WHERE status = 'verified' AND NOT synthetic) AS verified,
  count(*) FILTER (WHERE status = 'conditional-court') AS conditional_court, count(*) FILTER (WHERE status = 'refuted') AS refuted, count(*) FILTER (WHERE status <> 'refuted' AND b = 'hermetic-executed') AS executed,
  {TIERS.replace('{w}', "status NOT IN ('refuted', 'conditional-court') AND NOT synthetic")} FROM f GROUP BY unit_id""")
def published_totals(spark, sf):
    f = findings(spark, sf).withColumn("synthetic", F.expr("l_partkey % 97 = 0")).withColumn(
        "verification_basis", F.expr("CASE WHEN l_suppkey % 4 = 0 AND cwe IS NOT NULL THEN 'hermetic-executed' ELSE 'static-reasoned' END"))
    return ve.published_totals(f, ["unit_id"])


HOPS = """
hops AS (SELECT chain_id, hop_ord, (finding_key * 7) % (CASE WHEN chain_id % 3 = 0 THEN 100000 ELSE 12000 END) AS finding_key FROM (
  SELECT chain_id, hop_ord, finding_key FROM f9 UNION ALL SELECT -1 - chain_id, hop_ord, finding_key FROM f9 WHERE hop_ord = 0)),
states AS (SELECT o_orderkey AS finding_key, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'refuted' ELSE 'verified' END ELSE 'conditional-court' END AS status FROM orders)"""


def _hops(spark, sf):
    all_hops = view(spark, sf, "f9").select("chain_id", "hop_ord", "finding_key")
    short = all_hops.filter("hop_ord = 0").withColumn("chain_id", -1 - F.col("chain_id"))  # planted: chains of one hop
    h = all_hops.unionByName(short).selectExpr("chain_id", "hop_ord", "(finding_key * 7) % (CASE WHEN chain_id % 3 = 0 THEN 100000 ELSE 12000 END) AS finding_key")
    s = view(spark, sf, "orders").selectExpr("o_orderkey AS finding_key", "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'refuted' ELSE 'verified' END ELSE 'conditional-court' END AS status")
    return h, s


@query("validate_chains", "J12", f"""
WITH {HOPS}, p AS (SELECT h.chain_id, count(*) AS n_hops, count(*) FILTER (WHERE s.status IS NULL) AS missing, count(*) FILTER (WHERE s.status = 'refuted') AS refuted, count(*) FILTER (WHERE s.status = 'verified') AS v
  FROM hops h LEFT JOIN states s ON s.finding_key = h.finding_key GROUP BY h.chain_id)
SELECT chain_id, n_hops, missing, refuted, CASE WHEN n_hops < 2 THEN 'malformed' WHEN missing + refuted > 0 THEN 'dropped' WHEN v = n_hops THEN 'confirmed' ELSE 'conditional' END AS status FROM p""")
def validate_chains(spark, sf):
    return ve.validate_chains(*_hops(spark, sf))


@query("close_chains", "J13", f"""
WITH {HOPS} SELECT h.chain_id, count(*) AS n_hops FROM hops h LEFT JOIN (SELECT DISTINCT finding_key FROM states WHERE status <> 'refuted') s ON s.finding_key = h.finding_key GROUP BY 1 HAVING count(*) = count(s.finding_key)""")
def close_chains(spark, sf):
    h, s = _hops(spark, sf)
    return ve.close_chains(h, s.filter("status <> 'refuted'"))


ATTR = """
inside AS (SELECT finding_id AS candidate_id, l_orderkey, l_partkey, path FROM findings WHERE l_partkey % 6 = 0),
attributed AS (SELECT DISTINCT candidate_id, CASE WHEN l_orderkey % 9 = 0 THEN 'synthetic' WHEN l_orderkey % 4 = 0 THEN 'genuine' WHEN l_orderkey % 4 = 1 THEN 'synthetic' ELSE 'unresolved' END AS disposition,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 4 = 0 THEN 'PRESENT' WHEN l_orderkey % 4 = 1 THEN 'ABSENT' END AS clean_verdict FROM inside)"""


def _attributed(spark, sf):
    f = candidates(spark, sf)
    clean = f.selectExpr("candidate_id", "CASE l_orderkey % 4 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'ABSENT' WHEN 2 THEN 'UNSURE' END AS clean_verdict", "'traced' AS basis")
    return ve.attribute_candidates(f.select("candidate_id", "path").distinct(), f.filter("l_partkey % 6 = 0").select("path"),
                                   f.filter("l_orderkey % 9 = 0").select("candidate_id"), clean)


@query("attribute_candidates", "J14", f"WITH {ATTR} SELECT * FROM attributed")
def attribute_candidates(spark, sf):
    return _attributed(spark, sf).select("candidate_id", "disposition", "clean_verdict")


@query("apply_dispositions", "J15", f"""
WITH {ATTR} SELECT f.finding_id AS candidate_id, coalesce(a.disposition = 'synthetic', false) AS synthetic, coalesce(a.disposition = 'synthetic', false) <> f.synthetic AS changed
FROM findings f LEFT JOIN attributed a ON a.candidate_id = f.finding_id""")
def apply_dispositions(spark, sf):
    f = candidates(spark, sf).select("candidate_id", F.expr("l_partkey % 97 = 0 AS synthetic"))
    return ve.apply_dispositions(f, _attributed(spark, sf))


@query("findings_near", "A25 T7", """
WITH r AS (SELECT path, finding_id AS candidate_id, row_number() OVER (PARTITION BY path ORDER BY sev_rank DESC, line, finding_id) AS place FROM findings WHERE l_partkey % 4 = 0)
SELECT path, candidate_id, place FROM r WHERE place <= 20""")
def findings_near(spark, sf):
    f = candidates(spark, sf)
    near = ve.findings_near(f, f.filter("l_partkey % 4 = 0").select("path"))
    return near.select("path", "candidate_id", F.col("place").cast("bigint").alias("place"))


@query("candidate_tally", "A26", "SELECT unit_id, count(*) AS total, count(*) FILTER (WHERE sev_rank >= 3) AS serious FROM f2_valid GROUP BY unit_id")
def candidate_tally(spark, sf):
    return ve.candidate_tally(view(spark, sf, "f2_valid"), ["unit_id"])


@query("verdict_tally", "A26", """
SELECT o_custkey, count(*) FILTER (WHERE verdict = 'VERIFIED') AS verified, count(*) FILTER (WHERE verdict = 'CONDITIONAL') AS conditional, count(*) FILTER (WHERE verdict = 'REFUTED') AS refuted FROM f4 GROUP BY o_custkey""")
def verdict_tally(spark, sf):
    return ve.verdict_tally(view(spark, sf, "f4"), ["o_custkey"])


@query("restore_verdicts", "S14", """
SELECT finding_id AS candidate_id, CASE status WHEN 'verified' THEN 'VERIFIED' WHEN 'refuted' THEN 'REFUTED' ELSE 'CONDITIONAL' END AS verdict, final_severity AS severity, severity AS proposed_severity FROM findings WHERE status <> 'conditional'""")
def restore_verdicts(spark, sf):
    c = candidates(spark, sf)
    good = ve.restore_verdicts(findings(spark, sf), c.select("candidate_id", "severity"))[0]
    return good.select("candidate_id", "verdict", "severity", "proposed_severity")


@query("verdict_batches", "T5", """
WITH p AS (SELECT pass, path, line, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY pass ORDER BY path, line, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS ordinal FROM f2_valid WHERE sev_rank >= 3)
SELECT pass, path, line, l_orderkey, l_linenumber, l_suppkey, ordinal, (ordinal - 1) // 16 AS batch FROM p""")
def verdict_batches(spark, sf):
    p = view(spark, sf, "f2_valid").filter("sev_rank >= 3").select("pass", "path", "line", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return ranking.batches(p, ["pass"], ["path", "line", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]).drop("l_quantity")


@query("review_backlog", "T5 A20", f"""
WITH {SLOTS}, n AS (SELECT slot, slot_pass, count(*) FILTER (WHERE is_new_serious) AS n FROM marked WHERE phase <> 'sweep' GROUP BY ALL),
k AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM n WHERE slot_pass IN (SELECT pass FROM modes WHERE mode = 'full')),
y AS (SELECT greatest(1, n) AS typical_yield FROM k WHERE r = c // 2 + 1),
p AS (SELECT unit_id, count(*) AS pending FROM f2_valid WHERE sev_rank >= 3 GROUP BY unit_id)
SELECT unit_id, pending, pending > 2 * typical_yield AS verdicts_first FROM p, y""")
def review_backlog(spark, sf):
    """Pending verdicts against the yield that the passes so far had."""
    pending = view(spark, sf, "f2_valid").filter("sev_rank >= 3").groupBy("unit_id").agg(F.count("*").alias("pending"))
    return cv.verdicts_first(pending, cv.typical_yield(hist.mark_new(hist.observed_ids(_rows(spark, sf))), _modes(spark, sf)))
