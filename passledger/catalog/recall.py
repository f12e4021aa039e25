"""Slot matching, miss diagnosis, totals, calibration, priors, draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from passledger import constants as C
from passledger.catalog import query
from passledger.operators import priors as pr
from passledger.operators import ranking as rk
from passledger.operators import recall as rc
from passledger.session import cut
from passledger.views import view

KEYWORDS = " OR ".join(
    f"(s.family = '{f}' AND (" + " OR ".join(f"contains(c.t, '{w}')" for w in words) + "))" for f, words in C.FAMILY_KEYWORDS.items())
FAMILY = "CASE x % 4 WHEN 0 THEN 'L1-auth' WHEN 1 THEN 'L2-secrets' WHEN 2 THEN 'L3-injection' ELSE 'L4-infra' END"
SLOT_ROWS = """SELECT p.p_partkey * 3 + k.k AS slot, concat('src', p.p_partkey % 20, '/m', p.p_partkey % 7, '/f', p.p_partkey, '.py') AS path,
  {family} AS family, CAST(1 + 4 * ((p.p_size + 2 * k.k) % 50) AS BIGINT) AS line, p.p_partkey % 5 = 0 AS historical
FROM part p CROSS JOIN (VALUES (0), (1), (2)) k(k)""".replace("{family}", FAMILY.replace("x % 4", "(p.p_partkey + p.p_partkey * k.k) % 4"))

MATCH = f"""
slots AS ({SLOT_ROWS}),
c AS (SELECT id AS candidate_id, path, line, min(lens) AS lens, min(category) AS category, lower(min(category)) AS t FROM f2_valid GROUP BY id, path, line),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY slot) AS k FROM slots),
pairs AS (SELECT s.slot, list(c.candidate_id ORDER BY abs(c.line - s.line), c.line, c.candidate_id) AS cs FROM slots s JOIN c ON c.path = s.path AND abs(c.line - s.line) <= 40
          WHERE c.lens = s.family OR {KEYWORDS} GROUP BY s.slot),
walk AS (
  SELECT path, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS claimed, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS VARCHAR) AS matched_id FROM (SELECT DISTINCT path FROM slots)
  UNION ALL
  SELECT path, k, CASE WHEN pick IS NULL THEN claimed ELSE list_append(claimed, pick) END, slot, pick
  FROM (SELECT w.path, r.k, w.claimed, r.slot, list_filter(p.cs, lambda x: NOT list_contains(w.claimed, x))[1] AS pick
        FROM walk w JOIN ranked r ON r.path = w.path AND r.k = w.k + 1 LEFT JOIN pairs p ON p.slot = r.slot)),
scored AS (SELECT s.*, w.matched_id, w.matched_id IS NOT NULL AS found FROM slots s JOIN walk w ON w.slot = s.slot)"""


def slots(spark, sf):
    p = view(spark, sf, "part").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return p.selectExpr(
        "p_partkey * 3 + k AS slot", "concat('src', p_partkey % 20, '/m', p_partkey % 7, '/f', p_partkey, '.py') AS path",
        FAMILY.replace("x % 4", "(p_partkey + p_partkey * k) % 4") + " AS family", "CAST(1 + 4 * ((p_size + 2 * k) % 50) AS BIGINT) AS line", "p_partkey % 5 = 0 AS historical")


def candidates(spark, sf):
    v = view(spark, sf, "f2_valid")
    return v.groupBy(F.col("id").alias("candidate_id"), "path", "line").agg(F.min("lens").alias("lens"), F.min("category").alias("category")).withColumn("title", F.lit(""))


def scored(spark, sf, found=None):
    return rc.match_slots(slots(spark, sf), found if found is not None else candidates(spark, sf))


@query("match_slots", "J7", f"WITH RECURSIVE {MATCH} SELECT s.slot, s.found, s.matched_id, abs(c.line - s.line) AS line_distance FROM scored s LEFT JOIN c ON c.candidate_id = s.matched_id")
def match_slots(spark, sf):
    return scored(spark, sf).select("slot", "found", "matched_id", "line_distance")


@query("diagnose_misses", "J16", f"""
WITH RECURSIVE {MATCH}, missed AS (SELECT * FROM scored WHERE NOT found AND NOT historical), taken AS (SELECT matched_id FROM scored WHERE found),
sib AS (SELECT m.slot, min(o.slot) AS shadowed_by FROM missed m JOIN scored o ON o.path = m.path AND o.family = m.family AND o.slot <> m.slot AND NOT o.historical AND abs(o.line - m.line) <= 10 GROUP BY 1),
near AS (SELECT s.slot, bool_and(t.matched_id IS NOT NULL) AS claimed FROM missed s JOIN c ON c.path = s.path AND abs(c.line - s.line) <= 40 AND (c.lens = s.family OR {KEYWORDS})
         LEFT JOIN taken t ON t.matched_id = c.candidate_id GROUP BY 1)
SELECT m.slot, CASE WHEN sib.shadowed_by IS NOT NULL THEN 'fold-shadow' WHEN near.claimed THEN 'claim-shadow' ELSE 'cold-miss' END AS mechanism, sib.shadowed_by
FROM missed m LEFT JOIN sib ON sib.slot = m.slot LEFT JOIN near ON near.slot = m.slot""")
def diagnose_misses(spark, sf):
    found = cut(candidates(spark, sf), "zstd")
    return rc.diagnose_misses(scored(spark, sf, found), found)


@query("mislabelled_slots", "J24", f"""
WITH RECURSIVE {MATCH}, h AS (SELECT s.slot, s.family, c.candidate_id, row_number() OVER (PARTITION BY s.slot ORDER BY c.line, c.candidate_id) AS r
  FROM scored s JOIN c ON c.path = s.path AND abs(c.line - s.line) <= 40 WHERE s.historical AND NOT s.found)
SELECT slot, family, candidate_id AS refound_as FROM h WHERE r = 1""")
def mislabelled_slots(spark, sf):
    found = cut(candidates(spark, sf), "zstd")
    return rc.mislabelled(scored(spark, sf, found), found)


RUNS = """
cur AS (SELECT slot, slot % 100 AS run, (slot // 100 + slot) % 4 > 0 OR slot % 100 < 20 AS found, (slot // 100) % 5 = 0 AS historical, slot % 100 = 7 AND (slot // 100) % 7 = 1 AS drift FROM f5),
prev AS (SELECT slot, slot % 6 > 1 AS found, slot % 18 = 5 AS cured, slot % 12 = 1 AS mint_error FROM f5 WHERE slot % 9 <> 0),
joined AS (SELECT c.*, (coalesce(p.cured, false) OR (c.found AND NOT coalesce(p.found, false))) AND c.found AS cured, NOT c.found AND (coalesce(p.mint_error, false) OR c.slot % 11 = 3) AS mint_error
  FROM cur c LEFT JOIN prev p ON p.slot = c.slot)"""


def _delta(spark, sf):
    f5 = view(spark, sf, "f5")
    cur = f5.selectExpr("slot", "slot % 100 AS run", "(slot div 100 + slot) % 4 > 0 OR slot % 100 < 20 AS found", "(slot div 100) % 5 = 0 AS historical", "slot % 100 = 7 AND (slot div 100) % 7 = 1 AS drift")
    prev = f5.filter("slot % 9 <> 0").selectExpr("slot", "slot % 6 > 1 AS found", "slot % 18 = 5 AS cured", "slot % 12 = 1 AS mint_error")
    return rc.score_delta(cur, prev, f5.filter("slot % 11 = 3").select("slot"))


@query("score_delta", "J20", f"WITH {RUNS} SELECT slot, found, cured, mint_error FROM joined")
def score_delta(spark, sf):
    return _delta(spark, sf).select("slot", "found", "cured", "mint_error")


@query("recall_totals", "A13 A14", f"""
WITH {RUNS}, t AS (SELECT run, count(*) FILTER (WHERE NOT historical AND found) AS found, count(*) FILTER (WHERE NOT historical AND cured) AS cured, count(*) FILTER (WHERE NOT historical AND mint_error) AS mint_error,
  count(*) FILTER (WHERE NOT historical) AS total, count(*) FILTER (WHERE historical) AS historical_total, count(*) FILTER (WHERE historical AND found) AS historical_found, count(*) FILTER (WHERE drift AND NOT mint_error) AS blocking FROM joined GROUP BY run),
cc AS (SELECT l_suppkey % 100 AS run, count(*) AS n FROM lineitem GROUP BY 1)
SELECT t.run, found, cured, mint_error, found - cured AS cold, total, historical_total, historical_found, n AS candidate_count, greatest(64, (500 + t.run * 800) // 100) AS saturation_limit,
  CASE WHEN blocking > 0 THEN 'INVALID' WHEN n > greatest(64, (500 + t.run * 800) // 100) THEN 'SATURATED' WHEN found + mint_error = total AND total = 16 THEN 'PASS' ELSE 'FAIL' END AS status
FROM t JOIN cc ON cc.run = t.run""")
def recall_totals(spark, sf):
    cand = view(spark, sf, "lineitem").selectExpr("l_suppkey % 100 AS run")
    lines = view(spark, sf, "f5").selectExpr("slot % 100 AS run").distinct().withColumn("scannable_lines", 500 + F.col("run") * 800)
    sat = rc.saturation(cand, lines, ["run"])
    totals = rc.recall_totals(_delta(spark, sf), sat, ["run"], expected=16).join(sat.drop("saturated", "scannable_lines"), "run")
    return totals.select("run", "found", "cured", "mint_error", "cold", "total", "historical_total", "historical_found", "candidate_count", "saturation_limit", "status")


@query("family_spread", "A24", """
SELECT slot % 50 AS run, family, count(*) AS slots, count(DISTINCT path) AS files, count(*) = 20 AS count_ok, count(*) = count(DISTINCT path) AS files_ok FROM (SELECT slot, family, CASE WHEN slot % 7 = 0 THEN 'same' ELSE path END AS path FROM f5) GROUP BY ALL""")
def family_spread(spark, sf):
    f5 = view(spark, sf, "f5").selectExpr("slot % 50 AS run", "family", "CASE WHEN slot % 7 = 0 THEN 'same' ELSE path END AS path")
    return rc.family_spread(f5, 20, ["run"])


CALIBRATION = f"""
WITH RECURSIVE keys AS (
  SELECT slot // 8 AS key_id, slot, family, concat('src/f', slot // 16, CASE WHEN slot % 8 < 5 THEN slot % 8 ELSE 4 END, '.py') AS path, line, title FROM f5 WHERE slot % 8 <> 7),
jitters(jitter_ord, jitter) AS (VALUES {", ".join(f"({i}, {j})" for i, j in enumerate(C.CALIBRATION_JITTERS))}),
runs AS (SELECT *, concat(key_id, '/', jitter_ord, '/', path) AS place, greatest(1, line + jitter) AS seen, lower(concat(family, ' replay probe slot ', slot)) AS cat,
  row_number() OVER (PARTITION BY key_id, jitter_ord, path ORDER BY slot) AS k FROM keys CROSS JOIN jitters),
ids AS (SELECT *, concat('OBS-', substring(sha256(concat(path, chr(0), CAST(seen AS VARCHAR), chr(0), cat)), 1, 16)) AS id FROM runs),
walk AS (
  SELECT place, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(line BIGINT, lens VARCHAR, id VARCHAR)[]) AS entries, CAST(NULL AS VARCHAR) AS id, false AS founds FROM (SELECT DISTINCT place FROM ids)
  UNION ALL
  SELECT place, k, CASE WHEN hit IS NULL THEN list_append(entries, {{line: CAST(seen AS BIGINT), lens: family, id: id}}) ELSE entries END, id, hit IS NULL
  FROM (SELECT w.place, o.k, w.entries, o.seen, o.family, o.id,
          coalesce(list_filter(w.entries, lambda e: e.line = o.seen AND e.lens = o.family)[1].id, list_filter(w.entries, lambda e: e.id = o.id)[1].id,
                   list_filter(w.entries, lambda e: e.lens = o.family AND abs(e.line - o.seen) <= 10)[1].id) AS hit
        FROM walk w JOIN ids o ON o.place = w.place AND o.k = w.k + 1)),
c AS (SELECT i.place, i.id AS candidate_id, i.seen AS line, i.family AS lens, lower(concat(i.cat, ' ', coalesce(i.title, 'replay probe'))) AS t FROM walk w JOIN ids i ON i.place = w.place AND i.k = w.k WHERE w.founds),
pairs AS (SELECT s.place, s.k, list(c.candidate_id ORDER BY abs(c.line - s.line), c.line, c.candidate_id) AS cs FROM ids s JOIN c ON c.place = s.place AND abs(c.line - s.line) <= 40
          WHERE c.lens = s.family OR {KEYWORDS} GROUP BY s.place, s.k),
claims AS (
  SELECT place, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS claimed, CAST(NULL AS VARCHAR) AS pick FROM (SELECT DISTINCT place FROM ids)
  UNION ALL
  SELECT place, k, CASE WHEN pick IS NULL THEN claimed ELSE list_append(claimed, pick) END, pick
  FROM (SELECT w.place, r.k, w.claimed, list_filter(p.cs, lambda x: NOT list_contains(w.claimed, x))[1] AS pick
        FROM claims w JOIN ids r ON r.place = w.place AND r.k = w.k + 1 LEFT JOIN pairs p ON p.place = r.place AND p.k = r.k)),
per AS (SELECT i.key_id, i.jitter_ord, any_value(i.jitter) AS jitter, count(w.pick) AS matched, count(*) AS total FROM ids i JOIN claims w ON w.place = i.place AND w.k = i.k GROUP BY i.key_id, i.jitter_ord),
worst AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY matched, jitter_ord) AS r FROM per)
SELECT key_id, jitter, matched, total, matched = total AND total > 0 AS passed FROM worst WHERE r = 1"""


@query("calibrate_keys", "K3", CALIBRATION)
def calibrate_keys(spark, sf):
    keys = view(spark, sf, "f5").selectExpr(
        "slot div 8 AS key_id", "slot", "family", "concat('src/f', slot div 16, CASE WHEN slot % 8 < 5 THEN slot % 8 ELSE 4 END, '.py') AS path", "line", "title", "slot % 8 = 7 AS historical")
    return rc.calibrate(keys)


PRIORS = """
files AS (SELECT DISTINCT path FROM f2_valid UNION SELECT concat('dup/f', p_partkey, '.py') FROM part WHERE p_partkey % 10 = 1),
targets AS (SELECT slot, id, family, line, title, CASE WHEN slot % 13 = 2 THEN concat('f', slot, '.py') WHEN slot % 17 = 3 THEN concat(slot, '.py') WHEN slot % 7 = 3 THEN concat('m', slot % 7, '/f', slot, '.py') ELSE path END AS path FROM f5),
suffix AS (SELECT t.path AS t, count(*) AS n, min(f.path) AS p FROM (SELECT DISTINCT path FROM targets) t JOIN files f ON ends_with(f.path, t.path) GROUP BY 1),
bases AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS b, count(*) AS n, min(path) AS p FROM files GROUP BY 1),
resolved AS (SELECT t.*, coalesce(f.path, CASE WHEN s.n = 1 THEN s.p END, CASE WHEN b.n = 1 THEN b.p END) AS resolved FROM targets t LEFT JOIN files f ON f.path = t.path
  LEFT JOIN suffix s ON s.t = t.path LEFT JOIN bases b ON b.b = regexp_extract(t.path, '([^/]*)$', 1)),
hashed AS (SELECT *, sha256(id) AS h, resolved IS NOT NULL AND slot % 3 = 0 AS ok FROM resolved),
drawn AS (SELECT *, row_number() OVER (ORDER BY h) AS draw_ord FROM hashed WHERE ok ORDER BY h LIMIT 40)"""


def _targets(spark, sf):
    files = view(spark, sf, "f2_valid").select("path").distinct().unionByName(
        view(spark, sf, "part").filter("p_partkey % 10 = 1").selectExpr("concat('dup/f', p_partkey, '.py') AS path"))
    t = view(spark, sf, "f5").withColumn("path", F.expr(
        "CASE WHEN slot % 13 = 2 THEN concat('f', slot, '.py') WHEN slot % 17 = 3 THEN concat(slot, '.py') WHEN slot % 7 = 3 THEN concat('m', slot % 7, '/f', slot, '.py') ELSE path END"))
    return pr.resolve_paths(t, files)


def _drawn(targets):
    return rk.hash_draw(targets, "id", 40, F.col("resolved").isNotNull() & (F.col("slot") % 3 == 0))


@query("resolve_paths", "J9", f"WITH {PRIORS} SELECT slot, path, resolved FROM resolved")
def resolve_paths(spark, sf):
    return _targets(spark, sf).select("slot", "path", "resolved")


@query("hash_draw", "T1", f"WITH {PRIORS} SELECT id, resolved, draw_ord FROM drawn")
def hash_draw(spark, sf):
    return _drawn(_targets(spark, sf))[0].select("id", "resolved", "draw_ord")


@query("draw_skipped", "T1", f"WITH {PRIORS} SELECT id FROM hashed WHERE NOT ok AND h < (SELECT max(h) FROM drawn)")
def draw_skipped(spark, sf):
    return _drawn(cut(_targets(spark, sf)))[1].select("id")


@query("heat_split", "J10", f"""
WITH {PRIORS}, d AS (SELECT *, regexp_replace(resolved, '/[^/]*$', '') AS dir FROM drawn), n AS (
  SELECT r.id, arg_min(CASE WHEN r.resolved = d.resolved THEN 'same-file' ELSE 'same-directory-and-family' END, d.draw_ord) AS reason FROM resolved r JOIN d
  ON r.resolved = d.resolved OR (regexp_replace(r.resolved, '/[^/]*$', '') = d.dir AND r.family = d.family) GROUP BY r.id)
SELECT r.id, CASE WHEN r.resolved IS NULL THEN 'unresolved' WHEN r.id IN (SELECT id FROM drawn) THEN 'drawn' ELSE n.reason END AS reason FROM resolved r LEFT JOIN n ON n.id = r.id""")
def heat_split(spark, sf):
    targets = cut(_targets(spark, sf))
    return pr.heat_split(targets, _drawn(targets)[0]).select("id", "reason")


@query("heat_per_unit", "J23", f"""
WITH {PRIORS}, p AS (SELECT f.unit_id, concat(r.resolved, ':', r.line, ' ', r.family, ' ', r.title) AS seed FROM resolved r JOIN f3 f ON f.path = r.resolved )
SELECT * FROM p UNION ALL SELECT DISTINCT unit_id, 'no historical heat for this unit' FROM f3 WHERE unit_id NOT IN (SELECT unit_id FROM p)""")
def heat_per_unit(spark, sf):
    return pr.heat_lines(_targets(spark, sf), view(spark, sf, "f3"))


DISPOSED = PRIORS + f""",
f AS (SELECT finding_id, path, lens, status, l_orderkey AS ord, lower(concat(category, ' ', title)) AS t FROM findings),
m AS (SELECT s.id, f.finding_id, f.status, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN f.status = 'verified' THEN 0 ELSE 1 END, f.ord, f.finding_id) AS r
  FROM resolved s JOIN f ON f.path = s.resolved WHERE f.lens = s.family OR {KEYWORDS.replace('c.t', 'f.t')}),
disposed AS (SELECT r.id, CASE WHEN m.id IS NULL THEN 'NOT-EVIDENCED' ELSE 'REFOUND' END AS disposition, CASE WHEN r.resolved IS NULL THEN 'locus-not-found' WHEN m.id IS NULL THEN 'defect-not-present' END AS sub_class,
  m.finding_id, m.status AS finding_status, r.slot % 2 = 0 AS briefed FROM resolved r LEFT JOIN m ON m.id = r.id AND m.r = 1)"""


def _disposed(spark, sf):
    f = view(spark, sf, "findings").select(
        F.col("finding_id").alias("id"), "path", "lens", "category", "title", "status", F.col("l_orderkey").alias("ord"))
    t = cut(_targets(spark, sf))
    return pr.dispositions(t, f, t.filter("slot % 2 = 0"))


@query("prior_dispositions", "J11", f"WITH {DISPOSED} SELECT * FROM disposed")
def prior_dispositions(spark, sf):
    return _disposed(spark, sf).select("id", "disposition", "sub_class", "finding_id", "finding_status", "briefed")


@query("disposition_totals", "J11 A22", f"""
WITH {DISPOSED} SELECT count(*) AS staged, count(*) FILTER (WHERE disposition = 'REFOUND') AS refound, count(*) FILTER (WHERE disposition = 'REFOUND' AND NOT briefed) AS blind_refound,
  count(*) FILTER (WHERE disposition <> 'REFOUND') AS not_evidenced, count(*) FILTER (WHERE disposition <> 'REFOUND') AS not_evidenced_receipted,
  count(*) FILTER (WHERE finding_status = 'verified') AS refound_verified, count(*) FILTER (WHERE finding_status = 'refuted') AS refound_refuted,
  count(*) FILTER (WHERE finding_status NOT IN ('verified', 'refuted')) AS refound_folded FROM disposed""")
def disposition_totals(spark, sf):
    return pr.disposition_totals(_disposed(spark, sf))


@query("dedup_draw", "T2", """
WITH o AS (SELECT DISTINCT o_custkey, arg_min(o_orderkey, o_orderkey) OVER (PARTITION BY o_custkey) AS o_orderkey FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY sha256(CAST(o_custkey AS VARCHAR))) AS draw_ord FROM o QUALIFY draw_ord <= 25""")
def dedup_draw(spark, sf):
    first = rk.first_per_id(view(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return rk.hash_draw(first, "o_custkey", 25)[0].select("o_custkey", "o_orderkey", "draw_ord")


@query("audit_sample", "T3", """
WITH c AS (SELECT id, path, line, category FROM f2_valid GROUP BY ALL), s AS (SELECT substring(sha256('r-0123456789ab'), 1, 8) AS seed)
SELECT id, path, line, seed, true AS id_ok, EXISTS (SELECT 1 FROM f3 f WHERE f.path = c.path AND f.unit_id <> 'UNIT-003') AS path_exists FROM c CROSS JOIN s ORDER BY sha256(concat(seed, id)), id LIMIT 25""")
def audit_sample(spark, sf):
    c = view(spark, sf, "f2_valid").select("id", "path", "line", "category").distinct()
    return rk.audit_sample(c, view(spark, sf, "f3").filter("unit_id <> 'UNIT-003'"), "r-0123456789ab", 25)


@query("mixed_draw", "T4", """
WITH s AS (SELECT slot, family, slot % 3 = 0 AS historical FROM f5)
SELECT * FROM (SELECT * FROM s WHERE NOT historical ORDER BY sha256(concat('slot-', slot)) LIMIT 4) UNION ALL SELECT * FROM (SELECT * FROM s WHERE historical ORDER BY slot LIMIT 4)""")
def mixed_draw(spark, sf):
    return rk.mixed_draw(view(spark, sf, "f5").selectExpr("slot", "family", "slot % 3 = 0 AS historical"))
