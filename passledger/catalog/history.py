"""Pass history, coverage, convergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from passledger.catalog import query
from passledger.catalog.observations import FOLD_SQL, sequenced
from passledger.operators import convergence as cv
from passledger.operators import history as hist
from passledger.operators.fold import fold_observations
from passledger.plans.consolidate import consolidate, review_state as state_of
from passledger.session import cut
from passledger.views import view


def _rows(spark, sf):
    """Raw-id history rows: pass 2 of odd suppliers is a sweep; every unit is read by the lenses of its rows."""
    rows = view(spark, sf, "f2_valid")
    return rows.withColumn("phase", F.expr("CASE WHEN l_suppkey % 12 = 1 THEN 'sweep' ELSE 'pass' END"))


SLOTS = """
rows AS (SELECT *, CASE WHEN l_suppkey % 12 = 1 THEN 'sweep' ELSE 'pass' END AS phase FROM f2_valid),
slotted AS (SELECT *, CASE WHEN phase = 'sweep' THEN 1 ELSE pass END AS slot_pass,
                   CAST(CASE WHEN phase = 'sweep' THEN 2 WHEN pass = 1 THEN 1 ELSE pass + 1 END AS BIGINT) AS slot FROM rows),
observed AS (SELECT slot, CAST(slot_pass AS BIGINT) AS slot_pass, phase, id AS candidate_id, max(sev_rank) AS sev_rank FROM slotted GROUP BY ALL),
marked AS (
  SELECT *, count(*) OVER w = 0 AS is_new, coalesce(max(sev_rank) OVER w, 0) < 3 AND sev_rank >= 3 AS is_new_serious
  FROM observed WINDOW w AS (PARTITION BY candidate_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
modes AS (SELECT pass, unit_id, count(DISTINCT lens) AS lenses,
                 CASE count(DISTINCT lens) WHEN 1 THEN 'confirm' WHEN 2 THEN 'partial' WHEN 3 THEN 'partial' ELSE 'full' END AS mode
          FROM rows WHERE phase <> 'sweep' AND (l_partkey % 5 <> 2 OR lens <= concat('L', pass)) GROUP BY ALL)"""


def _modes(spark, sf):
    """Lens lanes of one unit are thinned so that all three modes occur."""
    rows = _rows(spark, sf).filter("l_partkey % 5 <> 2 OR lens <= concat('L', pass)")
    return hist.unit_modes(rows)


@query("observed_ids", "A9", f"WITH {SLOTS} SELECT slot, slot_pass, phase, candidate_id, sev_rank FROM observed")
def observed_ids(spark, sf):
    return hist.observed_ids(_rows(spark, sf))


@query("first_seen", "W1 W2", f"WITH {SLOTS} SELECT slot, candidate_id, sev_rank, is_new, is_new_serious FROM marked")
def first_seen(spark, sf):
    return hist.mark_new(hist.observed_ids(_rows(spark, sf))).select("slot", "candidate_id", "sev_rank", "is_new", "is_new_serious")


@query("unit_modes", "A10", f"WITH {SLOTS} SELECT pass, unit_id, lenses, mode FROM modes")
def unit_modes(spark, sf):
    return _modes(spark, sf)


@query("lap_history", "W6", f"""
WITH {SLOTS}, ids AS (SELECT candidate_id, min(slot) AS slot FROM marked GROUP BY 1 HAVING max(sev_rank) >= 3),
laps AS (SELECT slot, count(*) FILTER (WHERE is_new_serious) AS novel FROM marked GROUP BY 1),
firsts AS (SELECT slot, count(*) AS n FROM ids GROUP BY 1)
SELECT l.slot, l.novel, CAST(sum(coalesce(n, 0)) OVER (ORDER BY l.slot) AS BIGINT) AS seen, CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS total,
       round(CAST(sum(coalesce(n, 0)) OVER (ORDER BY l.slot) AS DOUBLE) / CAST(sum(coalesce(n, 0)) OVER () AS DOUBLE), 6) AS bound
FROM laps l LEFT JOIN firsts f ON f.slot = l.slot""")
def lap_history(spark, sf):
    laps = hist.lap_history(hist.mark_new(hist.observed_ids(_rows(spark, sf))))
    return laps.withColumn("bound", F.round("bound", 6))


@query("restore_lanes", "S13", f"""
WITH {SLOTS}, c AS (SELECT id, any_value(path) AS path, max(sev_rank) AS sev_rank FROM f2_valid GROUP BY id)
SELECT o.slot, CASE WHEN o.phase = 'sweep' THEN 'lane-sweep-restored.jsonl' ELSE concat('lane-pass', o.slot_pass, '-restored.jsonl') END AS lane_file,
       o.candidate_id, c.path, c.sev_rank FROM observed o JOIN c ON c.id = o.candidate_id""")
def restore_lanes(spark, sf):
    observed = hist.observed_ids(_rows(spark, sf))
    nested = observed.groupBy("slot", "slot_pass", "phase", F.substring("candidate_id", 5, 2).alias("part")).agg(
        F.sort_array(F.collect_set("candidate_id")).alias("observed")
    )
    candidates = view(spark, sf, "f2_valid").groupBy(F.col("id").alias("candidate_id")).agg(
        F.min("path").alias("path"), F.max("sev_rank").alias("sev_rank")
    )
    return hist.restore_lanes(nested, candidates).select("slot", "lane_file", "candidate_id", "path", "sev_rank")


COVERAGE = """
caught AS (SELECT DISTINCT f.unit_id, o.slot, o.candidate_id FROM observed o
           JOIN (SELECT id, any_value(path) AS path, max(sev_rank) AS top FROM f2_valid GROUP BY id) c ON c.id = o.candidate_id AND c.top >= 3
           JOIN f3 f ON f.path = c.path),
sizes AS (SELECT unit_id, slot, count(*) AS n, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, slot) AS place FROM caught GROUP BY unit_id, slot),
per_id AS (SELECT c.unit_id, c.candidate_id, max(CASE WHEN s.place = 1 THEN 1 ELSE 0 END) AS a, max(CASE WHEN s.place = 2 THEN 1 ELSE 0 END) AS b
           FROM caught c JOIN sizes s ON s.unit_id = c.unit_id AND s.slot = c.slot GROUP BY ALL),
per_unit AS (SELECT p.unit_id, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, CAST(sum(a * b) AS BIGINT) AS overlap, count(*) AS captured, any_value(z.slots) AS slots
             FROM per_id p JOIN (SELECT unit_id, count(*) AS slots FROM sizes GROUP BY unit_id) z ON z.unit_id = p.unit_id GROUP BY p.unit_id)"""
COVERAGE_ROW = """
SELECT unit_id, n1, n2, overlap, captured,
       round(CASE WHEN slots < 2 THEN 0.0 ELSE least(1.0, captured / ((n1 + 1) * (n2 + 1) / CAST(overlap + 1 AS DOUBLE) - 1)) END, 6) AS coverage_raw FROM per_unit"""


def _placed(spark, sf, keep=lambda df: df):
    """Observed ids, candidates and the files of units; ``keep`` may store them where several measures start from them."""
    rows = _rows(spark, sf)
    observed = hist.observed_ids(rows)
    candidates = rows.groupBy(F.col("id").alias("candidate_id"), "path").agg(F.max("sev_rank").alias("sev_rank"))
    return keep(observed), keep(candidates), keep(view(spark, sf, "f3"))


def _stored(df):
    return cut(df, "zstd")


@query("unit_coverage", "A11", f"WITH {SLOTS}, {COVERAGE} {COVERAGE_ROW}")
def unit_coverage(spark, sf):
    observed, candidates, files = _placed(spark, sf)
    cover = cv.chapman_coverage(cv.serious_captures(observed, candidates, files), files)
    return cover.select("unit_id", "n1", "n2", "overlap", "captured", F.round("coverage_raw", 6).alias("coverage_raw"))


@query("seal_coverage", "A12", f"""
WITH {SLOTS}, graded AS (SELECT id, any_value(path) AS path, max(CASE WHEN final_severity IN ('HIGH', 'CRITICAL', 'PRIORITIZED_CRITICAL') THEN 3 ELSE 1 END) AS top FROM findings GROUP BY id),
caught AS (SELECT DISTINCT f.unit_id, o.slot, o.candidate_id FROM observed o JOIN graded c ON c.id = o.candidate_id AND c.top >= 3 JOIN f3 f ON f.path = c.path),
{COVERAGE.split('sizes AS', 1)[0].split('caught AS', 1)[0]} sizes AS {COVERAGE.split('sizes AS', 1)[1]}, rowed AS ({COVERAGE_ROW})
SELECT unit_id, captured, coverage_raw, min(coverage_raw) OVER () AS bound_min FROM rowed""")
def seal_coverage(spark, sf):
    from pyspark.sql import Window

    observed, files = _stored(hist.observed_ids(_rows(spark, sf))), _stored(view(spark, sf, "f3"))
    findings = _stored(
        view(spark, sf, "findings")
        .withColumn("r", F.expr("CASE WHEN final_severity IN ('HIGH', 'CRITICAL', 'PRIORITIZED_CRITICAL') THEN 3 ELSE 1 END"))
        .groupBy(F.col("id").alias("candidate_id"), "path").agg(F.max("r").alias("sev_rank"))
    )
    cover = cv.chapman_coverage(cv.seal_captures(observed, findings, files), files)
    cover = cover.select("unit_id", "captured", F.round("coverage_raw", 6).alias("coverage_raw"))
    return cover.withColumn("bound_min", F.min("coverage_raw").over(Window.partitionBy()))


STATES = """
unit_loc AS (SELECT unit_id, count(*) * 1700 AS loc FROM f3 GROUP BY unit_id),
bars AS (SELECT unit_id, loc, greatest(2, CAST(round_even(loc / 25000.0, 0) AS BIGINT)) * 300 AS bar FROM unit_loc),
new_per AS (SELECT f.unit_id, m.slot, count(*) AS n FROM marked m JOIN (SELECT id, any_value(path) AS path FROM f2_valid GROUP BY id) c ON c.id = m.candidate_id
            JOIN f3 f ON f.path = c.path WHERE m.is_new_serious GROUP BY ALL),
grid AS (SELECT u.unit_id, s.slot, s.slot_pass, s.phase, coalesce(n.n, 0) AS n, coalesce(mo.mode, 'full') AS mode
         FROM unit_loc u CROSS JOIN (SELECT DISTINCT slot, slot_pass, phase FROM marked) s
         LEFT JOIN new_per n ON n.unit_id = u.unit_id AND n.slot = s.slot LEFT JOIN modes mo ON mo.unit_id = u.unit_id AND mo.pass = s.slot_pass),
opened AS (SELECT *, CASE WHEN phase <> 'sweep' AND mode <> 'partial' THEN 1 ELSE 0 END AS opens FROM grid),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY unit_id ORDER BY slot) AS cycle FROM opened),
cycles AS (SELECT unit_id, cycle, max(CASE WHEN opens = 1 THEN mode END) AS mode, CAST(sum(n) AS BIGINT) AS n FROM numbered
           WHERE cycle > 0 AND (opens = 1 OR phase = 'sweep') GROUP BY unit_id, cycle),
steps AS (
  SELECT unit_id, 0 AS at, 'loud' AS state FROM unit_loc
  UNION ALL
  SELECT s.unit_id, s.at + 1, CASE WHEN c.mode = 'confirm' THEN CASE WHEN s.state = 'confirm' AND c.n = 0 THEN 'quiet' ELSE 'loud' END
         WHEN c.n > b.loc_bar THEN 'loud' WHEN s.state IN ('quiet', 'confirm') THEN 'quiet' ELSE 'confirm' END
  FROM steps s JOIN cycles c ON c.unit_id = s.unit_id AND c.cycle = s.at + 1
  JOIN (SELECT unit_id, greatest(2, CAST(round_even(loc / 25000.0, 0) AS BIGINT)) AS loc_bar FROM unit_loc) b ON b.unit_id = s.unit_id)"""


def _states(spark, sf, placed=None):
    observed, candidates, files = placed or _placed(spark, sf)
    marked = hist.mark_new(observed)
    units = files.groupBy("unit_id").agg((F.count("*") * 1700).alias("loc"))
    return cv.converge(cv.unit_cycles(marked, _modes(spark, sf), files, candidates), units)


@query("convergence", "W4 A10", f"""
WITH RECURSIVE {SLOTS}, {STATES}
SELECT s.unit_id, u.loc, (SELECT count(*) FROM cycles c WHERE c.unit_id = s.unit_id) AS n_cycles, s.state
FROM steps s JOIN unit_loc u ON u.unit_id = s.unit_id WHERE s.at = (SELECT count(*) FROM cycles c WHERE c.unit_id = s.unit_id)""")
def convergence(spark, sf):
    return _states(spark, sf).select("unit_id", "loc", F.col("n_cycles").cast("bigint").alias("n_cycles"), "state")


@query("unit_cycles", "W4", f"WITH RECURSIVE {SLOTS}, {STATES} SELECT unit_id, CAST(cycle AS BIGINT) AS cycle, mode, n FROM cycles")
def unit_cycles(spark, sf):
    observed, candidates, files = _placed(spark, sf)
    return cv.unit_cycles(hist.mark_new(observed), _modes(spark, sf), files, candidates)


@query("below_bar_units", "U5", f"""
WITH RECURSIVE {SLOTS}, {COVERAGE}, {STATES}, final AS (
  SELECT s.unit_id, s.state FROM steps s WHERE s.at = (SELECT count(*) FROM cycles c WHERE c.unit_id = s.unit_id)), cov AS ({COVERAGE_ROW})
SELECT c.unit_id, c.coverage_raw, f.state FROM cov c JOIN final f ON f.unit_id = c.unit_id WHERE c.coverage_raw < 0.95 OR f.state <> 'quiet'""")
def below_bar_units(spark, sf):
    observed, candidates, files = _placed(spark, sf, _stored)
    cover = cv.chapman_coverage(cv.serious_captures(observed, candidates, files), files)
    low = cv.below_bar(cover, _states(spark, sf, (observed, candidates, files)))
    return low.select("unit_id", F.round("coverage_raw", 6).alias("coverage_raw"), "state")


@query("quiet_pair", "W5", f"""
WITH {SLOTS}, n AS (SELECT slot, f.unit_id, count(*) AS n FROM marked m JOIN (SELECT id, any_value(path) AS path FROM f2_valid GROUP BY id) c ON c.id = m.candidate_id
  JOIN f3 f ON f.path = c.path WHERE is_new GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY slot DESC) AS r FROM n)
SELECT unit_id, count(*) = 2 AND max(n) <= 400 AS quiet, max(n) AS worst FROM r WHERE r <= 2 GROUP BY unit_id""")
def quiet_pair(spark, sf):
    observed, candidates, files = _placed(spark, sf)
    marked = hist.mark_new(observed).filter("is_new").join(candidates.select("candidate_id", "path"), "candidate_id").join(files, "path")
    return cv.quiet_pair(marked.groupBy("unit_id", "slot").agg(F.count("*").alias("n")), ["unit_id"], "slot", "n", F.lit(400))


@query("stagnation", "W7", """
WITH laps AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS lap, CAST(output_tokens % 5 AS BIGINT) AS novel,
                     round(1 - 1.0 / (1 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) * (1 + user_id % 3)), 4) AS bound FROM f10),
g AS (SELECT *, bound - lag(bound) OVER w AS gain, lag(bound) OVER w - lag(bound, 2) OVER w AS prev_gain, lag(novel) OVER w AS prev_novel, lap AS n FROM laps
      WINDOW w AS (PARTITION BY user_id ORDER BY lap)),
s AS (SELECT *, coalesce(CAST(novel = 0 AND gain < 0.02 AS INT), 0) AS stagnant FROM g)
SELECT user_id, lap, coalesce(stagnant + lag(stagnant) OVER (PARTITION BY user_id ORDER BY lap) = 2, false) AS stagnant_twice,
       coalesce(n >= 3 AND gain < 0.02 AND prev_gain < 0.02 AND greatest(novel, prev_novel) <= 2 AND bound < 0.95, false) AS yield_collapse FROM s""")
def stagnation(spark, sf):
    laps = view(spark, sf, "f10").selectExpr(
        "user_id", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS lap", "CAST(output_tokens % 5 AS BIGINT) AS novel",
    ).withColumn("bound", F.expr("round(1 - 1.0D / (1 + lap * (1 + user_id % 3)), 4)"))
    return cv.stagnation(laps, ["user_id"]).select("user_id", F.col("lap").cast("bigint").alias("lap"), "stagnant_twice", "yield_collapse")


@query("lens_rotation", "W10", """
WITH used AS (SELECT path, lens FROM f2_valid WHERE pass = 1 GROUP BY ALL), paths AS (SELECT DISTINCT path FROM f2_valid)
SELECT p.path AS unit_id, coalesce((SELECT min(x.lens) FROM (VALUES ('L1-auth'), ('L2-secrets'), ('L3-injection'), ('L4-infra')) x(lens)
  WHERE x.lens NOT IN (SELECT u.lens FROM used u WHERE u.path = p.path)), 'L2-secrets') AS lens FROM paths p""")
def lens_rotation(spark, sf):
    rows = view(spark, sf, "f2_valid").withColumn("unit_id", F.col("path"))
    return cv.next_lens(rows, rows.filter("pass = 1").select("unit_id", "lens"), 5)


@query("typical_yield", "A20", f"""
WITH {SLOTS}, n AS (SELECT slot, slot_pass, count(*) FILTER (WHERE is_new_serious) AS n FROM marked WHERE phase <> 'sweep' GROUP BY ALL),
k AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM n WHERE slot_pass IN (SELECT pass FROM modes WHERE mode = 'full'))
SELECT greatest(1, n) AS typical_yield FROM k WHERE r = c // 2 + 1""")
def typical_yield(spark, sf):
    return cv.typical_yield(hist.mark_new(hist.observed_ids(_rows(spark, sf))), _modes(spark, sf))


HISTORY_FOLDED = FOLD_SQL + """,
seen AS (SELECT v.pass AS slot, m.candidate_id, max(v.sev_rank) AS sev_rank FROM f2_valid v JOIN mapped m ON m.id = v.id GROUP BY ALL),
new_ids AS (SELECT *, count(*) OVER w = 0 AS is_new, coalesce(max(sev_rank) OVER w, 0) < 3 AND sev_rank >= 3 AS is_new_serious
  FROM seen WINDOW w AS (PARTITION BY candidate_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query("consolidated_history", "K1 A9 W1 W2", HISTORY_FOLDED + "SELECT slot, candidate_id, sev_rank, is_new, is_new_serious FROM new_ids")
def consolidated_history(spark, sf):
    return consolidate(sequenced(spark, sf), write=False).history.select("slot", "candidate_id", "sev_rank", "is_new", "is_new_serious")


@query("review_state", "K1 A11 W4", HISTORY_FOLDED + f""",
observed AS (SELECT slot, candidate_id FROM new_ids),
caught AS (SELECT DISTINCT f.unit_id, o.slot, o.candidate_id FROM observed o JOIN folded c ON c.candidate_id = o.candidate_id AND c.sev_rank >= 3 JOIN f3 f ON f.path = c.path),
sizes AS {COVERAGE.split('sizes AS', 1)[1]}, cov AS ({COVERAGE_ROW}),
counts AS (SELECT f.unit_id, n.slot, count(*) AS n FROM new_ids n JOIN folded c ON c.candidate_id = n.candidate_id JOIN f3 f ON f.path = c.path WHERE n.is_new_serious GROUP BY ALL),
steps AS (
  SELECT DISTINCT unit_id, CAST(0 AS BIGINT) AS at, 'loud' AS state FROM f3
  UNION ALL
  SELECT s.unit_id, s.at + 1, CASE WHEN coalesce(c.n, 0) > 2 THEN 'loud' WHEN s.state IN ('quiet', 'confirm') THEN 'quiet' ELSE 'confirm' END
  FROM steps s LEFT JOIN counts c ON c.unit_id = s.unit_id AND c.slot = s.at + 1 WHERE s.at < 3)
SELECT s.unit_id, (SELECT count(*) FROM folded c JOIN f3 f ON f.path = c.path WHERE f.unit_id = s.unit_id) AS candidates, cov.captured AS serious, cov.coverage_raw, s.state
FROM steps s JOIN cov ON cov.unit_id = s.unit_id WHERE s.at = 3""")
def review_state(spark, sf):
    ledger = consolidate(sequenced(spark, sf))
    files = _stored(view(spark, sf, "f3"))
    units = files.groupBy("unit_id").agg(F.count("*").alias("loc"))
    out = state_of(ledger, files, units)
    return out.select("unit_id", "candidates", "serious", F.round("coverage_raw", 6).alias("coverage_raw"), "state")
