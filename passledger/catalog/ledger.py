"""Event ledgers, usage, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from passledger.catalog import query
from passledger.operators import ledger as le
from passledger.views import view

WALK = """
steps AS (SELECT lane, event_id, ts, CASE WHEN event = 'lane-dead' THEN 1 ELSE -1 END AS d FROM {src} WHERE event IN ('lane-dead', 'lane-relaunched', 'lane-adopted-empty') AND trim(lane) <> ''),
run AS (SELECT *, sum(d) OVER (PARTITION BY lane ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM steps),
lanes AS (SELECT lane, count(*) FILTER (WHERE d = 1) AS deaths, count(*) FILTER (WHERE d = -1) AS closures, CAST(sum(d) - least(0, min(s)) AS BIGINT) AS outstanding, CAST(-least(0, min(s)) AS BIGINT) AS over_closures FROM run GROUP BY lane)"""


@query("ledger_reduction", "W3", f"WITH {WALK.replace('{src}', 'f6')} SELECT * FROM lanes")
def ledger_reduction(spark, sf):
    return le.reduce_ledger(view(spark, sf, "f6"), ["ts", "event_id"])


@query("ledger_totals", "W3", f"""
WITH {WALK.replace('{src}', 'f6')} SELECT CAST((SELECT sum(outstanding) FROM lanes) + i.n AS BIGINT) AS unreconciled, CAST((SELECT sum(over_closures) FROM lanes) AS BIGINT) AS over_closures, i.n AS invalid_rows
FROM (SELECT count(*) AS n FROM f6 WHERE trim(lane) = '' AND event IN ('lane-dead', 'lane-relaunched', 'lane-adopted-empty')) i""")
def ledger_totals(spark, sf):
    events = view(spark, sf, "f6")
    return le.ledger_totals(events, le.reduce_ledger(events, ["ts", "event_id"]))


@query("stalled_lanes", "W8", """
SELECT lane, event_id, coalesce(size <= lag(size) OVER w AND lag(size) OVER w <= lag(size, 2) OVER w, false) AS dead FROM f6 WINDOW w AS (PARTITION BY lane ORDER BY event_id)""")
def stalled_lanes(spark, sf):
    return le.stalls(view(spark, sf, "f6"), "lane", ["event_id"], "size").select("lane", "event_id", "dead")


@query("observation_deltas", "W9", "SELECT lane, event_id, size - lag(size) OVER (PARTITION BY lane ORDER BY event_id) AS delta FROM f6")
def observation_deltas(spark, sf):
    return le.deltas(view(spark, sf, "f6"), "lane", ["event_id"], "size").select("lane", "event_id", "delta")


LABELLED = """
labelled AS (SELECT event_id, ts, event, CASE WHEN event_id % 40 = 0 THEN 'lane-x' ELSE concat('pass', 1 + user_id % 3, '-', CASE user_id % 4 WHEN 0 THEN 'L1-auth' WHEN 1 THEN 'L2-secrets' WHEN 2 THEN 'L3-injection' ELSE 'L4-infra' END, '-UNIT-', lpad(CAST(user_id % 150 AS STRING), 3, '0')) END AS lane
  FROM (SELECT f6.*, e.user_id FROM f6 JOIN events e ON e.event_id = f6.event_id))"""


def _labelled(spark, sf):
    e = view(spark, sf, "f6").join(view(spark, sf, "events").select("event_id", "user_id"), "event_id")
    return e.select("event_id", "ts", "event", F.expr("CASE WHEN event_id % 40 = 0 THEN 'lane-x' ELSE concat('pass', 1 + user_id % 3, '-', CASE user_id % 4 WHEN 0 THEN 'L1-auth' WHEN 1 THEN 'L2-secrets' WHEN 2 THEN 'L3-injection' ELSE 'L4-infra' END, '-UNIT-', lpad(CAST(user_id % 150 AS STRING), 3, '0')) END").alias("lane"))


EVIDENCE = """
evidence AS (SELECT 0 AS source, 1 + l_suppkey % 3 AS pass, CASE l_linenumber % 4 WHEN 0 THEN 'L1-auth' WHEN 1 THEN 'L2-secrets' WHEN 2 THEN 'L3-injection' ELSE 'L4-infra' END AS lens, concat('UNIT-', lpad(CAST(l_partkey % 150 AS STRING), 3, '0')) AS unit_id,
    concat('lane of pass ', 1 + l_suppkey % 3) AS basis FROM lineitem
  UNION ALL SELECT 1, o_custkey % 3, NULL, concat('UNIT-', lpad(CAST(o_custkey % 150 AS STRING), 3, '0')), concat('lap pass ', o_custkey % 3) FROM orders)"""


def _evidence(spark, sf):
    lanes = view(spark, sf, "lineitem").selectExpr(
        "1 + l_suppkey % 3 AS pass", "CASE l_linenumber % 4 WHEN 0 THEN 'L1-auth' WHEN 1 THEN 'L2-secrets' WHEN 2 THEN 'L3-injection' ELSE 'L4-infra' END AS lens",
        "concat('UNIT-', lpad(CAST(l_partkey % 150 AS STRING), 3, '0')) AS unit_id", "concat('lane of pass ', 1 + l_suppkey % 3) AS basis")
    laps = view(spark, sf, "orders").selectExpr(
        "o_custkey % 3 AS pass", "CAST(NULL AS STRING) AS lens", "concat('UNIT-', lpad(CAST(o_custkey % 150 AS STRING), 3, '0')) AS unit_id", "concat('lap pass ', o_custkey % 3) AS basis")
    return le.evidence_union([(0, lanes), (1, laps)])


@query("evidence_union", "U6", f"WITH {EVIDENCE} SELECT source, CAST(pass AS BIGINT) AS pass, lens, unit_id, basis, count(*) AS n FROM evidence GROUP BY ALL")
def evidence_union(spark, sf):
    return _evidence(spark, sf).groupBy("source", "pass", "lens", "unit_id", "basis").agg(F.count("*").alias("n"))


@query("orphan_reconciliation", "J17", f"""
WITH {LABELLED}, {EVIDENCE}, {WALK.replace('{src}', 'labelled')},
o AS (SELECT lane, outstanding, CAST(substring(lane, 5, 1) AS BIGINT) AS p, regexp_extract(lane, '(L[0-9]-[a-z]+)', 1) AS l, regexp_extract(lane, '(UNIT-[0-9]+)', 1) AS u FROM lanes WHERE outstanding > 0 AND lane <> 'lane-x'),
b AS (SELECT o.lane, o.outstanding, e.basis, row_number() OVER (PARTITION BY o.lane ORDER BY e.source, e.pass DESC) AS r FROM o JOIN evidence e ON e.unit_id = o.u AND e.pass >= o.p AND (e.lens IS NULL OR e.lens = o.l))
SELECT lane, concat('reconciled: superseded by ', basis) AS basis, outstanding AS n FROM b WHERE r = 1""")
def orphan_reconciliation(spark, sf):
    lanes = le.reduce_ledger(_labelled(spark, sf), ["ts", "event_id"])
    closures = le.reconcile_orphans(lanes, _evidence(spark, sf))
    return closures.groupBy("lane", "basis").agg(F.count("*").alias("n"))


@query("usage_summary", "A16", """
SELECT user_id % 20 AS run, count(*) AS calls, count(*) FILTER (WHERE status = 'ok') AS successful, count(*) FILTER (WHERE status <> 'ok') AS failed, CAST(coalesce(sum(output_tokens) FILTER (WHERE status = 'ok'), 0) AS BIGINT) AS output_tokens,
  count(DISTINCT model) AS models, CAST(floor(epoch(max(started_at))) AS BIGINT) - CAST(floor(epoch(min(started_at))) AS BIGINT) AS wall_seconds FROM f10 GROUP BY 1""")
def usage_summary(spark, sf):
    u = view(spark, sf, "f10").withColumn("run", F.col("user_id") % 20)
    return le.usage_summary(u, ["run"], ["output_tokens"], end="started_at")


@query("run_pace", "A23", """
WITH w AS (SELECT user_id % 20 AS run, round_even(avg(output_tokens % 21), 1) AS avg_width FROM f10 GROUP BY 1),
r AS (SELECT user_id % 20 AS run, min(started_at) AS a, max(started_at) AS b, min(started_at) FILTER (WHERE output_tokens > 20) AS v FROM f10 GROUP BY 1),
m AS (SELECT run, greatest(1, (CAST(floor(epoch(b)) AS BIGINT) - CAST(floor(epoch(a)) AS BIGINT)) // 60) AS m, greatest(0, (CAST(floor(epoch(v)) AS BIGINT) - CAST(floor(epoch(a)) AS BIGINT)) // 60) AS lag FROM r)
SELECT m.run, w.avg_width, m.lag AS lag_minutes, concat(m // 60, 'h', lpad(CAST(m % 60 AS VARCHAR), 2, '0'), 'm') AS duration FROM m JOIN w ON w.run = m.run""")
def run_pace(spark, sf):
    u = view(spark, sf, "f10").withColumn("run", F.col("user_id") % 20)
    runs = u.groupBy("run").agg(
        F.min("started_at").alias("started_at"), F.max("started_at").alias("ended_at"), F.min("started_at").alias("first_lane"),
        F.min(F.when(F.col("output_tokens") > 20, F.col("started_at"))).alias("verdicts"))
    return le.run_pace(u.select("run", (F.col("output_tokens") % 21).alias("width")), runs, "run").select("run", "avg_width", "lag_minutes", "duration")


@query("invocation_summary", "A28", """
SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS final_text, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS tokens, count(*) AS events,
  count(*) FILTER (WHERE role = 'assistant') = 0 AS is_error, CASE WHEN ascii(arg_min(text, turn)) < 77 THEN 'reader' ELSE 'agent' END AS kind FROM conversations GROUP BY conv_id""")
def invocation_summary(spark, sf):
    c = view(spark, sf, "conversations")
    stream = c.select("conv_id", "turn", "text", F.when(F.col("role") == "assistant", "item.completed").when(F.col("role") == "user", "turn.completed").otherwise("item.started").alias("type"),
                      F.lit("agent_message").alias("item_type"), F.length("text").alias("tokens"))
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("task"))
    kinds = first.select("conv_id", le.task_kind(F.concat(F.when(F.ascii("task") < 77, "READ ").otherwise("X "), "task"), {"READ": "reader"}).alias("kind"))
    return le.invocation_summary(stream, "conv_id", "turn").join(kinds, "conv_id")


@query("timeline", "A29", """
WITH t AS (SELECT l_suppkey, l_linenumber, l_orderkey, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS at FROM lineitem)
SELECT l_suppkey AS run, min(t.at) FILTER (WHERE l_linenumber < 5 AND l_orderkey % 2 = 0) AS first_lane, max(t.at) FILTER (WHERE l_linenumber < 5 AND l_orderkey % 2 = 0) AS last_lane,
  max(t.at) FILTER (WHERE l_linenumber = 7) AS verdicts FROM t GROUP BY 1""")
def timeline(spark, sf):
    files = view(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS run", "CASE WHEN l_linenumber = 7 THEN 'verdicts.jsonl' WHEN l_linenumber < 5 AND l_orderkey % 2 = 0 THEN concat('lane-pass1-L', l_linenumber, '-x.jsonl') ELSE concat('lane-pass2-L', l_linenumber, '-x.jsonl') END AS name",
        "l_shipdate AS modified")
    out = le.timeline(files, ["run"])
    return out.select("run", *[F.unix_seconds(c).alias(c) for c in ("first_lane", "last_lane", "verdicts")])
