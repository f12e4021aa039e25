"""Lane reading, validation, quarantine, scope, identity, fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passledger import functions as fn
from passledger.catalog import query
from passledger.operators import observations as obs
from passledger.operators.fold import fold_observations
from passledger.session import fresh_dir
from passledger.sources import readers, sinks
from passledger.views import fence, view

ORDER = "pass, lens, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def sequenced(spark: SparkSession, sf: str) -> DataFrame:
    """Valid observations with ``seq``: pass, lens, then all row columns, packed into one integer."""
    digits = [
        F.col("pass").cast("string"),
        F.substring("lens", 2, 1),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
        F.col("l_linenumber").cast("string"),
        F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
        F.lpad(F.col("l_suppkey").cast("string"), 8, "0"),
        F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"),
    ]
    return view(spark, sf, "f2_valid").withColumn("seq", F.concat(*digits).cast("decimal(38,0)")).withColumn(
        "phase", F.lit("pass")
    )


FOLD_SQL = f"""
WITH RECURSIVE ordered AS (
  SELECT *, lower(category) AS cat, row_number() OVER (PARTITION BY path ORDER BY {ORDER}) AS k FROM f2_valid
), walk AS (
  SELECT path, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(line BIGINT, lens VARCHAR, cat VARCHAR, id VARCHAR)[]) AS entries,
         CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS candidate_id
  FROM (SELECT DISTINCT path FROM ordered)
  UNION ALL
  SELECT path, k, CASE WHEN hit IS NULL THEN list_append(entries, {{line: line, lens: lens, cat: cat, id: id}}) ELSE entries END,
         id, coalesce(hit, id)
  FROM (
    SELECT w.path, o.k, w.entries, o.line, o.lens, o.cat, o.id,
           coalesce(list_filter(w.entries, lambda e: e.line = o.line AND e.lens = o.lens)[1].id,
                    list_filter(w.entries, lambda e: e.id = o.id)[1].id,
                    list_filter(w.entries, lambda e: e.lens = o.lens AND abs(e.line - o.line) <= 10)[1].id) AS hit
    FROM walk w JOIN ordered o ON o.path = w.path AND o.k = w.k + 1)
), placed AS (SELECT w.candidate_id, o.* FROM walk w JOIN ordered o ON o.path = w.path AND o.k = w.k),
mapped AS (SELECT id, arg_max(candidate_id, k) AS candidate_id FROM placed GROUP BY id),
folded AS (
  SELECT p.candidate_id, any_value(p.path) AS path, any_value(f.line) AS line, any_value(f.lens) AS lens, any_value(f.category) AS category,
         arg_min(p.severity, (5 - p.sev_rank) * CAST(1000000000 AS BIGINT) + p.k) AS severity, CAST(max(p.sev_rank) AS INTEGER) AS sev_rank,
         arg_min(p.title, (5 - p.sev_rank) * CAST(1000000000 AS BIGINT) + p.k) AS title, arg_min(p.evidence, (5 - p.sev_rank) * CAST(1000000000 AS BIGINT) + p.k) AS evidence,
         arg_min(p.reach_basis, (5 - p.sev_rank) * CAST(1000000000 AS BIGINT) + p.k) AS reach_basis
  FROM placed p JOIN (SELECT candidate_id, arg_min(line, k) AS line, arg_min(lens, k) AS lens, arg_min(category, k) AS category
                      FROM placed GROUP BY candidate_id) f ON f.candidate_id = p.candidate_id
  GROUP BY p.candidate_id)
"""


@query("read_lanes", "S3 S4", """
WITH t AS (SELECT lane_file, value, row_number() OVER (PARTITION BY lane_file ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_no FROM lane_text)
SELECT lane_file, line_no, CASE WHEN NOT json_valid(value) THEN 'invalid JSON' WHEN json_type(value) <> 'OBJECT' THEN 'row must be an object' END AS parse_error,
       CASE WHEN json_valid(value) THEN CASE WHEN json_type(value) = 'OBJECT' THEN json_extract_string(value, '$.path') END END AS path,
       CAST(regexp_extract(lane_file, '^lane-pass(\\d+)-', 1) AS BIGINT) AS pass, nullif(regexp_extract(lane_file, '(UNIT-\\d+)\\.jsonl$', 1), '') AS unit_id
FROM t""")
def read_lanes(spark, sf):
    """Lanes written as files and read again."""
    place = fresh_dir(spark, "lanes")
    sinks.write_lanes(view(spark, sf, "lane_text"), place, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], compression="gzip")
    return readers.read_lanes(spark, place, folders=True).select("lane_file", "line_no", "parse_error", "path", "pass", "unit_id")


@query("sole_unit", "S4 A12", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 'UNIT-007' ELSE unit_id END AS unit_id FROM f2""")
def sole_unit(spark, sf):
    """Lanes without a unit belong to the only unit there is."""
    rows = view(spark, sf, "f2").withColumn("unit_id", F.expr("CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE unit_id END"))
    files = view(spark, sf, "f3").select(F.lit("UNIT-007").alias("unit_id"), "path")
    return obs.fill_sole_unit(rows, files).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "unit_id")


@query("lane_metadata", "S4", r"""
SELECT lane_file, count(*) AS n, CAST(regexp_extract(lane_file, '^lane-pass(\d+)-', 1) AS BIGINT) AS pass,
       regexp_extract(lane_file, '^lane-pass\d+-(L[1-4]-[a-z]+)', 1) AS lens,
       nullif(regexp_extract(lane_file, '(UNIT-\d+)\.jsonl$', 1), '') AS unit_id, 'pass' AS phase
FROM lane_text GROUP BY lane_file""")
def lane_metadata(spark, sf):
    files = view(spark, sf, "lane_text").groupBy("lane_file").agg(F.count("*").alias("n"))
    return files.select("lane_file", "n", obs.lane_metadata(F.col("lane_file")).alias("m")).select("lane_file", "n", "m.*")


@query("validate_observations", "P3", r"""
WITH parsed AS (
  SELECT *, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS doc FROM lane_text WHERE json_valid(value) AND value LIKE '{%'
), typed AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, json_extract_string(doc, '$.path') AS path,
         CASE WHEN json_type(doc, '$.line') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(doc, '$.line') AS BIGINT) END AS line,
         json_extract_string(doc, '$.category') AS category, upper(json_extract_string(doc, '$.severity')) AS severity,
         concat_ws(', ', CASE WHEN json_extract_string(doc, '$.path') IS NULL THEN 'path' END, CASE WHEN json_extract_string(doc, '$.line') IS NULL THEN 'line' END,
           CASE WHEN json_extract_string(doc, '$.lens') IS NULL THEN 'lens' END, CASE WHEN json_extract_string(doc, '$.category') IS NULL THEN 'category' END,
           CASE WHEN json_extract_string(doc, '$.severity') IS NULL THEN 'severity' END, CASE WHEN json_extract_string(doc, '$.title') IS NULL THEN 'title' END,
           CASE WHEN json_extract_string(doc, '$.evidence') IS NULL THEN 'evidence' END, CASE WHEN json_extract_string(doc, '$.reach_basis') IS NULL THEN 'reach_basis' END) AS missing
  FROM parsed)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, path, line, severity,
       CASE WHEN missing <> '' THEN concat('candidate missing fields: ', missing)
            WHEN path LIKE '/%' OR list_contains(string_split(path, '/'), '..') THEN 'candidate path must be relative'
            WHEN line IS NULL OR line < 1 THEN 'candidate line must be a positive integer'
            WHEN severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'PRIORITIZED_CRITICAL') THEN concat('invalid severity: ', severity) END AS reason
FROM typed""")
def validate_observations(spark, sf):
    parsed = obs.parse_observations(fence(view(spark, sf, "lane_text"))).filter("parse_error IS NULL")
    return obs.validate_observations(parsed).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "path", "line", "severity", "reason"
    )


@query("quarantine", "P4", """
SELECT concat('invalid severity: ', upper(severity)) AS reason, path, CAST(line AS BIGINT) AS line, upper(severity) AS severity, category, count(*) AS n
FROM f2 WHERE upper(severity) NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'PRIORITIZED_CRITICAL') GROUP BY ALL""")
def quarantine(spark, sf):
    rows = view(spark, sf, "f2").withColumns(
        {"title": F.lit("t"), "evidence": F.lit("e"), "reach_basis": F.lit("r"), "line": F.col("line").cast("bigint")}
    )
    bad = obs.route(obs.validate_observations(rows)).quarantined
    return bad.groupBy("reason", "path", "line", "severity", "category").agg(F.count("*").alias("n"))


@query("scope_filter", "P5", """
SELECT concat(pass, '-', lens, '-UNIT-00', 1 + l_suppkey % 5) AS lane, count(*) AS rejected
FROM f2_valid v WHERE NOT EXISTS (SELECT 1 FROM f3 f WHERE f.path = v.path AND f.unit_id = concat('UNIT-00', 1 + v.l_suppkey % 5))
GROUP BY 1""")
def scope_filter(spark, sf):
    rows = view(spark, sf, "f2_valid").withColumn("unit_id", F.expr("concat('UNIT-00', 1 + l_suppkey % 5)")).withColumn(
        "lane", F.concat_ws("-", F.col("pass").cast("string"), "lens", "unit_id")
    )
    return obs.scope_filter(rows, view(spark, sf, "f3"))[1]


@query("scope_kept", "P5", """
SELECT v.path, v.line, v.lens, v.id, v.l_orderkey, v.l_linenumber FROM f2_valid v
JOIN f3 f ON f.path = v.path AND f.unit_id = concat('UNIT-00', 1 + v.l_suppkey % 5)""")
def scope_kept(spark, sf):
    rows = view(spark, sf, "f2_valid").withColumn("unit_id", F.expr("concat('UNIT-00', 1 + l_suppkey % 5)")).withColumn("lane", F.lit("x"))
    return obs.scope_filter(rows, view(spark, sf, "f3"))[0].select("path", "line", "lens", "id", "l_orderkey", "l_linenumber")


@query("serious_observations", "P6", "SELECT id, severity, count(*) AS n FROM f2_valid WHERE sev_rank >= 3 GROUP BY ALL")
def serious_observations(spark, sf):
    return view(spark, sf, "f2_valid").filter(fn.is_serious("severity")).groupBy("id", "severity").agg(F.count("*").alias("n"))


@query("jsonl_filter", "P13", """
SELECT lane_file, count(*) FILTER (WHERE value LIKE '{%}') AS kept, count(*) FILTER (WHERE value LIKE '{%}') AS kept_twice
FROM lane_text GROUP BY lane_file""")
def jsonl_filter(spark, sf):
    text = F.concat(F.lit("note\n```\n"), F.col("value"), F.lit("  \n`"), F.col("value"), F.lit("`\n"))
    kept = view(spark, sf, "lane_text").withColumn("n", F.size(obs.jsonl_lines(text)))
    return kept.groupBy("lane_file").agg(
        F.sum((F.col("n") > 0).cast("bigint")).alias("kept"), F.sum(F.floor(F.col("n") / 2)).cast("bigint").alias("kept_twice")
    )


@query("path_safety", "P14", r"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN concat('../', path) WHEN doc_id % 6 = 1 THEN concat('/', path) WHEN doc_id % 6 = 2 THEN replace(path, '/', '//')
                  WHEN doc_id % 6 = 3 THEN concat('./', path) ELSE path END AS path FROM f1)
SELECT doc_id, NOT (path LIKE '/%') AND NOT list_contains(string_split(path, '/'), '..') AS safe_relative,
       path <> '' AND NOT list_contains(string_split(path, '/'), '') AND NOT list_contains(string_split(path, '/'), '.') AND NOT list_contains(string_split(path, '/'), '..') AS normalised,
       regexp_full_match(path, '[A-Za-z0-9._-]{1,80}') AS safe_id
FROM p""")
def path_safety(spark, sf):
    p = view(spark, sf, "f1").withColumn("path", F.expr(
        "CASE WHEN doc_id % 6 = 0 THEN concat('../', path) WHEN doc_id % 6 = 1 THEN concat('/', path) WHEN doc_id % 6 = 2 THEN replace(path, '/', '//') "
        "WHEN doc_id % 6 = 3 THEN concat('./', path) ELSE path END"))
    return p.select("doc_id", fn.is_safe_relative("path").alias("safe_relative"),
                    fn.is_normalised_relative("path").alias("normalised"), fn.is_safe_id("path").alias("safe_id"))


@query("expand_sites", "P15", """
WITH g AS (SELECT l_orderkey, l_linenumber, min(concat(path, ':', line)) AS locus, list_distinct(list(concat(path, ':', line))) AS others FROM f2_valid GROUP BY ALL)
SELECT DISTINCT l_orderkey, l_linenumber, unnest(others) AS site FROM g""")
def expand_sites(spark, sf):
    rows = view(spark, sf, "f2_valid").withColumn("locus", F.concat("path", F.lit(":"), F.col("line").cast("string")))
    grouped = rows.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("locus").alias("locus"), F.collect_set("locus").alias("also_affects")
    )
    return obs.expand_sites(grouped).select("l_orderkey", "l_linenumber", "site")


@query("stable_id", "X4", "SELECT id, path, line, lower(category) AS category, count(*) AS n FROM f2_valid GROUP BY ALL")
def stable_id(spark, sf):
    rows = view(spark, sf, "f2_valid").withColumn("category", F.lower("category"))
    kinds = rows.groupBy("path", "line", "category").agg(F.count("*").alias("n"))
    return kinds.select(fn.stable_id("path", "line", "category").alias("id"), "path", "line", "category", "n")


@query("unit_of_candidate", "J1", """
SELECT f.unit_id, v.id, max(v.sev_rank) AS sev_rank FROM f2_valid v JOIN f3 f ON f.path = v.path GROUP BY ALL""")
def unit_of_candidate(spark, sf):
    ids = view(spark, sf, "f2_valid").groupBy("path", "id").agg(F.max("sev_rank").alias("sev_rank"))
    return ids.join(view(spark, sf, "f3"), "path").select("unit_id", "id", "sev_rank")


@query("fold_candidates", "J6", FOLD_SQL + "SELECT * FROM folded")
def fold_candidates(spark, sf):
    return fold_observations(sequenced(spark, sf)).candidates


@query("fold_map", "J6", FOLD_SQL + "SELECT * FROM mapped")
def fold_map(spark, sf):
    return fold_observations(sequenced(spark, sf)).fold_map
