"""Set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from passledger import constants as C
from passledger.catalog import query
from passledger.operators import sets as st
from passledger.views import view


@query("visitation", "U1", """
WITH r AS (SELECT DISTINCT item FROM f8)
SELECT coalesce(s.doc_id, r.item) AS item, CASE WHEN r.item IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'ghost' ELSE 'read' END AS state FROM documents s FULL OUTER JOIN r ON r.item = s.doc_id""")
def visitation(spark, sf):
    return st.visitation(view(spark, sf, "documents").select(F.col("doc_id").alias("item")), view(spark, sf, "f8"))


@query("visitation_totals", "U1", """
WITH r AS (SELECT DISTINCT item FROM f8), j AS (SELECT s.doc_id, r.item FROM documents s FULL OUTER JOIN r ON r.item = s.doc_id)
SELECT count(*) FILTER (WHERE doc_id IS NOT NULL AND item IS NOT NULL) AS visited, count(doc_id) AS in_scope, count(*) FILTER (WHERE item IS NULL) AS missing, count(*) FILTER (WHERE doc_id IS NULL) AS ghost,
  (SELECT count(DISTINCT lane) FROM f8) AS lanes, count(*) FILTER (WHERE item IS NULL OR doc_id IS NULL) = 0 AS clean FROM j""")
def visitation_totals(spark, sf):
    readsets = view(spark, sf, "f8")
    states = st.visitation(view(spark, sf, "documents").select(F.col("doc_id").alias("item")), readsets)
    return st.visitation_totals(states, readsets)


@query("census_coverage", "U2", "SELECT count(l.doc_id) AS opened, count(*) AS census FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def census_coverage(spark, sf):
    return st.census_coverage(view(spark, sf, "documents").select(F.col("doc_id").alias("path")), view(spark, sf, "labels").select(F.col("doc_id").alias("path")))


@query("outside_coverage", "U3", "SELECT slot, path FROM f5 WHERE path NOT IN (SELECT path FROM f2_valid INTERSECT SELECT path FROM f3)")
def outside_coverage(spark, sf):
    return st.outside_coverage(view(spark, sf, "f5"), view(spark, sf, "f2_valid"), view(spark, sf, "f3")).select("slot", "path")


@query("work_backlog", "U4", """
SELECT p.path AS unit_id, l.lens FROM (SELECT DISTINCT path FROM f3) p CROSS JOIN (VALUES ('L1-auth'), ('L2-secrets'), ('L3-injection'), ('L4-infra')) l(lens)
WHERE NOT EXISTS (SELECT 1 FROM f2_valid v WHERE v.path = p.path AND v.lens = l.lens AND v.pass = 2)""")
def work_backlog(spark, sf):
    units = view(spark, sf, "f3").select(F.col("path").alias("unit_id"))
    done = view(spark, sf, "f2_valid").filter("pass = 2").select(F.col("path").alias("unit_id"), "lens")
    return st.backlog(st.plan_items(units, C.LENSES), done, ["unit_id", "lens"])


@query("exact_cover", "U7", """
SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT doc_id FROM f7) a FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def exact_cover(spark, sf):
    a = view(spark, sf, "f7").select(F.col("doc_id").alias("path"))
    b = view(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    return st.symmetric_difference(a, b)
