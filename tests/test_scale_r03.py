"""Findings of round 3: what is computed once, and what no shuffle carries."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from passledger.catalog import reports, scalars, streams
from passledger.functions import split_lines
from passledger.functions.json_objects import extract_verdicts
from passledger.operators import fold as fold_module
from passledger.operators import history as hist
from passledger.operators import ranking as rk
from passledger.views import derive


def counted(spark, df, column):
    """``df`` whose ``column`` passes a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def seen(value):
        calls.add(1)
        return value

    return df.withColumn(column, F.udf(seen, df.schema[column].dataType)(column)), calls


def test_a_stream_computes_its_rows_once(spark):
    df, calls = counted(spark, spark.range(40).selectExpr("id AS seq", "id * 2 AS twice"), "seq")
    out = streams.run(streams.arriving(df, "seq"))
    assert sorted(tuple(r)[:2] for r in out.select("seq", "twice").collect()) == [(i, 2 * i) for i in range(40)]
    assert calls.value == 40


def test_ordinal_computes_its_rows_once(spark):
    df, calls = counted(spark, spark.range(60).selectExpr("id % 3 AS g", "60 - id AS at"), "at")
    got = {(r.g, r.at): r.ordinal for r in rk.ordinal(df, ["g"], ["at"]).collect()}
    want = {}
    for g in range(3):
        for n, at in enumerate(sorted(60 - i for i in range(60) if i % 3 == g), 1):
            want[g, at] = n
    assert got == want and calls.value == 60


def test_slots_are_not_met_by_a_shuffle(spark):
    rows = spark.createDataFrame(
        [("pass", 1, "a", 2), ("pass", 2, "a", 3), ("sweep", 2, "b", 1), ("pass", 2, "b", 4), ("pass", 1, "a", 1)], "phase string, pass bigint, id string, sev_rank int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = hist.mark_new(hist.observed_ids(rows))
        got = sorted((r.slot, r.candidate_id, r.sev_rank, r.is_new, r.is_new_serious) for r in marked.collect())
        plan = marked._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, "a", 2, True, False), (2, "b", 1, True, False), (3, "a", 3, False, True), (3, "b", 4, False, True)]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_mapped_ids_are_distinct_per_slot(spark):
    rows = spark.createDataFrame([("pass", 1, "a", 2), ("pass", 1, "b", 3), ("pass", 2, "b", 1)], "phase string, pass bigint, id string, sev_rank int")
    fold_map = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, candidate_id string")
    got = sorted((r.slot, r.candidate_id, r.sev_rank) for r in hist.observed_ids(rows, fold_map).collect())
    assert got == [(1, "a", 3), (2, "a", 1)]


def test_lines_split_a_text_once(spark):
    texts = ["", "\n", "a", "a\r\nb\r\n", "a\n\n", "\ra\x0bb\x85c ", " x\n\r", "x\x1c\x1d\x1ey"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = [tuple(r) for r in df.select("t", split_lines("t").alias("lines")).collect()]
    assert got == [(t, t.splitlines()) for t in texts] + [(None, None)]
    assert len(re.findall(r"\bsplit\(", str(split_lines("t")))) == 2  # one per kind of line end


def test_kinds_that_stay_keep_no_entries(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(fold_module, "cut", lambda df, *rest: stored.append(df) or df)
    rows = spark.createDataFrame(
        [("p", 10, "L1", "c", "LOW", 1, "i10", "t", "e", "r", 1), ("p", 12, "L1", "d", "HIGH", 3, "i12", "u", "f", "s", 2)],
        "path string, line bigint, lens string, category string, severity string, sev_rank int, id string, title string, evidence string, reach_basis string, seq bigint")
    fold = fold_module.fold_observations(rows)
    assert sorted(map(tuple, fold.fold_map.collect())) == [("i10", "i10"), ("i12", "i10")]
    assert [(r.candidate_id, r.severity, r.title) for r in fold.candidates.collect()] == [("i10", "HIGH", "u")]
    targets = stored[1].collect()
    assert len(targets) == 2 and all(r.by_key is None and r.by_id is None and r.by_near is None for r in targets)


@pytest.mark.parametrize("text", ["title", "finding_id", "evidence"])
def test_findings_are_distinct_before_texts_are_made(spark, text, tmp_path):
    spark.sql(
        "SELECT 1L AS l_orderkey, 2L AS l_partkey, 3L AS l_suppkey, 4 AS l_linenumber, 20D AS l_quantity, 5D AS l_extendedprice, explode(array('X', 'R', 'A', null)) AS l_returnflag"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS o_orderkey, 7L AS o_custkey, 'F' AS o_orderstatus, explode(array('2-HIGH', '2-HIGH', '5-LOW')) AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    df = reports._findings(spark, str(tmp_path))
    key = lambda r: tuple(map(str, r))
    want = derive(spark, str(tmp_path), reports.FINDINGS)
    assert df.columns == want.columns and df.count() == 4
    assert sorted(df.collect(), key=key) == sorted(want.collect(), key=key)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert groups and not [line for line in groups if text in line]


def test_masked_documents_are_dealt_by_size_and_bound_without_nested_elements(spark, tmp_path):
    spark.createDataFrame([(i, f"mail me.{i}@example.org ssn 123-45-6789") for i in range(18)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = scalars.redaction_counts(spark, str(tmp_path))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "REBALANCE_PARTITIONS" in plan and "REPARTITION_BY_NUM" not in plan
    assert "element_at" not in plan
    got = df.agg(*(F.sum(c) for c in ("email", "ssn", "assignment", "aws", "bearer"))).first()
    assert tuple(got) == (20, 20, 4, 2, 2)


def test_responses_are_read_once(spark):
    """Lines, whole texts, scans and keys come from one reading; escaped names are scanned as well."""
    escaped = 'so {"candidate_\\u0069d":"4","clean_verdict":"PRESEN\\u0054","basis":"e"} done'
    texts = ['x\n{"candidate_id":"0","clean_verdict":"PRESENT","basis":"l"}', '{\n"candidate_id":"1", "clean_verdict":"ABSENT"\n}',
             'so {no} {"candidate_id":"2","clean_verdict":"PRESENT","basis":"s"} done', "nothing } at all {", escaped, None]
    rows, calls = counted(spark, spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "candidate_id string, text string"), "candidate_id")
    got = sorted(tuple(r) for r in extract_verdicts(rows).collect())
    none = (None, "no parseable verdict")
    assert got == [("0", "PRESENT", "l"), ("1", "ABSENT", ""), ("2", "PRESENT", "s"), ("3", *none), ("4", "PRESENT", "e"), ("5", *none)]
    assert calls.value == 6
