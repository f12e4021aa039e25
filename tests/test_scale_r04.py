"""Findings of round 4: calls of the state, what is stored once, what stays on disk."""

from __future__ import annotations

import glob
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from passledger import session, views
from passledger.catalog import gates, history, observations, recall, reports
from passledger.operators import fold as fold_module
from passledger.sources import readers, sinks
from passledger.streaming import jobs


class CountingMap:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return bool(self.held)

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_facts_of_a_batch_take_few_calls_of_the_state():
    book, state = jobs.FactBook(), CountingMap()
    book.init(type("Handle", (), {"getMapState": lambda self, *schemas: state})())

    def batch(facts):
        before = state.calls
        table = pd.DataFrame([(i, v, s, int(i[1:]) % 4) for i, v, s in facts], columns=["id", "value", "seq", "piece"])
        (out,) = book.handleInputRows(("r", "candidate", 0), iter([table[::2], table[1::2]]), None)
        return {(r.value, r.delta) for r in out.itertuples()}, state.calls - before

    assert batch([(f"i{n}", "minor", 1) for n in range(300)]) == ({("minor", 300)}, 4)
    changes, calls = batch([(f"i{n}", "serious", 3) for n in range(0, 300, 2)] + [("i1", "minor", 1), ("i3", "loud", 0), ("i900", "minor", 1)])
    assert changes == {("minor", 1 - 150), ("serious", 150)} and calls <= 3 * 4
    assert batch([("i0", "minor", 1), ("i2", "serious", 3)])[0] == set()


OBSERVED = "path string, line bigint, lens string, category string, severity string, sev_rank int, id string, title string, evidence string, reach_basis string, seq bigint"


@pytest.fixture
def tables(spark, tmp_path):
    """lineitem, orders, part and conversations of a few rows."""
    spark.range(240).selectExpr(
        "id div 3 AS l_orderkey", "id % 9 AS l_partkey", "id % 12 AS l_suppkey", "CAST(1 + id % 7 AS INT) AS l_linenumber", "CAST(1 + id % 50 AS DOUBLE) AS l_quantity",
        "CAST(id AS DOUBLE) AS l_extendedprice", "element_at(array('A', 'N', 'R'), CAST(1 + id % 3 AS INT)) AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(80).selectExpr(
        "id AS o_orderkey", "id % 5 AS o_custkey", "element_at(array('F', 'O', 'P'), CAST(1 + id % 3 AS INT)) AS o_orderstatus", "'2-HIGH' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(9).selectExpr("id AS p_partkey", "CAST(1 + id % 50 AS INT) AS p_size", "'n' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(8).selectExpr("id div 2 AS conv_id", "id % 2 AS turn", "'user' AS role", "'t' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files that were not there before; they are removed behind the caller's back, so it may take a moment."""
    for _ in range(100):
        if not shuffle_files(spark) - before:
            return set()
        time.sleep(0.1)
    return shuffle_files(spark) - before


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    before = shuffle_files(spark)
    table = session.cut(df)
    assert not left_over(spark, before) and table.count() == 7
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"
    before = shuffle_files(spark)
    lines = spark.range(200).selectExpr("id % 2 AS doc", "1 AS section", "lpad(CAST(id AS STRING), 5, '0') AS place", "concat('line ', id) AS line")
    for codec in ("none", "gzip"):
        sinks.write_documents(lines, f"{tmp_path}/{codec}", "doc", compression=codec)
    assert not left_over(spark, before)
    assert glob.glob(f"{tmp_path}/gzip/*/*.gz") and not glob.glob(f"{tmp_path}/none/*/*.gz")
    plain, packed = (sorted(map(tuple, readers.numbered_lines(spark, f"{tmp_path}/{c}", "doc").collect())) for c in ("none", "gzip"))
    assert plain == packed and len(plain) == 200


def test_a_forgotten_table_is_gone(spark):
    table = session.cut(spark.range(5))
    (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in table.inputFiles()}
    session.forget(table)
    assert not glob.glob(f"{folder}*")


def test_large_tables_are_read_as_they_are(spark, tmp_path, monkeypatch):
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/t")
    dealt = lambda: "Exchange" in views.spread(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().sparkPlan().toString()
    assert dealt()
    monkeypatch.setattr(views, "BYTES_FOR_A_CORE", 1)
    assert not dealt()


def test_ids_come_back_from_their_bytes(spark):
    ids = ["OBS-0123456789abcdef", "0123456789abcdef", "X-0123456789ABCDEF", "OBS-0123456789abcdef\n", "", "i10", "ü-00000000000000ff", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("p", fold_module.packed("id"))
    rows = df.select("id", fold_module.unpacked("p").alias("back"), F.octet_length("p").alias("n")).collect()
    assert [r.back for r in rows] == ids and rows[0].n == 13
    assert len({bytes(r.p) for r in df.filter("p IS NOT NULL").collect()}) == len(ids) - 1


def test_first_kinds_of_each_run(spark):
    rows = [("a", 1), ("a", 2), ("a", 3), (None, 1), (None, 2), (None, 3), ("b", 1)]
    df = spark.createDataFrame(rows, "g string, seq int").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = [tuple(r) for r in fold_module._first_kinds(df, ["g"], 2).collect()]
            assert [r for r in got if r[0]] == [("a", 1), ("a", 2), ("b", 1)] and got[2:4] == [(None, 1), (None, 2)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_fold_shuffles_kinds_twice_and_stores_a_seq_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(fold_module, "cut", lambda df, *rest: stored.append(df) or df)
    rows = spark.createDataFrame(
        [("p", 10, "L1", "c", "LOW", 1, "i10", "t", "e", "r", 7), ("p", 60, "L1", "d", "HIGH", 3, "i60", "u", "f", "s", 8), ("p", 60, "L1", "d", "LOW", 1, "i60", "v", "g", "q", 9)], OBSERVED)
    fold = fold_module.fold_observations(rows)
    kinds = {(r.line, int(r.first_seq), r.last_seq and int(r.last_seq), r.best_seq, r.steps) for r in stored[0].collect()}
    assert kinds == {(10, 7, None, None, 4), (60, 8, 9, None, 2)}
    assert "Window" not in stored[1]._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.candidate_id, r.severity, r.title) for r in fold.candidates.collect()) == [("i10", "LOW", "t"), ("i60", "HIGH", "u")]


def test_rows_without_seq_are_taken_in_one_order(spark):
    rows = [("p", 3 * n, f"L{n % 2}", f"c{n % 5}", "LOW", 1, f"i{n}", "t", "e", "r", None) for n in range(60)] + [("p", 50 + n, "L0", "c", "HIGH", 3, f"j{n}", "t", "e", "r", n) for n in range(40)]
    df = spark.createDataFrame(rows, OBSERVED)
    got = [sorted(map(str, fold_module.fold_observations(df.repartition(n, "line")).candidates.collect())) for n in (1, 3, 17)]
    assert got[0] == got[1] == got[2]


def test_report_rows_are_stored_once_for_all_rules(spark, tables):
    t = gates._report_tables(spark, tables)
    for df in (t.documents, t.findings, t.hops):
        assert not any("lineitem" in f or "orders" in f for f in df.inputFiles())
    assert t.findings.count() > 0


def calls(monkeypatch, module, name):
    seen, function = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: seen.append(name) or function(*a, **k))
    return seen


def test_below_bar_units_makes_its_history_once(spark, tables, monkeypatch):
    seen = calls(monkeypatch, history.hist, "observed_ids")
    rows = history.below_bar_units(spark, tables).collect()
    assert len(seen) == 1 and {r.unit_id for r in rows} <= {f"UNIT-00{i}" for i in range(1, 6)}


def test_seal_coverage_starts_from_stored_rows(spark, tables):
    assert not any("lineitem" in f or "orders" in f for f in history.seal_coverage(spark, tables).inputFiles())


@pytest.mark.parametrize("name", ["mislabelled_slots", "diagnose_misses"])
def test_candidates_of_a_key_are_made_once(spark, tables, monkeypatch, name):
    seen = calls(monkeypatch, recall, "candidates")
    getattr(recall, name)(spark, tables).collect()
    assert len(seen) == 1


def test_lines_meet_their_splits_without_a_shuffle(spark, tmp_path):
    spark.range(30).selectExpr("CAST(id AS STRING) AS value").coalesce(1).write.text(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = readers.numbered_lines(spark, f"{tmp_path}/t")
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert [(r.line_no, r.value) for r in df.orderBy("line_no").collect()] == [(i + 1, str(i)) for i in range(30)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("module, name, folder", [(observations, "read_lanes", "lanes"), (reports, "sarif_files", "sarif")])
def test_texts_read_again_are_stored_compressed(spark, tables, monkeypatch, module, name, folder):
    places = []
    monkeypatch.setattr(module, "fresh_dir", lambda s, label: places.append(session.fresh_dir(s, label)) or places[-1])
    assert getattr(module, name)(spark, tables).count() > 0
    (place,) = places
    files = [f for f in glob.glob(f"{place}/**/part-*".replace("file:", ""), recursive=True)]
    assert files and all(f.endswith(".gz") for f in files)
