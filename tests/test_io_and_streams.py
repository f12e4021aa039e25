"""Lane files, sinks with receipts, documents put together again, streams with late rows, registry shape."""

import json

import pytest
from pyspark.sql import functions as F

from passledger.operators import corpus as co
from passledger.operators.observations import fill_sole_unit, route, validate_observations
from passledger.plans.report import build_report
from passledger.sources.readers import read_document, read_lanes
from passledger.sources.sinks import write_documents, write_redacted, write_sorted_jsonl
from passledger.streaming import jobs


def row(path="a.py", line=3, **kw):
    base = {"path": path, "line": line, "lens": "L1-auth", "category": "idor", "severity": "high", "title": "t", "evidence": "e", "reach_basis": "r"}
    return json.dumps({**base, **kw})


def test_read_lanes(spark, tmp_path):
    (tmp_path / "lane-pass1-L1-auth-UNIT-001.jsonl").write_text(row() + "\n\n" + row(line=True) + "\n{broken\n")
    (tmp_path / "lane-pass1-L2-secrets.jsonl").write_text(row(severity="INFO") + "\n")
    (tmp_path / "lane-sweep-L1-auth.jsonl").write_text(row(path="../x") + "\n")
    lanes = read_lanes(spark, str(tmp_path / "lane-*.jsonl"))
    assert lanes.filter("parse_error IS NOT NULL").count() == 1
    files = spark.createDataFrame([("UNIT-001", "a.py")], "unit_id string, path string")
    routed = route(validate_observations(fill_sole_unit(lanes.filter("parse_error IS NULL"), files)))
    reasons = {r.reason for r in routed.quarantined.collect()}
    assert reasons == {"candidate line must be a positive integer", "invalid severity: INFO", "candidate path must be relative"}
    valid = routed.valid.collect()
    assert [(r.unit_id, r.phase, r["pass"], r.severity) for r in valid] == [("UNIT-001", "pass", 1, "HIGH")]
    assert [r.seq for r in lanes.orderBy("seq").collect()] == sorted(r.seq for r in lanes.collect())
    with pytest.raises(Exception, match="lane-pass1-L1-auth-UNIT-001.jsonl:4: invalid JSON"):
        read_lanes(spark, str(tmp_path / "lane-*.jsonl"), "FAILFAST").collect()


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files of many splits, empty lines, foreign line ends, no line end at the end; folders of part files."""
    from passledger.sources.readers import numbered_lines
    from passledger.sources.sinks import write_lanes

    texts = {"a.txt": "".join(f"line {k}\n" * (k % 3 > 0) + "\n" * (k % 5 == 0) for k in range(400)), "b.txt": "x\r\ny\x0bz\n\nlast", "c.txt": "", "d.txt": "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {}
        for r in numbered_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.document.rsplit("/", 1)[1], {})[r.line_no] = r.value
        for name, text in texts.items():
            lines = text.split("\n")
            want = lines[:-1] if lines[-1] == "" else lines
            assert got.get(name, {}) == dict(enumerate(want, 1)), name
        (tmp_path / "lane-pass1-L1-auth-UNIT-001.jsonl").write_text((row() + "\n") * 30 + row() + "\u2028{broken\n")
        bad = read_lanes(spark, str(tmp_path / "lane-*.jsonl")).filter("parse_error is not null").collect()
        assert [(r.lane_file, r.line_no) for r in bad] == [("lane-pass1-L1-auth-UNIT-001.jsonl", 31)]
        with pytest.raises(Exception, match="UNIT-001.jsonl:31: invalid JSON"):
            read_lanes(spark, str(tmp_path / "lane-*.jsonl"), "FAILFAST").count()
        lanes = spark.range(900).selectExpr("concat('lane-pass', 1 + id % 2, '-L1-auth.jsonl') lane_file", "id", "concat('{\"line\": ', id, '}') value")
        write_lanes(lanes.repartition(5), str(tmp_path / "lanes"), ["id"])
        read = read_lanes(spark, str(tmp_path / "lanes"), folders=True)
        assert {(r["pass"], r.line_no, r.line) for r in read.collect()} == {(1 + k % 2, k // 2 + 1, k) for k in range(900)}
        assert [r.line for r in read.orderBy("seq").collect()] == [*range(0, 900, 2), *range(1, 900, 2)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_tagged_document(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"schema": "priors/v1", "targets": [{"id": "x"}]}, indent=1))
    ok, bad = read_document(spark, str(tmp_path / "p.json"), "schema string, targets array<struct<id:string>>", "priors/v1")
    assert ok.count() == 1 and bad.count() == 0
    assert read_document(spark, str(tmp_path / "p.json"), "schema string", "other")[1].count() == 1


def test_redacting_sink(spark, tmp_path):
    df = spark.createDataFrame([("mail me@example.org", 1), ("Bearer abcdef0123456789", 2)], "text string, n int")
    counts = write_redacted(df, str(tmp_path / "out"), "findings.jsonl")
    assert counts == {"email": 1, "bearer-token": 1}
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(r["text"] for r in rows) == ["Bearer [REDACTED]", "mail [REDACTED]"]
    assert spark.read.json(str(tmp_path / "out_redactions")).first().total == 2
    with pytest.raises(ValueError):
        write_redacted(df, str(tmp_path / "bad"), "../x")


def test_sorted_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "z string, a int")
    write_sorted_jsonl(df, str(tmp_path / "out"), ["z"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == '{"a":1,"z":"a"}\n{"a":2,"z":"b"}\n{"a":3,"z":"c"}\n'


def findings(spark):
    rows = [
        ("d1", "F-1", "svc/a.py", 3, "L1-auth", "idor", "HIGH", 3, "one", "verified"), ("d1", "F-2", "svc/b.py", 9, "L1-auth", "sql", "LOW", 1, "two", "conditional"),
        ("d1", "F-3", "svc/c.py", 1, "L1-auth", "xss", "HIGH", 3, "three", "refuted"), ("d2", "F-9", "top.py", 1, "L1-auth", "xss", "PRIORITIZED_CRITICAL", 5, "nine...", "conditional-court"),
    ]
    df = spark.createDataFrame(rows, "doc string, id string, path string, line bigint, lens string, category string, severity string, sev_rank int, title string, status string")
    return df.withColumns({"synthetic": F.lit(False), "cwe": F.lit(""), "fix": F.lit(""), "disproof_attempt": F.lit(""), "reach_basis": F.lit("edge=x"), "evidence": F.lit("e")})


def test_documents_are_valid_json(spark, tmp_path):
    ident = spark.createDataFrame([("d1", "APP1", "One", "est"), ("d2", "APP2", "Two", "est")], "doc string, app_id string, app_name string, estate string")
    hops = spark.createDataFrame(
        [("d1", "c1", "kept", "confirmed", 1, "F-2"), ("d1", "c1", "kept", "confirmed", 2, "F-1"), ("d1", "c2", "cut", "confirmed", 1, "F-3"), ("d1", "c2", "cut", "confirmed", 2, "F-1")],
        "doc string, chain_id string, title string, status string, hop_ord bigint, finding_id string")
    report = build_report(findings(spark), ident, "doc", "r-1", "1.0", hops)
    assert report.violations.count() == 0
    for name, lines in (("report", report.document), ("sarif", report.sarif)):
        write_documents(lines, str(tmp_path / name), "doc")
        for d in ("d1", "d2"):
            parts = sorted((tmp_path / name / f"doc={d}").glob("part-*"))
            doc = json.loads("".join(p.read_text() for p in parts))
            if name == "report" and d == "d1":
                assert [f["id"] for f in doc["findings"]] == ["F-1", "F-2"] and doc["declared_counts"]["total"] == 2
                assert [c["id"] for c in doc["chains"]] == ["c1"] and [h["finding_id"] for h in doc["chains"][0]["hops"]] == ["F-2", "F-1"]
            if name == "report" and d == "d2":
                assert doc["findings"][0]["title"] == "nine." and doc["findings"][0]["repo"] == "est" and doc["findings"][0]["pc_reason"] == "edge=x"
            if name == "sarif":
                assert doc["runs"][0]["results"] and len(doc["runs"][0]["tool"]["driver"]["rules"]) == len({r["ruleId"] for r in doc["runs"][0]["results"]})


def test_scan_corpus(spark, tmp_path):
    for p, t in (("svc/a.py", "x = 1\n"), ("svc/.git/b.py", "y"), ("top.sh", "#!/bin/sh\n")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {(r.path, r.repo, r.content) for r in co.scan_corpus(spark, str(tmp_path)).collect()}
    assert got == {("svc/a.py", "svc", "x = 1\n"), ("top.sh", "(root)", "#!/bin/sh\n")}


def staged(spark, place, batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", 1).parquet(place)


def test_stream_ledger_keeps_late_rows_apart(spark, tmp_path):
    d, r = "lane-dead", "lane-relaunched"
    batches = [[(d, "x", 100, 1), (r, "x", 200, 2)], [(d, "x", 150, 3), (d, "y", 300, 4)], [(r, "y", 90000, 5)], [(r, "y", 90001, 6)]]
    stream = staged(spark, str(tmp_path / "in"), batches, "event string, lane string, t bigint, seq bigint")
    out = jobs.drain(jobs.lane_ledger(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "update").collect()
    assert [(x.lane, x.kind) for x in out if x.kind == "late"] == [("x", "late")]
    final = {x.lane: (x.deaths, x.closures, x.outstanding, x.over_closures) for x in sorted(out, key=lambda x: x.batch) if x.kind == "state"}
    assert final == {"x": (1, 1, 0, 0), "y": (1, 2, 0, 1)}


def test_stream_ledger_raises_stalls(spark, tmp_path):
    d = "lane-dead"
    batches = [[(d, "x", 100, 1)], [(d, "y", 10000, 2)], [(d, "y", 10001, 3)], [(d, "y", 10002, 4)]]
    stream = staged(spark, str(tmp_path / "in"), batches, "event string, lane string, t bigint, seq bigint")
    out = jobs.drain(jobs.lane_ledger(stream, 600), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    assert [(x.lane, x.outstanding) for x in jobs.stalls(out).collect()] == [("x", 1)]
    first = min(x.batch for x in out.filter("kind = 'stalled'").collect())
    assert first < max(x.batch for x in out.filter("kind = 'state'").collect())  # raised while the stream still ran, lane x being silent


def test_late_rows_of_old_and_new_lanes_are_kept(spark, tmp_path):
    """Far behind all other events: an old lane's row goes to the side output, a new lane still appears, a window still counts."""
    d, r = "lane-dead", "lane-relaunched"
    batches = [[(d, "x", 36000, 1)], [(r, "x", 36060, 2)], [(d, "z", 36120, 3)], [(d, "x", 300, 4), (d, "y", 300, 5)], [(r, "y", 36130, 6)]]
    stream = staged(spark, str(tmp_path / "in"), batches, "event string, lane string, t bigint, seq bigint")
    out = jobs.drain(jobs.lane_ledger(stream, 600), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    assert {(x.lane, x.outstanding) for x in out.filter("kind = 'late'").collect()} == {("x", 0)}
    assert {x.lane: x.outstanding for x in jobs.latest(out.filter("kind = 'state'"), "lane").collect()} == {"x": 0, "y": 0, "z": 1}
    assert sorted((x.lane, x.outstanding) for x in out.filter("kind = 'stalled'").collect()) == [("y", 1)]
    calls = [[("m", "ok", 5, 36000)], [("m", "ok", 5, 80000)], [("m", "failed", 5, 36001)]]
    usage = staged(spark, str(tmp_path / "calls"), calls, "model string, status string, output_tokens bigint, t bigint").withColumnRenamed("ts", "started_at")
    table = jobs.drain(usage, str(tmp_path / "out2"), str(tmp_path / "cp2"), each=jobs.usage_windows)
    assert [(x.calls, x.successful) for x in jobs.closed_windows(table).collect()] == [(2, 1)]


def states(stream, place, mode):
    """Rows of state after each batch of a run, and the output table."""
    handle = {}

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    handle = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return handle, stream.sparkSession.read.parquet(f"{place}/out")


def test_forgotten_lanes_keep_their_totals(spark, tmp_path):
    """Each hour other lanes work, one comes back after days: state levels off, totals are those of the whole ledger."""
    from passledger.operators.ledger import reduce_ledger

    d, r = "lane-dead", "lane-relaunched"
    batches = [[(e, f"l{h}", h * 3600 + k, h * 10 + k) for k, e in enumerate([r, d, d])] + ([(r, "l0", h * 3600 + 9, h * 10 + 9)] if h in (11, 12) else []) for h in range(13)]
    stream = staged(spark, str(tmp_path / "in"), batches, "event string, lane string, t bigint, seq bigint")
    kept, _ = states(jobs.lane_ledger(stream, 600), str(tmp_path / "a"), "update")
    held, table = states(jobs.lane_ledger(stream, 600, 7200), str(tmp_path / "b"), "update")
    assert max(held[4:11]) == max(held[:4]) and max(held) <= max(held[:4]) + 1 < kept[-1]  # one more while l0 is back
    rows = spark.read.parquet(str(tmp_path / "in"))
    want = {tuple(x) for x in reduce_ledger(rows, ["ts", "seq"]).collect()}
    assert {tuple(x) for x in jobs.lane_totals(table).collect()} == want
    assert table.filter("lane = 'l0' and kind = 'state'").select("piece").distinct().count() == 2
    late = staged(spark, str(tmp_path / "late"), [*batches, [(d, "new", 5, 1), (d, "l12", 50000, 2)]], "event string, lane string, t bigint, seq bigint")
    _, table = states(jobs.lane_ledger(late, 600, 7200), str(tmp_path / "c"), "update")
    assert [(x.lane, x.outstanding) for x in table.filter("kind = 'late'").collect()] == [("new", 0)]  # too old to be told, and yet not lost


def test_once_forgets_and_loses_nothing(spark, tmp_path):
    hour = 3600
    batches = [[(f"k{h}-{i}", h * hour + i) for i in range(20)] + [(f"k{h - 1}-0", (h - 1) * hour)] * (h > 0) for h in range(12)]
    batches[9] += [("k0-3", 3), ("fresh", 4), ("fresh", 4), (None, 5)]
    stream = staged(spark, str(tmp_path / "in"), [[(k, t, 0) for k, t in b] for b in batches], "key string, t bigint, n bigint")
    held, table = states(jobs.once(stream, ["key"], "ts", "2 hours", shards=2), str(tmp_path / "a"), "append")
    assert max(held[8:]) <= max(held[:8]) + 2 and max(held) < 12 * 20
    assert table.filter("kind = 'first'").count() == 12 * 20 and table.filter("kind = 'late'").count() == 4
    got = sorted(str(x.key) for x in jobs.delivered(table, ["key"]).collect())
    assert got == sorted([*(f"k{h}-{i}" for h in range(12) for i in range(20)), "fresh", "None"])


def test_progress_emits_changes_only(spark, tmp_path):
    batches = [
        [("r", "unit", "u1", "loud", 1), ("r", "unit", "u2", "loud", 1), ("r", "unit", None, "loud", 1)],
        [("r", "lane", "a", "pass-1", 0), ("r", "candidate", "c1", "minor", 1), ("r", "candidate", "c2", "serious", 3), ("s", "unit", "u1", "quiet", 1)],
        [("r", "unit", "u1", "loud", 1), ("r", "lane", "a", "pass-1", 0), ("r", "candidate", "c2", "minor", 1)],  # nothing new
        [("r", "unit", "u1", "quiet", 3), ("r", "unit", "u1", "loud", 2), ("r", "candidate", "c1", "serious", 4), ("r", "candidate", "c3", "minor", 1), ("r", "lane", "b", "pass-2", 0), ("r", "lane", "x", "sweep", 0)],
        [("r", "verdict", "c2", "refuted", 0), ("r", "verdict", "c1", "verified", 0), ("r", "unit", "u1", "loud", 2)],
    ]
    stream = staged(spark, str(tmp_path / "in"), [[(*f, 0) for f in b] for b in batches], "run string, kind string, id string, value string, seq bigint, t bigint")
    changes = jobs.drain(jobs.fact_changes(stream, 2), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    rows = jobs.progress(changes).filter("run = 'r'").orderBy("batch").collect()
    names = ["phase", "units", "quiet", "lanes", "lanes_due", "pass", "sweeps", "candidates", "serious", "verdicts", "verified", "refuted", "gained"]
    assert [tuple(x[n] for n in names) for x in rows] == [
        ("preflight", 2, 0, 0, 8, None, 0, 0, 0, 0, 0, 0, 0), ("reading", 2, 0, 1, 8, 1, 0, 2, 1, 0, 0, 0, 2),
        ("reading", 2, 1, 2, None, 2, 1, 3, 2, 0, 0, 0, 1), ("courts", 2, 1, 2, None, 2, 1, 3, 2, 2, 1, 1, 0)]


def test_stream_first_sight_is_right_for_late_rows(spark, tmp_path):
    batches = [[("a", 3, 1, 0), ("b", 1, 4, 0)], [("a", 2, 3, 1)], [("a", 1, 2, 2), ("b", 2, 5, 2)]]
    stream = staged(spark, str(tmp_path / "in"), batches, "candidate_id string, slot bigint, sev_rank int, t bigint")
    table = jobs.drain(jobs.first_sight(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = {(x.candidate_id, x.slot, x.is_new, x.is_new_serious) for x in jobs.sight_events(jobs.latest(table, "candidate_id")).collect()}
    assert got == {("a", 1, True, False), ("a", 2, False, True), ("b", 1, True, True)}


def test_registry(spark):
    import __spark_entry__ as entry

    from passledger import catalog

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 120
    assert set(catalog.QUERIES) <= names
    assert set(catalog.QUERIES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 5


def test_fail_fast_does_not_depend_on_the_columns_read(spark, tmp_path):
    from passledger.sources.readers import read_lanes

    (tmp_path / "lane-pass1-L1-auth-UNIT-001.jsonl").write_text('{"path": "a.py", "line": 1}\nnot json\n')
    assert read_lanes(spark, str(tmp_path)).count() == 2
    for read in (lambda df: df.count(), lambda df: df.select("path", "line").collect()):
        with pytest.raises(Exception, match="UNIT-001.jsonl:2"):
            read(read_lanes(spark, str(tmp_path), "FAILFAST"))


def test_report_lines_parse_with_ties_and_long_ids(spark):
    from passledger.operators import report as rp

    rows = spark.createDataFrame([("d", 5, "r", "a.py:1", "F-1")] * 3 + [("d", -7, "r", "b.py:1", "F-2"), ("d", 10**18 + 1, "r", "c.py:1", "F-3"), ("d", 10**18, "r", "c.py:1", "F-4")],
                                 "doc string, _tier bigint, repo string, path string, id string")
    lines = rp._listed(rows, "doc", 1, ["_tier", "repo"], F.to_json(F.struct("id"))).orderBy("place").collect()
    assert [x["id"] for x in json.loads("[" + "".join(r.line for r in lines) + "]")] == ["F-2", "F-1", "F-1", "F-1", "F-4", "F-3"]


def test_a_report_computes_its_findings_once(spark):
    """However many documents and measures are made of it; the first member of a document alone has no comma."""
    from passledger.operators import report as rp
    from passledger.plans.report import build_report

    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    plain = spark.range(60).selectExpr(
        "id % 2 AS doc_id", "concat('F', id div 4) AS id", "'src/a.py' AS path", "id % 3 AS line", "'L1-auth' AS lens", "'sql-injection' AS category", "'HIGH' AS severity",
        "3 AS sev_rank", "'t' AS title", "'e' AS evidence", "'r' AS reach_basis", "'verified' AS status", "false AS synthetic", "CAST(NULL AS STRING) AS cwe",
        "CAST(NULL AS STRING) AS disproof_attempt", "'fix' AS fix")
    findings = plain.mapInArrow(count, plain.schema)
    identity = spark.range(2).selectExpr("id AS doc_id", "'A' AS app_id", "'B' AS app_name", "'C' AS estate")
    report = build_report(findings, identity, "doc_id", "r-1", "1.0")
    lines = report.sarif.filter("section = 3").orderBy("doc_id", "place").collect()
    assert report.document.filter("section = 1").count() == 60 and report.counts.count() == 2 and met.value == 60
    assert [r.line[0] == "," for r in lines] == 2 * ([False] + 29 * [True])
    listed = rp._listed(plain, "doc_id", 1, ["path"], F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in listed and "_first" in listed and "BroadcastHashJoin" not in listed
