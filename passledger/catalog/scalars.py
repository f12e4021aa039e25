"""Scalar functions over the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn
from passledger.catalog import query
from passledger.session import fresh_dir
from passledger.sources import sinks
from passledger.views import view

def _sq(text):
    return text.replace("'", "''")


MAIL = r"(^|[^A-Za-z0-9_\p{L}\p{N}])"

DIRTY = """
SELECT doc_id, concat(text, CASE doc_id % 9 WHEN 0 THEN concat(' db_password="hunter', doc_id, 'x"') WHEN 1 THEN concat(' key AKIAABCDEFGHIJKLMN', 10 + doc_id % 80)
  WHEN 2 THEN ' Authorization: Bearer abcdef0123456789xyz' WHEN 3 THEN ' id 123-45-6789 end' WHEN 4 THEN ' mail me.x@example.org now'
  WHEN 5 THEN ' eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY.sflKxwRJSMeKKF2QT4 ' WHEN 6 THEN ' ghp_0123456789abcdefghij0123 ' WHEN 7 THEN ' access_token: changeme' ELSE '' END) AS text FROM documents"""


def dirty(spark, sf):
    documents = view(spark, sf, "documents")
    if len(documents.inputFiles()) < spark.sparkContext.defaultParallelism:
        documents = documents.hint("rebalance")  # tasks of bounded size: as many as the rows need, not one per core
    return spark.sql(DIRTY.replace("FROM documents", "FROM {documents}"), documents=documents)


EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("redact_text", "X1", f"""
WITH d AS ({DIRTY}),
s1 AS (SELECT doc_id, regexp_replace(text, '\\beyJ[A-Za-z0-9_-]{{10,}}\\.[A-Za-z0-9_-]{{5,}}\\.[A-Za-z0-9_-]{{5,}}\\b', '[REDACTED]', 'g') AS t FROM d),
s2 AS (SELECT doc_id, regexp_replace(t, 'ghp_[A-Za-z0-9]{{20,}}', '[REDACTED]', 'g') AS t FROM s1),
s3 AS (SELECT doc_id, regexp_replace(t, '\\bAKIA[A-Z0-9]{{16}}\\b', '[REDACTED]', 'g') AS t FROM s2),
s4 AS (SELECT doc_id, regexp_replace(t, 'Bearer\\s+[A-Za-z0-9._~+/=-]{{12,}}', 'Bearer [REDACTED]', 'g') AS t FROM s3),
s5 AS (SELECT doc_id, regexp_replace(t, '(db_password=|access_token: )("[^"\\n]{{6,}}"|[^\\s,;"]{{6,}})', '\\1[REDACTED]', 'g') AS t FROM s4),
s6 AS (SELECT doc_id, regexp_replace(t, '\\b{EMAIL_SQL}\\b', '[REDACTED]', 'g') AS t FROM s5),
s7 AS (SELECT doc_id, regexp_replace(t, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '[REDACTED]', 'g') AS t FROM s6)
SELECT doc_id, t AS redacted FROM s7""")
def redact_text(spark, sf):
    return dirty(spark, sf).select("doc_id", fn.redact_text("text").alias("redacted"))


@query("redaction_counts", "A15 S6", f"""
WITH d AS ({DIRTY})
SELECT doc_id % 10 AS artifact, CAST(sum(len(regexp_extract_all(text, '\\b{EMAIL_SQL}\\b'))) AS BIGINT) AS email,
  CAST(sum(len(regexp_extract_all(text, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b'))) AS BIGINT) AS ssn, count(*) FILTER (WHERE doc_id % 9 IN (0, 7)) AS assignment,
  count(*) FILTER (WHERE doc_id % 9 = 1) AS aws, count(*) FILTER (WHERE doc_id % 9 = 2) AS bearer FROM d GROUP BY 1""")
def redaction_counts(spark, sf):
    counted = dirty(spark, sf).select((F.col("doc_id") % 10).alias("artifact"), fn.redaction_counts("text").alias("c"))
    total = lambda field: F.sum(F.col("c")[field])
    return counted.groupBy("artifact").agg(
        total("email").alias("email"), total("ssn").alias("ssn"), total("credential-assignment").alias("assignment"),
        total("aws-access-key").alias("aws"), total("bearer-token").alias("bearer"))


@query("redacted_files", "S6 A15", f"""
WITH d AS ({DIRTY}), t AS (SELECT CAST(sum(len(regexp_extract_all(text, '\\b{EMAIL_SQL}\\b'))) AS BIGINT) AS email,
  CAST(sum(len(regexp_extract_all(text, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b'))) AS BIGINT) AS ssn, count(*) FILTER (WHERE doc_id % 9 IN (0, 7)) AS assignment,
  count(*) FILTER (WHERE doc_id % 9 = 1) AS aws, count(*) FILTER (WHERE doc_id % 9 = 2) AS bearer, count(*) AS n_rows, count(*) FILTER (WHERE doc_id % 9 IN (5, 6)) AS tokens FROM d)
SELECT email, ssn, assignment, aws, bearer, n_rows, email + ssn + assignment + aws + bearer + tokens AS marks FROM t""")
def redacted_files(spark, sf):
    """The redacting sink: its receipt, and the marks in what it wrote."""
    place = fresh_dir(spark, "redacted")
    one_line = dirty(spark, sf).select(F.translate("text", "\n\r", "  ").alias("text"))
    sinks.write_redacted(one_line, place, "documents.txt", line="text")
    receipt = spark.read.schema("artifact string, counts map<string,bigint>, total bigint").json(f"{place}_redactions")
    named = {"email": "email", "ssn": "ssn", "assignment": "credential-assignment", "aws": "aws-access-key", "bearer": "bearer-token"}
    counts = receipt.select(*(F.coalesce(F.col("counts")[field], F.lit(0)).alias(n) for n, field in named.items()))
    rows = spark.read.text(place)
    marks = rows.agg(F.count("*").alias("n_rows"), F.sum(F.size(F.split("value", r"\[REDACTED\]")) - 1).cast("bigint").alias("marks"))
    return counts.crossJoin(marks)  # one row each


@query("redact_json", "X2", f"""
WITH d AS (SELECT doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN 'id 123-45-6789 end' ELSE 'no number here' END, ' of ', source, ' in ', lang) AS text FROM documents)
SELECT doc_id, replace(text, '123-45-6789', '[REDACTED]') AS text FROM d""")
def redact_json(spark, sf):
    text = F.expr("concat(CASE WHEN doc_id % 2 = 0 THEN 'id 123-45-6789 end' ELSE 'no number here' END, ' of ', source, ' in ', lang)")
    rows = view(spark, sf, "documents").select("doc_id", F.struct("doc_id", text.alias("text")).alias("v"))
    return rows.select("doc_id", fn.redact_json("v", "doc_id bigint, text string").alias("r")).select("doc_id", "r.text")


@query("leak_check", "X3", r"""
WITH d AS (""" + DIRTY + r"""), h AS (SELECT doc_id, text, regexp_extract_all(text, '(?i)(?:password|passwd|pwd|secret|api[_-]?key|token)\s*[=:]\s*["'']?([A-Za-z0-9!@#$%^&*_+-]{6,})', 1) AS vs FROM d)
SELECT doc_id, CASE WHEN len(list_filter(vs, lambda v: NOT regexp_matches(v, '^[$+]') AND (regexp_matches(v, '[^A-Za-z_-]') OR (v <> lower(v) AND v <> upper(v)))
    AND NOT regexp_full_match(v, '(?i)(?:x+|\*+|change.?me|placeholder|redacted|password|secret|value|dummy|example|test\w*|none|null|true|false|vault\w*|env\w*)'))) > 0 THEN 'credential'
  WHEN regexp_matches(text, 'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}') THEN 'jwt' WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'aws-key'
  WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private-key' END AS leak FROM h""")
def leak_check(spark, sf):
    return dirty(spark, sf).select("doc_id", fn.leak_check("text").alias("leak"))


@query("severity_scales", "X5", """
SELECT severity, CAST(any_value(sev_rank) AS INTEGER) AS rank,
  CASE severity WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'error' END AS level,
  CASE severity WHEN 'PRIORITIZED_CRITICAL' THEN '9.8' WHEN 'CRITICAL' THEN '9.0' WHEN 'HIGH' THEN '7.5' WHEN 'MEDIUM' THEN '5.0' ELSE '2.5' END AS score,
  CASE severity WHEN 'PRIORITIZED_CRITICAL' THEN 'pc' ELSE lower(severity) END AS tier, count(*) AS n FROM f2_valid GROUP BY severity""")
def severity_scales(spark, sf):
    per = view(spark, sf, "f2_valid").groupBy("severity").agg(F.count("*").alias("n"))
    return per.select("severity", fn.severity_rank("severity").alias("rank"), fn.sarif_level("severity").alias("level"),
                      fn.security_severity("severity").alias("score"), fn.tier_key("severity").alias("tier"), "n")


CWE_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{cwe}'" for words, cwe in C.CATEGORY_CWE
) + f" ELSE '{C.DEFAULT_CWE}' END"


@query("category_cwe", "X6", f"""
WITH w AS (SELECT event_id, lower(concat(event_type, ' ', CASE event_id % 31 {' '.join(f"WHEN {i} THEN '{words[0]}'" for i, (words, _) in enumerate(C.CATEGORY_CWE))} ELSE 'plain' END)) AS t FROM events)
SELECT event_id, {CWE_SQL} AS cwe FROM w""")
def category_cwe(spark, sf):
    word = F.expr(f"""CASE event_id % 31 {' '.join(f"WHEN {i} THEN '{words[0]}'" for i, (words, _) in enumerate(C.CATEGORY_CWE))} ELSE 'plain' END""")
    return view(spark, sf, "events").select("event_id", fn.category_cwe("event_type", word).alias("cwe"))


@query("report_texts", "X7", r"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN concat(title, '...') WHEN 1 THEN concat(title, '.… ') WHEN 2 THEN concat(title, '..') ELSE title END AS title,
   CASE l_partkey % 5 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-0' WHEN 2 THEN 'none' WHEN 3 THEN ' CWE-12 ' END AS cwe,
   CASE l_partkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'No code change required; x' ELSE 'Validate the caller before acting.' END AS fix, category, path, line FROM f2_valid)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN concat(regexp_replace(title, '[.]+$', ''), '.') WHEN 1 THEN concat(regexp_replace(title, '[.… ]+$', ''), '.') ELSE title END AS title,
  coalesce(regexp_full_match(trim(cwe), 'CWE-[1-9][0-9]*'), false) AS cwe_ok,
  CASE WHEN l_partkey % 3 = 0 THEN printf('{NO_FIX}', category, path, CAST(line AS VARCHAR)) ELSE fix END AS fix FROM d""".replace("{NO_FIX}", C.NO_FIX))
def report_texts(spark, sf):
    d = view(spark, sf, "f2_valid").withColumns({
        "title": F.expr("CASE l_partkey % 4 WHEN 0 THEN concat(title, '...') WHEN 1 THEN concat(title, '.… ') WHEN 2 THEN concat(title, '..') ELSE title END"),
        "cwe": F.expr("CASE l_partkey % 5 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-0' WHEN 2 THEN 'none' WHEN 3 THEN ' CWE-12 ' END"),
        "fix": F.expr("CASE l_partkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'No code change required; x' ELSE 'Validate the caller before acting.' END")})
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fn.repair_title("title").alias("title"), fn.valid_cwe("cwe").alias("cwe_ok"),
                    fn.fix_or_fallback("fix", "category", "path", "line").alias("fix"))


FAMILY_SQL = " OR ".join(
    f"(k.family = '{f}' AND (" + " OR ".join(f"contains(t, '{w}')" for w in words) + "))" for f, words in C.FAMILY_KEYWORDS.items())


@query("family_compatible", "X8", f"""
WITH v AS (SELECT DISTINCT lens, category, lower(concat(category, ' ', p_name)) AS t, p_name, p_partkey FROM f2_valid JOIN part ON p_partkey = l_partkey)
SELECT p_partkey, v.lens, category, k.family, v.lens = k.family OR {FAMILY_SQL} AS compatible FROM v JOIN (SELECT slot, family FROM f5) k ON k.slot = v.p_partkey""")
def family_compatible(spark, sf):
    part = view(spark, sf, "part").select("p_partkey", "p_name")
    v = view(spark, sf, "f2_valid").select(F.col("l_partkey").alias("p_partkey"), "lens", "category").distinct().join(part, "p_partkey")
    k = view(spark, sf, "f5").select(F.col("slot").alias("p_partkey"), "family")
    return v.join(k, "p_partkey").select("p_partkey", "lens", "category", "family",
                                         fn.family_compatible("family", "lens", "category", "p_name").alias("compatible"))


@query("plant_classes", "X9", r"""
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(path), '\.(yml|yaml|properties|json|xml|toml|ini|cfg|conf|env)$') THEN 'config' END,
  CASE WHEN regexp_matches(lower(path), '(\.tf|\.tfvars|(^|/)dockerfile[^/]*)$') THEN 'iac' END,
  CASE WHEN NOT regexp_matches(lower(path), '\.(yml|yaml|properties|json|xml|toml|ini|cfg|conf|env)$') AND NOT regexp_matches(lower(path), '(\.tf|\.tfvars|(^|/)dockerfile[^/]*)$') THEN 'source' END) AS classes
FROM f1_mixed""")
def plant_classes(spark, sf):
    return view(spark, sf, "f1_mixed").select("doc_id", F.array_join(fn.plant_classes("path"), ",").alias("classes"))


@query("parse_kv", "X10", """
SELECT reach_basis, concat('e', regexp_extract(reach_basis, 'edge=e([0-9]+)', 1)) AS edge, concat('r', regexp_extract(reach_basis, 'route=r([0-9]+)', 1), '=x') AS route, 2 AS n FROM f2_valid GROUP BY ALL""")
def parse_kv(spark, sf):
    kinds = view(spark, sf, "f2_valid").select("reach_basis").distinct()
    text = F.concat(F.lit("edge=old; "), F.regexp_replace(F.col("reach_basis"), "edge", " EDGE "), F.lit("=x; empty=; junk"))
    m = kinds.withColumn("m", fn.parse_kv(text))
    return m.select("reach_basis", F.col("m")["edge"].alias("edge"), F.col("m")["route"].alias("route"), F.size("m").alias("n"))


@query("neutralise_formula", "X11", """
WITH v AS (SELECT event_id, concat(CASE event_id % 7 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) ELSE '' END, event_type) AS v FROM events)
SELECT event_id, CASE WHEN event_id % 7 < 5 THEN concat('''', v) ELSE v END AS v FROM v""")
def neutralise_formula(spark, sf):
    v = F.expr("concat(CASE event_id % 7 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) ELSE '' END, event_type)")
    return view(spark, sf, "events").select("event_id", fn.neutralise_formula(v).alias("v"))


@query("split_locus", "X12", """
SELECT path, line, CASE WHEN l_partkey % 3 = 0 THEN CAST(1 AS BIGINT) ELSE line END AS parsed, split_part(path, '/', 1) AS repo, substring(path, strpos(path, '/') + 1) AS rel FROM f2_valid GROUP BY ALL""")
def split_locus(spark, sf):
    kinds = view(spark, sf, "f2_valid").select("path", "line", "l_partkey").distinct()
    locus = F.concat("path", F.lit(":"), F.expr("CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE CAST(line AS STRING) END"))
    out = kinds.withColumn("s", fn.split_locus(locus)).withColumn("r", fn.split_repo("s.path", F.lit("estate")))
    return out.select(F.col("s.path").alias("path"), "line", F.col("s.line").alias("parsed"), "r.repo", "r.rel")


@query("identity", "X13", r"""
WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('APP', s_suppkey, ' | ', s_name) WHEN 1 THEN concat('../x|', s_name) WHEN 2 THEN s_name ELSE concat('ok.', s_suppkey, '|') END AS t, s_name FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN concat('APP', s_suppkey) ELSE regexp_replace(s_name, '[^A-Za-z0-9._-]', '-', 'g') END AS app_id, regexp_replace(s_name, '[^A-Za-z0-9 ._-]', '-', 'g') AS app_name FROM t""")
def identity(spark, sf):
    t = F.expr("concat(CASE s_suppkey % 4 WHEN 0 THEN concat('APP', s_suppkey, ' | ', s_name) WHEN 1 THEN concat('../x|', s_name) WHEN 2 THEN s_name ELSE concat('ok.', s_suppkey, '|') END, '\\nsecond|line')")
    return view(spark, sf, "supplier").select("s_suppkey", fn.identity(t, "s_name").alias("i")).select("s_suppkey", "i.*")


@query("run_id", "X14", """
SELECT event_id, concat('r-', substring(sha256(concat(sha256(event_type), ' ', strftime(ts, '%Y-%m-%dT%H:%MZ'), ' ', user_id)), 1, 12)) AS run_id FROM events""")
def run_id(spark, sf):
    return view(spark, sf, "events").select(
        "event_id", fn.run_id(F.sha2("event_type", 256), F.col("ts"), F.col("user_id").cast("string")).alias("run_id"))


@query("quiet_threshold", "X15", "SELECT o_orderkey, greatest(2, CAST(round_even(o_orderkey * 12500 / 25000.0, 0) AS BIGINT)) AS bar FROM orders")
def quiet_threshold(spark, sf):
    return view(spark, sf, "orders").select("o_orderkey", fn.quiet_threshold(F.col("o_orderkey") * 12500).alias("bar"))


@query("lane_labels", "X17", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pass, lens, unit_id, concat(CASE l_partkey % 3 WHEN 0 THEN 'recap-' WHEN 1 THEN '' ELSE 'x' END, 'pass', pass, '-', lens, '-', unit_id) AS label FROM f2_valid)
SELECT label, CASE WHEN l_partkey % 3 < 2 THEN pass END AS pass, CASE WHEN l_partkey % 3 < 2 THEN lens END AS lens, CASE WHEN l_partkey % 3 < 2 THEN unit_id END AS unit_id, count(*) AS n FROM l GROUP BY ALL""")
def lane_labels(spark, sf):
    label = F.expr("concat(CASE l_partkey % 3 WHEN 0 THEN 'recap-' WHEN 1 THEN '' ELSE 'x' END, 'pass', pass, '-', lens, '-', unit_id)")
    n = view(spark, sf, "f2_valid").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return n.select("label", "n", fn.parse_lane_label("label").alias("l")).select("label", "l.pass", "l.lens", "l.unit_id", "n")


@query("strip_escapes", "X18", "SELECT conv_id, turn, text FROM conversations")
def strip_escapes(spark, sf):
    painted = F.concat(F.lit("\u001b[38;5;35m"), "text", F.lit("\u001b[0m"))
    return view(spark, sf, "conversations").select("conv_id", "turn", fn.strip_escapes(painted).alias("text"))


@query("duration_text", "X20", """
WITH m AS (SELECT event_id, greatest(1, CAST(floor(value * 100) AS BIGINT) // 60) AS m FROM events)
SELECT event_id, concat(m // 60, 'h', lpad(CAST(m % 60 AS VARCHAR), 2, '0'), 'm') AS duration, concat(m, '/', m + 1) AS ratio FROM m""")
def duration_text(spark, sf):
    seconds = F.floor(F.col("value") * 100).cast("bigint")
    m = F.greatest(F.lit(1).cast("bigint"), F.floor(seconds / 60).cast("bigint"))
    return view(spark, sf, "events").select("event_id", fn.format_duration(seconds).alias("duration"), fn.ratio_text(m, m + 1).alias("ratio"))


@query("content_token", "X22", "SELECT item_id, substring(sha256(concat(text, '|PASS')), 1, 16) AS token FROM benchmark")
def content_token(spark, sf):
    return view(spark, sf, "benchmark").select("item_id", fn.content_token("text", "PASS").alias("token"))


@query("verdict_body", "X23", "SELECT conv_id, turn, concat('# Verdict', chr(10), text, '.', chr(10)) AS body FROM conversations")
def verdict_body(spark, sf):
    text = F.concat(F.lit("  chatter first\n# Verdict\n"), "text", F.lit(".  \n"))
    return view(spark, sf, "conversations").select("conv_id", "turn", fn.verdict_body(text).alias("body"))
