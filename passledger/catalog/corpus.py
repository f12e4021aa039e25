"""Census, units, detectors, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from passledger import constants as C
from passledger import functions as fn
from passledger.catalog import query
from passledger.operators import corpus as co
from passledger.operators import detect as de
from passledger.operators import snapshots as sn
from passledger.session import fresh_dir
from passledger.views import fence, view


def _in(values):
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


BASE = "regexp_extract(path, '([^/]*)$', 1)"
EXT = f"lower(regexp_extract(regexp_replace({BASE}, '^\\.+', ''), '(\\.[^.]*)$', 1))"
CLASSES = f"""
classed AS (
  SELECT *, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '(root)' END AS repo,
         length(content) - length(replace(content, chr(10), '')) AS lines,
         CASE WHEN list_contains(string_split(path, '/'), '.git') THEN 'pruned'
              WHEN path LIKE '%/%' AND split_part(path, '/', 1) IN {_in(C.RECORD_ZONES)} THEN 'zone'
              WHEN path LIKE 'OPTIONAL_PRIORS/%' THEN 'staging' WHEN path NOT LIKE '%/%' AND starts_with(path, 'PRIORS_') THEN 'staging'
              WHEN {BASE} IN {_in(C.LOCKFILES)} THEN 'lock'
              WHEN {EXT} IN {_in(C.CODE_EXTENSIONS)} OR {BASE} IN {_in(C.CODE_NAMES)} THEN 'code'
              WHEN starts_with(content, '#!') THEN 'shebang' ELSE 'other' END AS class
  FROM f1_mixed)"""
ROLLUP = f"""{CLASSES},
rolled AS (SELECT repo, CAST(sum(lines) AS BIGINT) AS loc, count(*) AS files, CAST(coalesce(sum(lines) FILTER (WHERE class = 'code'), 0) AS BIGINT) AS code_loc,
                  coalesce(max(lines) FILTER (WHERE class = 'code'), 0) AS biggest_lines FROM classed WHERE class IN ('code', 'shebang') GROUP BY repo)"""


@query("corpus_scan", "S1", "SELECT doc_id, path, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '(root)' END AS repo, length(content) AS n FROM f1_mixed WHERE NOT list_contains(string_split(path, '/'), '.git')")
def corpus_scan(spark, sf):
    return co.adapt_corpus(view(spark, sf, "f1_mixed")).select("doc_id", "path", "repo", F.length("content").cast("bigint").alias("n"))


@query("corpus_files", "S1", "SELECT concat('source=', source) AS repo, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(len(text) - len(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents GROUP BY source")
def corpus_files(spark, sf):
    """Documents written as files, a folder per source, and scanned again."""
    place = fresh_dir(spark, "corpus")
    view(spark, sf, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(place)
    files = co.scan_corpus(spark, place)
    return files.groupBy("repo").agg(F.sum(F.octet_length("content")).alias("bytes"), F.sum(fn.newline_count("content")).alias("lines"))


@query("copy_filter", "S2", f"""
SELECT doc_id, path FROM f1_mixed WHERE NOT list_has_any(string_split(lower(path), '/'), ['.git', '.docs', 'test']) AND NOT regexp_matches({BASE}, '\\.tf$')""")
def copy_filter(spark, sf):
    return co.exclude_paths(view(spark, sf, "f1_mixed"), [".git", ".docs", "TEST"], ["*.tf"]).select("doc_id", "path")


@query("file_classes", "P1 P2", f"WITH {CLASSES} SELECT doc_id, path, class, lines FROM classed")
def file_classes(spark, sf):
    df = view(spark, sf, "f1_mixed")
    return df.select("doc_id", "path", co.classify_file().alias("class"), fn.newline_count("content").alias("lines"))


@query("file_classes_replayed", "P2", f"""
WITH {CLASSES} SELECT doc_id, CASE WHEN class = 'shebang' AND doc_id % 3 = 0 THEN 'other' ELSE class END AS class FROM classed""")
def file_classes_replayed(spark, sf):
    rules = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'ext/v1' ELSE 'ext+shebang/v2' END")
    return view(spark, sf, "f1_mixed").select("doc_id", co.classify_file(rules=rules).alias("class"))


@query("repo_rollup", "A1", f"""
WITH {ROLLUP} SELECT r.repo, r.loc, r.files, r.code_loc, r.biggest_lines,
  (SELECT min(c.path) FROM classed c WHERE c.repo = r.repo AND c.class = 'code' AND c.lines = r.biggest_lines) AS biggest_path FROM rolled r""")
def repo_rollup(spark, sf):
    return co.repo_rollup(co.census(view(spark, sf, "f1_mixed"))).drop("mass_suspect", "packed_loc")


@query("mass_suspects", "A2", f"WITH {ROLLUP} SELECT repo, biggest_lines, code_loc FROM rolled WHERE biggest_lines >= 20 AND code_loc > 0 AND biggest_lines >= 0.1 * code_loc")
def mass_suspects(spark, sf):
    return co.mass_suspects(co.census(view(spark, sf, "f1_mixed")), lines=20, fraction=0.1).select("repo", "biggest_lines", "code_loc")


@query("class_rollup", "A3", f"WITH {CLASSES} SELECT class, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS files FROM classed WHERE class <> 'pruned' GROUP BY class")
def class_rollup(spark, sf):
    return co.class_rollup(co.census(view(spark, sf, "f1_mixed")))


@query("corpus_totals", "A4", f"""
WITH {ROLLUP} SELECT CAST(sum(loc) AS BIGINT) AS raw_loc, CAST(sum(loc) AS BIGINT) AS scannable_loc, count(*) AS repos,
  greatest(100, CAST(ceil(sum(loc) / 40.0) AS BIGINT)) AS cap FROM rolled""")
def corpus_totals(spark, sf):
    return co.corpus_totals(co.repo_rollup(co.census(view(spark, sf, "f1_mixed"))), floor=100)


@query("cost_estimate", "A17", f"""
WITH {ROLLUP} SELECT CAST(sum(loc) AS BIGINT) AS scannable_loc, CAST(sum(loc) * 40 AS BIGINT) AS tokens_low, CAST(sum(loc) * 110 AS BIGINT) AS tokens_high,
  CAST(round(sum(loc) * 40 / 1e6 * 5, 2) AS DOUBLE) AS usd_low, CAST(round(sum(loc) * 110 / 1e6 * 5, 2) AS DOUBLE) AS usd_high FROM rolled""")
def cost_estimate(spark, sf):
    totals = co.corpus_totals(co.repo_rollup(co.census(view(spark, sf, "f1_mixed"))))
    return co.cost_estimate(totals).select("scannable_loc", "tokens_low", "tokens_high", "usd_low", "usd_high")


PACK = f"""
WITH RECURSIVE {CLASSES}, dirs AS (
  SELECT concat(repo, '-', doc_id % 40) AS repo, CAST(sum(lines) AS BIGINT) AS loc FROM classed WHERE class IN ('code', 'shebang') GROUP BY 1),
caps AS (SELECT greatest(200, CAST(ceil(sum(loc) / 40.0) AS BIGINT)) AS cap FROM dirs),
sized AS (SELECT repo, loc, cap, row_number() OVER (ORDER BY loc DESC, repo) AS k FROM dirs CROSS JOIN caps),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS loads, CAST(NULL AS VARCHAR) AS repo, CAST(0 AS BIGINT) AS loc, CAST(0 AS BIGINT) AS bin_no
  UNION ALL
  SELECT k, CASE WHEN hit IS NULL THEN list_append(loads, loc) ELSE list_transform(loads, lambda x, i: CASE WHEN i = hit THEN x + loc ELSE x END) END,
         repo, loc, coalesce(hit, len(loads) + 1)
  FROM (SELECT s.k, w.loads, s.repo, s.loc, CAST(list_position(list_transform(w.loads, lambda x: x + s.loc <= s.cap), true) AS BIGINT) AS hit
        FROM walk w JOIN sized s ON s.k = w.k + 1))
SELECT repo, loc, concat('UNIT-', lpad(CAST(bin_no AS VARCHAR), 3, '0')) AS unit_id FROM walk WHERE k > 0"""


@query("unit_packing", "A5", PACK)
def unit_packing(spark, sf):
    files = co.census(view(spark, sf, "f1_mixed").withColumn("n", F.col("doc_id") % 40), scope=["n"])
    files = files.withColumn("repo", F.concat_ws("-", "repo", F.col("n").cast("string")))
    return co.pack_units(co.repo_rollup(files), floor=200).select("repo", F.col("packed_loc").alias("loc"), "unit_id")


@query("unit_listing", "A5 J1", PACK.replace(
    "SELECT repo, loc, concat('UNIT-', lpad(CAST(bin_no AS VARCHAR), 3, '0')) AS unit_id FROM walk WHERE k > 0",
    "SELECT concat('UNIT-', lpad(CAST(w.bin_no AS VARCHAR), 3, '0')) AS unit_id, c.path FROM walk w JOIN classed c ON concat(c.repo, '-', c.doc_id % 40) = w.repo AND c.class IN ('code', 'shebang')"))
def unit_listing(spark, sf):
    files = co.census(view(spark, sf, "f1_mixed").withColumn("n", F.col("doc_id") % 40), scope=["n"])
    files = files.withColumn("repo", F.concat_ws("-", "repo", F.col("n").cast("string")))
    return co.unit_listing(files, co.pack_units(co.repo_rollup(files), floor=200))


@query("text_line_count", "A14", f"""
WITH c AS (SELECT repo, path, content FROM f1 WHERE {EXT} IN {_in(C.SATURATION_SUFFIXES)})
SELECT repo, CAST(sum(length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS scannable_lines FROM c GROUP BY repo""")
def text_line_count(spark, sf):
    return co.text_lines_total(view(spark, sf, "f1"), ["repo"])


FPRINT = """
d AS (SELECT repo, sha256(concat(path, chr(0), {content})) AS d FROM f1)
SELECT repo, count(*) AS files, sha256(concat_ws('|', count(*), sum(CAST(concat('0x', substring(d, 1, 15)) AS BIGINT)), sum(CAST(concat('0x', substring(d, 16, 15)) AS BIGINT)),
       sum(CAST(concat('0x', substring(d, 31, 15)) AS BIGINT)), sum(CAST(concat('0x', substring(d, 46, 15)) AS BIGINT)))) AS fingerprint FROM d GROUP BY repo"""


@query("corpus_fingerprint", "A21", "WITH " + FPRINT.replace("{content}", "content"))
def corpus_fingerprint(spark, sf):
    return co.fingerprint(view(spark, sf, "f1"), ["repo"])


@query("change_fingerprint", "A30", "WITH " + FPRINT.replace("{content}", "length(content)"))
def change_fingerprint(spark, sf):
    return co.change_fingerprint(view(spark, sf, "f1").withColumn("size", F.length("content")), ["repo"])


@query("class_feasibility", "A18 X9", f"""
WITH k AS (SELECT path, {EXT} IN {_in(C.CONFIG_SUFFIXES)} AS config, {EXT} IN {_in(C.INFRA_SUFFIXES)} OR starts_with(lower({BASE}), 'dockerfile') AS iac FROM f1_mixed),
n AS (SELECT 'L1-auth' AS family, count(DISTINCT path) FILTER (WHERE config OR NOT (config OR iac)) AS eligible FROM k
  UNION ALL SELECT 'L2-secrets', count(DISTINCT path) FILTER (WHERE config OR NOT (config OR iac)) FROM k
  UNION ALL SELECT 'L3-injection', count(DISTINCT path) FILTER (WHERE NOT (config OR iac)) FROM k UNION ALL SELECT 'L4-infra', count(DISTINCT path) FILTER (WHERE config OR iac) FROM k)
SELECT family, eligible, CASE WHEN eligible < 2 THEN 'infeasible' WHEN eligible <= 3 THEN 'tight' ELSE 'ok' END AS state FROM n""")
def class_feasibility(spark, sf):
    return co.class_feasibility(view(spark, sf, "f1_mixed"))


LINES = "lined AS (SELECT doc_id, path, string_split(content, chr(10)) AS ls FROM f1_code), line_rows AS (SELECT doc_id, path, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line, len(ls) AS total FROM lined), lines_of AS (SELECT doc_id, path, text, line FROM line_rows WHERE NOT (line = total AND text = ''))"


@query("corpus_search", "P10 T7", f"""
WITH {LINES} SELECT path, line, substring(trim(text), 1, 200) AS text FROM lines_of WHERE path LIKE 'src%.py' AND regexp_matches(text, 'verify\\s*=|__proto__') ORDER BY path, line LIMIT 200""")
def corpus_search(spark, sf):
    return co.search(view(spark, sf, "f1_code"), r"verify\s*=|__proto__", "src*.py")


@query("line_window", "P11", f"""
WITH {LINES} SELECT path, string_agg(concat(line, chr(9), text), chr(10) ORDER BY line) FILTER (WHERE line BETWEEN 2 AND 6) AS body, count(*) AS total_lines, count(*) > 6 AS truncated FROM lines_of GROUP BY path""")
def line_window(spark, sf):
    return co.line_window(view(spark, sf, "f1_code"), 2, 5).withColumn("body", F.when(F.col("body") != "", F.col("body")))


def _detector_rows():
    rows = []
    for name, cls, pattern, hashed in C.LINE_DETECTORS:
        p = pattern.replace("'", "''")
        match = f"regexp_extract(text, '{p}', 0)"
        evidence = f"concat('REDACTED:sha256:', substring(sha256({match}), 1, 12))" if hashed else f"substring({match}, 1, 80)"
        test = "" if name in C.SUPPRESSION_EXEMPT else " AND NOT in_test"
        rows.append(f"SELECT path, line, '{name}' AS detector, '{cls}' AS class, {evidence} AS evidence FROM eligible WHERE regexp_matches(text, '{p}'){test}")
    return " UNION ALL ".join(rows)


ELIGIBLE = f"""{LINES}, eligible AS (
  SELECT *, regexp_matches(path, '(^|/)(test|tests|spec|__tests__)(/|$)') AS in_test FROM lines_of
  WHERE regexp_matches(path, '{C.SWEEP_FILE_PATTERN}') AND NOT regexp_matches(ltrim(text), '^(//|#|\\*|--)') AND NOT starts_with(path, 'vendor/'))"""
HITS = f"{ELIGIBLE}, hits AS ({_detector_rows()})"


def _hits(spark, sf):
    return de.sweep_lines(de.exclude_dirs(fence(view(spark, sf, "f1_code").drop("doc_id"))))


@query("detector_sweep", "D1 D2 P8 P9", f"WITH {HITS} SELECT * FROM hits")
def detector_sweep(spark, sf):
    return _hits(spark, sf)


@query("custom_detectors", "D4", r"""
SELECT page_id, path, CAST(1 AS BIGINT) AS line, d.detector, d.class, CASE WHEN d.detector = 'inline-var' THEN concat('REDACTED:sha256:', substring(sha256(regexp_extract(html, d.p, 0)), 1, 12)) ELSE substring(regexp_extract(html, d.p, 0), 1, 80) END AS evidence
FROM (SELECT page_id, html, concat('site', page_id % 7, '/p', page_id, '.html') AS path FROM pages) x
CROSS JOIN (VALUES ('tracker', 'markup', 'track\(\d+\)'), ('inline-var', 'script', 'var \w+="[^"]*"'), ('meta-charset', 'markup', 'charset="[^"]*"')) d(detector, class, p)
WHERE regexp_matches(html, d.p)""")
def custom_detectors(spark, sf):
    pages = view(spark, sf, "pages").selectExpr("page_id", "concat('site', page_id % 7, '/p', page_id, '.html') AS path", "regexp_replace(html, '[\\\\r\\\\n]+', ' ') AS content")
    detectors = [("tracker", "markup", r"track\(\d+\)", False), ("inline-var", "script", r'var \w+="[^"]*"', True), ("meta-charset", "markup", r'charset="[^"]*"', False)]
    return de.sweep_lines(pages, detectors, file_pattern=None)


@query("file_detectors", "D3", f"""
WITH {LINES}, wrapped AS (SELECT path, min(line) FILTER (WHERE contains(text, 'distributionUrl')) AS line, bool_or(regexp_matches(text, '^\\s*distributionSha256Sum\\s*=')) AS pinned FROM lines_of WHERE path LIKE '%/gradle-wrapper.properties' GROUP BY path)
SELECT path, line, 'wrapper-sha256' AS detector, 'supply-chain-pinning' AS class, 'distributionUrl without distributionSha256Sum' AS evidence FROM wrapped WHERE NOT pinned
UNION ALL
SELECT path, line, 'floating-version', 'supply-chain-pinning', substring(regexp_extract(text, '{C.FLOATING_PATTERN.replace(chr(39), chr(39) * 2)}', 0), 1, 80) FROM lines_of
WHERE regexp_matches(path, '\\.(gradle(\\.kts)?|properties)$') AND NOT regexp_matches(path, '(^|/)(test|tests|spec|__tests__)(/|$)') AND NOT regexp_matches(ltrim(text), '^(//|#|\\*|--|!)')
  AND regexp_matches(text, '{C.FLOATING_PATTERN.replace(chr(39), chr(39) * 2)}')""")
def file_detectors(spark, sf):
    return de.sweep_files(fence(view(spark, sf, "f1_code").drop("doc_id")))


@query("excluded_paths", "P9", "SELECT path FROM f1_code WHERE NOT starts_with(path, 'vendor/') AND doc_id % 50 <> 3")
def excluded_paths(spark, sf):
    df = view(spark, sf, "f1_code")
    return de.exclude_dirs(df, ledger=df.filter("doc_id % 50 = 3").select(F.col("path").alias("quarantine"))).select("path")


@query("lint_policy", "P12", f"""
WITH {LINES}, h AS (SELECT path, line, 'mail' AS label FROM lines_of WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}')
  UNION ALL SELECT path, line, 'debug switch' FROM lines_of WHERE regexp_matches(text, 'debug\\s*[:=]\\s*true'))
SELECT * FROM h WHERE NOT (label = 'debug switch' AND path LIKE '%/conf/%')""")
def lint_policy(spark, sf):
    df = view(spark, sf, "f1_code")
    exceptions = df.filter("path LIKE '%/conf/%'").select("path", F.lit("debug switch").alias("label"))
    return de.lint_lines(df, [("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), ("debug switch", r"debug\s*[:=]\s*true")], exceptions)


@query("pattern_recall", "A19", """
SELECT source AS family, count(*) AS samples, count(*) FILTER (WHERE (source = 'src1' AND regexp_matches(text, 'the')) OR (source = 'src2' AND regexp_matches(text, '[0-9]{3}')) OR (source <> 'src2' AND contains(text, 'er'))) AS hits
FROM documents GROUP BY source""")
def pattern_recall(spark, sf):
    docs = view(spark, sf, "documents").select(F.col("source").alias("family"), "text")
    patterns = docs.select("family").distinct().withColumn("pattern", F.explode(F.expr(
        "CASE family WHEN 'src1' THEN array('the', 'er') WHEN 'src2' THEN array('[0-9]{3}') ELSE array('er') END")))
    return de.pattern_recall(docs, patterns).select("family", "samples", "hits")


UNITS = "unit_files AS (SELECT path, concat('UNIT-', doc_id % 90) AS unit_id FROM f1_code)"


@query("detector_seeds", "J23", f"""
WITH {HITS}, {UNITS}, placed AS (SELECT u.unit_id, concat(h.path, ':', h.line, ' ', h.detector) AS seed FROM hits h JOIN unit_files u ON u.path = h.path)
SELECT * FROM placed UNION ALL SELECT DISTINCT unit_id, 'no detector candidates' FROM unit_files WHERE unit_id NOT IN (SELECT unit_id FROM placed)""")
def detector_seeds(spark, sf):
    units = view(spark, sf, "f1_code").selectExpr("path", "concat('UNIT-', doc_id % 90) AS unit_id")
    return de.seeds_per_unit(_hits(spark, sf), units)


@query("signal_near_locus", "J8", f"""
WITH {HITS}, loci AS (SELECT doc_id AS slot, path, 1 + doc_id % 90 AS line FROM f1_code)
SELECT slot, EXISTS (SELECT 1 FROM hits h WHERE h.path = l.path AND abs(h.line - l.line) <= 40) AS signal FROM loci l""")
def signal_near_locus(spark, sf):
    loci = view(spark, sf, "f1_code").selectExpr("doc_id AS slot", "path", "1 + doc_id % 90 AS line")
    return de.signal_near(loci, _hits(spark, sf)).select("slot", "signal")


def _snapshots(spark, sf):
    before = view(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return before, view(spark, sf, "f7")


@query("changed_files", "J22", """
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM documents b FULL OUTER JOIN f7 a ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.content <> b.text""")
def changed_files(spark, sf):
    before, after = _snapshots(spark, sf)
    return sn.changed_files(before, after, "doc_id")


@query("added_lines", "J22", """
SELECT doc_id, len(string_split(text, chr(10))) + 1 AS line, concat('added ( line ', doc_id) AS text FROM documents WHERE doc_id % 7 = 0 AND doc_id % 13 <> 0""")
def added_lines(spark, sf):
    before, after = _snapshots(spark, sf)
    return sn.added_lines(before, after, "doc_id")


@query("snapshot_health", "X21", """
SELECT doc_id, CAST(1 AS BIGINT) AS worse, false AS json_broken FROM documents WHERE doc_id % 7 = 0 AND doc_id % 13 <> 0""")
def snapshot_health(spark, sf):
    before, after = _snapshots(spark, sf)
    health = sn.snapshot_health(before, after, "doc_id")
    return health.select("doc_id", (F.col("balance_after") - F.col("balance_before")).alias("worse"), "json_broken")


@query("bracket_balance", "X21", """
WITH b AS (SELECT doc_id, concat(repeat('(', CAST(doc_id % 5 AS INTEGER)), repeat(']', CAST(doc_id % 3 AS INTEGER)), repeat(')', CAST(doc_id % 7 AS INTEGER)), '{"k":', doc_id % 2, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '}' END) AS t FROM documents)
SELECT doc_id, abs(doc_id % 5 - doc_id % 7) + doc_id % 3 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS score FROM b""")
def bracket_balance(spark, sf):
    text = F.expr("concat(repeat('(', int(doc_id % 5)), repeat(']', int(doc_id % 3)), repeat(')', int(doc_id % 7)), '{\"k\":', doc_id % 2, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '}' END)")
    return view(spark, sf, "documents").select("doc_id", sn.delimiter_balance(text).alias("score"))


@query("manifest_count", "J19", "SELECT count(*) AS listed, count(*) = (SELECT count(*) FROM labels) AS count_ok FROM documents")
def manifest_count(spark, sf):
    return sn.manifest_count_ok(view(spark, sf, "documents"), view(spark, sf, "labels").count())


@query("verify_manifest", "J19", """
SELECT path, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'hash mismatch' ELSE 'size drift' END AS problem FROM f1 WHERE doc_id % 17 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0""")
def verify_manifest(spark, sf):
    f1 = view(spark, sf, "f1")
    manifest = f1.select(
        "path", F.expr("CASE WHEN doc_id % 11 = 0 THEN sha2('x', 256) ELSE sha2(content, 256) END").alias("sha256"),
        F.expr("octet_length(content) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END").alias("size"))
    return sn.verify_manifest(f1.filter("doc_id % 17 <> 0"), manifest)


@query("locus_drift", "J18", f"""
WITH slots AS (SELECT doc_id AS slot, path, 1 + doc_id % 3 AS line FROM f1), lined AS (SELECT doc_id, path, string_split(content, chr(10)) AS ls FROM f1)
SELECT s.slot, s.slot % 5 = 0 OR s.line > len(l.ls) AS drift FROM slots s JOIN lined l ON l.path = s.path""")
def locus_drift(spark, sf):
    f1 = view(spark, sf, "f1")
    line = F.try_element_at(fn.split_lines("content"), (1 + F.col("doc_id") % 3).cast("int"))
    slots = f1.select(
        F.col("doc_id").alias("slot"), "path", (1 + F.col("doc_id") % 3).alias("line"), F.lit(False).alias("historical"),
        F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(F.coalesce(line, F.lit("gone")), 256)).alias("mutation_sha256"))
    return sn.locus_drift(slots, f1).select("slot", "drift")
