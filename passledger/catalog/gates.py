"""Expectation suites over the generated tables: sound inputs with defects planted by key arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from passledger import functions as fn
from passledger.catalog import query
from passledger.expect import card, documents, run
from passledger.expect.core import accepted
from passledger.expect.report import ReportTables, report_suite
from passledger.session import cut
from passledger.views import derive, view

# -- report contract --------------------------------------------------------------------------------
REPORT_ROWS = """
SELECT l_partkey % 20 AS doc_id, l_linenumber AS pos, finding_id AS id, CASE WHEN l_orderkey % 211 = 0 THEN 'INFO' ELSE final_severity END AS severity,
  CASE WHEN l_orderkey % 251 = 0 THEN '.claude' ELSE split_part(path, '/', 1) END AS repo,
  CASE WHEN l_orderkey % 223 = 0 THEN 'f.py' WHEN l_orderkey % 257 = 0 THEN '/abs/f.py:3' ELSE concat('m/f.py:', line) END AS path,
  CASE WHEN l_orderkey % 227 = 0 THEN concat(title, '...') WHEN l_orderkey % 241 = 0 THEN 'ssl store opened with password=Zq81mmt4x' ELSE title END AS title,
  CASE WHEN l_orderkey % 229 = 0 THEN 'CWE-0' ELSE 'CWE-79' END AS cwe_canonical,
  CASE WHEN l_orderkey % 233 = 0 THEN 'fix it' ELSE 'Enforce an ownership check before acting.' END AS fix,
  CASE WHEN l_orderkey % 239 = 0 THEN 'not allowed here' END AS pc_reason, l_orderkey
FROM findings WHERE status <> 'refuted'"""
REPORT_HOPS = "SELECT conv_id % 20 AS doc_id, conv_id AS chain_pos, turn AS hop_pos, CASE WHEN conv_id % 6 = 0 THEN 'nowhere' ELSE 'known' END AS finding_id FROM conversations"


def _report_tables(spark, sf):
    # stored once: the declared counts, the known ids and three rules of the suite start from the rows
    rows = cut(derive(spark, sf, REPORT_ROWS).withColumn("also_affects", F.expr("CASE WHEN l_orderkey % 263 = 0 THEN array('/abs.yaml:3') END")), "zstd")
    known = rows.groupBy("doc_id").agg(F.min("id").alias("known"))
    hops = derive(spark, sf, REPORT_HOPS).join(known, "doc_id").withColumn("finding_id", F.when(F.col("finding_id") == "known", F.col("known")).otherwise(F.col("finding_id"))).drop("known")
    chains = hops.groupBy("doc_id", "chain_pos").agg(F.count("*").cast("int").alias("n_hops")).withColumns(
        {"id": F.col("chain_pos").cast("string"), "title": F.lit("t"), "status": F.expr("CASE WHEN chain_pos % 10 = 4 THEN 'narrative' ELSE 'confirmed' END")})
    per = rows.groupBy("doc_id").agg(F.count_if(F.col("severity") != "INFO").alias("n"), *[F.count_if(F.col("severity") == s).alias(k) for s, k in (("CRITICAL", "critical"), ("HIGH", "high"), ("MEDIUM", "medium"), ("LOW", "low"))])
    n_chains = chains.groupBy("doc_id").agg(F.count("*").alias("declared_chains"))
    docs = per.join(n_chains, "doc_id", "left").select(
        "doc_id", F.expr("concat('APP', doc_id, CASE WHEN doc_id = 7 THEN '.json' ELSE '_SCAN_REPORT.json' END)").alias("file_name"), F.lit(True).alias("is_object"),
        F.expr("CASE WHEN doc_id = 5 THEN '1.0' ELSE '2.0' END").alias("schema_version"), F.expr("concat('APP', doc_id)").alias("app_id"),
        F.expr("CASE WHEN doc_id = 6 THEN '<name>' ELSE 'Example' END").alias("app_name"), F.lit("estate").alias("estate"), F.expr("CASE WHEN doc_id <> 8 THEN '1.0' END").alias("scanner_version"),
        F.expr("n + CASE WHEN doc_id = 3 THEN 1 ELSE 0 END").alias("total"), F.lit(0).cast("bigint").alias("pc"), "critical", F.expr("high - CASE WHEN doc_id = 4 THEN 1 ELSE 0 END").alias("high"), "medium", "low",
        F.expr("coalesce(declared_chains, 0)").alias("declared_chains"))
    return ReportTables(docs, rows, chains, hops)


@query("report_suite", "G1", f"""
WITH r AS ({REPORT_ROWS}), h AS (SELECT conv_id % 20 AS doc_id, conv_id, count(*) AS n FROM conversations GROUP BY ALL),
v AS (
  SELECT doc_id, 'R07' AS rule, count(*) AS n FROM r WHERE severity = 'INFO' GROUP BY 1
  UNION ALL SELECT doc_id, 'R09', count(*) FROM r WHERE repo = '.claude' GROUP BY 1
  UNION ALL SELECT doc_id, 'R08', count(*) FROM r WHERE path = 'f.py' OR path LIKE '/%' GROUP BY 1
  UNION ALL SELECT doc_id, 'R10', count(*) FROM r WHERE title LIKE '%...' GROUP BY 1
  UNION ALL SELECT doc_id, 'R18', count(*) FROM r WHERE title LIKE 'ssl %' GROUP BY 1
  UNION ALL SELECT doc_id, 'R11', count(*) FROM r WHERE cwe_canonical = 'CWE-0' GROUP BY 1
  UNION ALL SELECT doc_id, 'R17', count(*) FROM r WHERE fix = 'fix it' GROUP BY 1
  UNION ALL SELECT doc_id, 'R12', count(*) FROM r WHERE pc_reason IS NOT NULL GROUP BY 1
  UNION ALL SELECT doc_id, 'R16', count(*) FROM r WHERE l_orderkey % 263 = 0 GROUP BY 1
  UNION ALL SELECT doc_id, 'R06', count(*) FROM (SELECT doc_id, id FROM r GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT doc_id, 'R14', count(*) FROM h WHERE conv_id % 10 = 4 GROUP BY 1
  UNION ALL SELECT doc_id, 'R15', CAST(sum(CASE WHEN n < 2 THEN 1 ELSE 0 END + CASE WHEN conv_id % 6 = 0 THEN n ELSE 0 END) AS BIGINT) FROM h WHERE n < 2 OR conv_id % 6 = 0 GROUP BY 1
  UNION ALL SELECT 3, 'R13', 2 UNION ALL SELECT 4, 'R13', 2 UNION ALL SELECT 5, 'R01', 1 UNION ALL SELECT 6, 'R02', 1 UNION ALL SELECT 7, 'R03', 1 UNION ALL SELECT 8, 'R02', 1)
SELECT doc_id, rule, n FROM v""")
def report_suite_query(spark, sf):
    return report_suite(_report_tables(spark, sf)).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


# -- run certification ------------------------------------------------------------------------------
RECEIPTS = """
SELECT c_custkey AS run_id,
  concat('{"files_opened":', c_custkey + CASE WHEN v = 1 THEN 1 ELSE 0 END, ',"census_files":', CASE WHEN v = 2 THEN '"x"' ELSE CAST(c_custkey AS STRING) END, ',"units":2,"units_quiet":', CASE WHEN v = 3 THEN 1 ELSE 2 END,
   ',"plants_found":', CASE WHEN v = 4 THEN 6 ELSE 7 END, ',"plants_cured":1,"canary_historical":', CASE WHEN v = 5 THEN 0 ELSE 4 END, ',"priors_staged":', CASE WHEN v = 6 THEN 0 ELSE 6 END,
   ',"priors_refound":', CASE WHEN v = 7 THEN 3 ELSE 4 END, ',"priors_refound_verified":3,"priors_refound_refuted":', CASE WHEN v = 8 THEN 0 ELSE 1 END, ',"priors_refound_folded":0,"priors_not_evidenced":2,"priors_not_evidenced_receipted":', CASE WHEN v = 9 THEN 1 ELSE 2 END,
   ',"lane_deaths":1,"lane_redispatched":1', CASE WHEN v = 10 THEN '' WHEN v = 11 THEN ',"lane_deaths_unreconciled":1' ELSE ',"lane_deaths_unreconciled":0' END, ',"orphans":', CASE WHEN v = 12 THEN 1 ELSE 0 END,
   CASE WHEN v = 13 THEN '' ELSE ',"disposition_receipt_present":true' END, ',"disposition_receipt_schema":"', CASE WHEN v = 14 THEN 'dispositions/v0' ELSE 'dispositions/v1' END, '"',
   CASE WHEN v = 15 THEN ',"planted_file_candidates":5,"candidates_dispositioned":4' WHEN v = 16 THEN ',"planted_file_candidates":5,"candidates_dispositioned":5,"dispositions_unresolved":1' ELSE '' END, '}') AS receipt,
  CASE WHEN v = 17 THEN 'no gates here' WHEN v = 18 THEN 'SCAN-REPORT GATE: PASS a.json' ELSE concat('SEAL-CARD gate: PASS - SEAL-TOKEN: 0123456789abcdef', chr(10), 'SCAN-REPORT GATE: PASS a.json') END AS completion
FROM (SELECT c_custkey, c_custkey % 20 AS v FROM customer)"""
RUN_RULES = "(1, 'C1'), (2, 'C0'), (3, 'C2'), (4, 'C3'), (5, 'C3'), (7, 'C4'), (7, 'C4'), (8, 'C4'), (9, 'C4'), (10, 'C0'), (11, 'C5'), (12, 'C5'), (13, 'C5'), (14, 'C5'), (15, 'C5'), (16, 'C5'), (17, 'C6'), (17, 'C6'), (18, 'C6')"


def _metrics(spark, sf):
    return run.receipt_columns(derive(spark, sf, RECEIPTS))


@query("run_suite", "G2", f"SELECT c_custkey AS run_id, r.rule, count(*) AS n FROM customer JOIN (VALUES {RUN_RULES}) r(v, rule) ON c_custkey % 20 = r.v GROUP BY ALL")
def run_suite_query(spark, sf):
    return run.run_suite(_metrics(spark, sf)).groupBy("run_id", "rule").agg(F.count("*").alias("n"))


@query("run_accepted", "G2", f"""
SELECT c_custkey AS run_id, count(r.rule) AS violations, count(r.rule) = 0 AS accepted FROM customer LEFT JOIN (VALUES {RUN_RULES}) r(v, rule) ON c_custkey % 20 = r.v GROUP BY c_custkey""")
def run_accepted(spark, sf):
    m = _metrics(spark, sf)
    return accepted(m, run.run_suite(m), "run_id")


@query("check_rollup", "G9", f"""
SELECT c.c_custkey AS run_id, k.rule AS check, CASE WHEN f.v IS NOT NULL THEN 'fail' WHEN k.rule = 'C4' AND c_custkey % 20 IN (6, 2) THEN CASE WHEN c_custkey % 20 = 6 THEN 'not-applicable' ELSE 'ok' END ELSE 'ok' END AS state
FROM customer c CROSS JOIN (VALUES ('C1'), ('C2'), ('C3'), ('C4'), ('C5'), ('C6')) k(rule) LEFT JOIN (SELECT DISTINCT * FROM (VALUES {RUN_RULES}) r(v, rule)) f ON f.v = c.c_custkey % 20 AND f.rule = k.rule""")
def check_rollup(spark, sf):
    m = _metrics(spark, sf)
    return run.check_rollup(m, run.run_suite(m)).select("run_id", "check", "state")


# -- summary cards ----------------------------------------------------------------------------------
# One card per customer, its numbers taken from the row. Each variant gives one field a value that a rule refuses (or still
# accepts), by arithmetic on the same numbers.
_K, _A, _N = "c_custkey", "abs(CAST(floor(c_acctbal) AS BIGINT))", "c_nationkey"
_TIERS = {"TIER-C": f"{_K} % 3", "TIER-H": f"1 + {_N} % 4", "TIER-WP": f"{_K} % 2", "TIER-M": f"{_A} % 60", "TIER-L": f"{_N}", "TIER-INFO": f"{_A} % 7"}
_TOTAL = " + ".join(f"({e})" for e in _TIERS.values())
_FILES = f"40 + {_A} % 900"
_DEAD = f"{_K} % 4"


def _line(*parts: str) -> str:
    """SQL of a value: literal texts and, in parentheses, number expressions."""
    return "concat(" + ", ".join(f"CAST({p} AS VARCHAR(40))" if p.startswith("(") else f"'{p}'" for p in parts) + ")"


CARD = {
    "RUN-ID": _line("card-", f"({_K})"), "KIT": _line("kit ", f"({_N})"), "ROWS-TOTAL": _line(f"({_TOTAL})"), "VERIFIED-TOTAL": _line(f"({_TIERS['TIER-H']})"),
    "REFUTED-TOTAL": _line(f"({_A} % 11)"), **{k: _line(f"({e})") for k, e in _TIERS.items()}, "CH-COURTED": _line(f"({_TIERS['TIER-C']} + {_TIERS['TIER-H']})"),
    "PC-1": _line("0"), "PC-2": _line(f"({_N} % 6)"), "BOUND-MIN": _line("0.", f"(96 + {_K} % 3)"), "UNITS": _line("2"), "CANARY": _line("8/8"),
    "DURATION": _line(f"(1 + {_N})", " min"), "DENIALS": _line(f"({_N} % 3)", "; result impact: ZERO"), "VISITATION": _line(f"({_FILES})", "/", f"({_FILES})"),
    "SEAL-CLASS": _line("CERTIFIED"), "FIRST-COURT-LAG": _line(f"({_N})"), "CENSUS-FORM": _line("FLAT-PIPELINE"), "EXPECTED-CLOCK": _line(f"(2 + {_N})", " lanes"), "MODE": _line("CODE"),
    "STRICT-CHAPMAN": _line("U1 0.", f"(60 + {_K} % 40)", " U12 0.", f"(50 + {_N})"),
    "LAP-HISTORY": _line("1 bound 0.4 novelCH ", f"({_A} % 90)"), "LAP-HISTORY ": _line("2 bound 0.7 novelCH ", f"({_N} % 3)"), "LAP-HISTORY  ": _line("3 bound 0.8 novelCH ", f"({_K} % 3)"),
    "CANARY-MIX": _line("3P+5H"), "FALSIFIERS": _line("run ", f"({_N})", "/", f"({_N})"), "M-AUDIT": _line(f"({_N})", "/", f"({_N})", " re-derived seed=", f"(10000000 + {_K})"),
    "DEPTH-RATIO": _line("0.", f"(10 + {_N})"), "REACH-DISCIPLINE": _line(f"({_N})", "/", f"({_N})"), "WIDTH-DISCIPLINE": _line(f"(3 + {_N})", "/", f"(3 + {_N})"),
    "PULSE-LEDGER": _line("max-gap ", f"({_N})", "m deaths ", f"({_DEAD})", " redispatched ", f"({_DEAD})"), "PRIORS": _line(f"({_A} % 20)", " loaded ", f"({_A} % 20)", " refound-or-adjudicated"),
    "FRONTIER-CLOSE": _line(f"({_N})", "m"), "SATURATION": _line("avg 2.", f"({_N} % 10)", "/3 idle-while-ready ", f"({_N} % 6)", "m"), "ENGINE": _line("ONE-QUEUE"),
    "AXIS-CENSUS": _line(f"(1 + {_N})", " declared, all exhausted"), "AXIS-CLOSURE": _line(f"(1 + {_N})", "/", f"(1 + {_N})"), "DISPOSITION": _line("none open"),
    "TERMINAL-PRECEDENCE": _line("ran ", f"(10 + {_N} % 10)", ":30Z pre-assembly verdict CERTIFY"),
    "SEAL-ENTRY": _line("ran ", f"(10 + {_N} % 10)", ":20Z census ", f"({_FILES})", " conservation ", f"({_TOTAL})", "==", f"({_TOTAL})", " canaries 8 OPENED"), "CLOSURE-BASIS": _line("STANDARD-095"),
}
DEFECTS = [  # (variant, field, its value, refused stage, rule); a null stage is an accepted card
    (1, "TIER-M", _line(f"({_TIERS['TIER-M']} + 1 + {_N})"), 4, "tiers"), (2, "CANARY", _line(f"({_N})", "/9"), 8, "slots"), (3, "SEAL-CLASS", _line("ASSESSMENT"), 7, "assess-receipt"),
    (4, "PULSE-LEDGER", _line("max-gap 3m deaths ", f"({_DEAD} + {_N})", " redispatched ", f"({_DEAD})", " adopted ", f"({_N})", " unreconciled 0"), None, None),
    (5, "PULSE-LEDGER", _line("max-gap 3m deaths ", f"({_DEAD} + 1)", " redispatched ", f"({_DEAD})"), 11, "ledger"), (6, "SEAL-CLASS", _line("BLOCKED-UNCERTIFIED"), 7, "block"),
    (7, "STRICT-CHAPMAN", _line("U7 0.", f"(10 + {_N})", " U8 0.9"), 11, "strict"), (8, "CANARY-MIX", _line(f"(5 + {_K} % 3)", "P+", f"(3 - {_K} % 3)", "H"), 11, "mix"),
    (9, "PC-1", _line(f"(1 + {_N})"), 11, "receipts"), (10, "WIDTH-DISCIPLINE", _line(f"(2 + {_N})", "/", f"(3 + {_N})"), 11, "width"),
    (11, "PRIORS", _line(f"(1 + {_A} % 20)", " loaded ", f"({_A} % 20)", " refound-or-adjudicated"), 11, "priors"), (12, "SATURATION", _line("avg 1.0/3 idle-while-ready ", f"(6 + {_N})", "m"), 11, "saturation"),
    (13, "LAP-HISTORY  ", _line("3 bound 0.8 novelCH ", f"(3 + {_N})"), 12, "closure"), (14, "VISITATION", _line(f"({_FILES} - 1)", "/", f"({_FILES})"), 10, "visitation"),
    (15, "CANARY", _line(f"({_N} % 8)", "/8"), 10, "slot-miss"), (16, "TERMINAL-PRECEDENCE", _line("ran 09:09Z pre-assembly verdict CONTINUE"), 10, "precedence"),
    (17, "SEAL-ENTRY", _line("ran 09:08Z census 1 conservation ", f"({_TOTAL})", "==", f"({_TOTAL} + 1)", " canaries 8 OPENED"), 10, "entry-conservation"),
    (18, "SEAL-ENTRY", _line("ran 09:08Z census 1 conservation ", f"({_TOTAL})", "==", f"({_TOTAL})"), 10, "entry-slots"), (19, "AXIS-CLOSURE", _line(f"(1 + {_N})", "/", f"(2 + {_N})"), 11, "axes"),
    (20, "ENGINE", None, 1, "fields"), (21, "VERIFIED-TOTAL", _line(f"({_TOTAL} + 1 + {_N})"), 3, "verified"),
    (22, "STRICT-CHAPMAN", _line("U7 0.", f"(10 + {_N})", chr(10) + "CURE-LAP: U07"), None, None), (23, "STRICT-CHAPMAN", _line("U07 0.", f"(10 + {_N})", chr(10) + "CURE-LAP: U7"), 11, "strict"),
]
VARIANTS = 26


def _card_sql() -> str:
    """Each field's line; a variant's defect replaces it, or leaves the line out."""
    lines = []
    for field, value in CARD.items():
        line = lambda v, f=field.strip(): "''" if v is None else f"concat('{f}: ', {v}, chr(10))"
        cases = " ".join(f"WHEN {v} THEN {line(other)}" for v, at, other, _, _ in DEFECTS if at == field)
        lines.append(f"CASE {_K} % {VARIANTS} {cases} ELSE {line(value)} END" if cases else line(value))
    return f"SELECT {_K} AS card_id, concat({', '.join(lines)}) AS text FROM customer"


CARDS = _card_sql()
CARD_RULES = ", ".join(f"({v}, {s}, '{r}')" for v, _, _, s, r in DEFECTS if s) + ", (19, 11, 'axes')"


@query("card_suite", "G3", f"SELECT c_custkey AS card_id, r.stage, r.rule, count(*) AS n FROM customer JOIN (VALUES {CARD_RULES}) r(v, stage, rule) ON c_custkey % {VARIANTS} = r.v GROUP BY ALL")
def card_suite_query(spark, sf):
    return card.card_suite(derive(spark, sf, CARDS)).groupBy("card_id", "stage", "rule").agg(F.count("*").alias("n"))


@query("card_tokens", "X22 G3", f"""
WITH c AS ({CARDS}) SELECT card_id, 'CERTIFIED' AS seal_class, substring(sha256(concat(text, '|CERTIFIED-PASS')), 1, 16) AS token FROM c WHERE card_id % {VARIANTS} IN (0, 4, 22, 24, 25)""")
def card_tokens(spark, sf):
    cards = derive(spark, sf, CARDS)
    return card.card_tokens(cards, card.card_suite(cards))


# -- documents --------------------------------------------------------------------------------------
TOKEN_DOCS = """
SELECT conv_id * 100 + turn AS doc_id, concat(text, chr(10), CASE WHEN turn % 4 = 0 THEN '' ELSE concat('SEAL-CLOCK: ', CASE WHEN turn % 4 = 1 THEN 'pending review' ELSE '14:05' END, chr(10)) END,
  CASE WHEN conv_id % 3 = 0 THEN 'RESULT-SET: to be decided' WHEN conv_id % 3 = 1 THEN concat('see RESULT-SET:', turn) ELSE 'X-RESULT-SET: 5' END) AS text FROM conversations"""


@query("token_suite", "G4 X19", """
SELECT conv_id * 100 + turn AS doc_id, 'SEAL-CLOCK' AS token, CASE WHEN turn % 4 = 0 THEN 'missing' ELSE 'promissory' END AS problem FROM conversations WHERE turn % 4 < 2
UNION ALL SELECT conv_id * 100 + turn, 'RESULT-SET', CASE WHEN conv_id % 3 = 0 THEN 'promissory' ELSE 'missing' END FROM conversations WHERE conv_id % 3 <> 1""")
def token_suite(spark, sf):
    return documents.token_suite(derive(spark, sf, TOKEN_DOCS), ["SEAL-CLOCK", "RESULT-SET"])


@query("token_values", "X19", """
SELECT conv_id * 100 + turn AS doc_id, CASE WHEN turn % 4 = 1 THEN ' pending review' WHEN turn % 4 > 1 THEN ' 14:05' END AS clock, turn % 4 = 1 AS promissory FROM conversations""")
def token_values(spark, sf):
    docs = derive(spark, sf, TOKEN_DOCS).select("doc_id", fn.token_value(F.col("text"), "SEAL-CLOCK").alias("clock"))
    return docs.select("doc_id", "clock", fn.is_promissory("clock").alias("promissory"))


@query("priors_suite", "G5 S5", """
WITH t AS (SELECT slot, slot % 50 AS doc_id FROM f5)
SELECT doc_id, 'missing-title' AS rule, count(*) AS n FROM t WHERE slot % 43 = 0 GROUP BY 1 UNION ALL SELECT doc_id, 'family', count(*) FROM t WHERE slot % 47 = 0 GROUP BY 1
UNION ALL SELECT doc_id, 'path', count(*) FROM t WHERE slot % 53 = 0 GROUP BY 1 UNION ALL SELECT doc_id, 'duplicate', 1 FROM t WHERE doc_id % 10 = 3 GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT doc_id, 'tag', 1 FROM t WHERE doc_id = 9 UNION ALL SELECT 51, 'empty', 1""")
def priors_suite(spark, sf):
    t = derive(spark, sf, "SELECT slot % 50 AS doc_id, CASE WHEN slot % 50 % 10 = 3 THEN 'SAME' ELSE id END AS id, CASE WHEN slot % 53 = 0 THEN concat('../', path) ELSE path END AS path, CASE WHEN slot % 47 = 0 THEN 'L9' ELSE family END AS family, CASE WHEN slot % 43 = 0 THEN ' ' ELSE title END AS title FROM f5")
    heads = t.select("doc_id").distinct().unionByName(t.agg((F.max("doc_id") * 0 + 51).alias("doc_id"))).withColumn(
        "schema", F.expr("CASE WHEN doc_id = 9 THEN 'old' ELSE 'priors/v1' END"))
    return documents.priors_suite(t, heads).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


@query("key_suite", "G6 U7 A24", """
WITH s AS (SELECT p_partkey // 8 AS key_id, p_partkey AS k FROM part), c AS (SELECT key_id, count(*) AS n FROM s GROUP BY 1)
SELECT key_id, 'size' AS rule, 1 AS n FROM c WHERE key_id % 9 = 4 UNION ALL SELECT key_id, 'slots', 1 FROM c WHERE key_id % 9 = 4 UNION ALL SELECT key_id, 'spread', 1 FROM c WHERE key_id % 9 = 4
UNION ALL SELECT key_id, 'placement', 1 FROM c WHERE key_id % 11 = 5 UNION ALL SELECT key_id, 'loci', 1 FROM c WHERE key_id % 11 = 5 AND NOT EXISTS (SELECT 1 FROM s WHERE s.key_id = c.key_id AND s.k % 8 IN (2, 6) AND s.k % 37 = 3)
UNION ALL SELECT key_id, 'reason', count(*) FROM s WHERE k % 31 = 2 AND NOT (key_id % 9 = 4 AND k % 8 = 7) GROUP BY 1
UNION ALL SELECT key_id, 'outside', count(*) FROM s WHERE k % 37 = 3 AND NOT (key_id % 9 = 4 AND k % 8 = 7) GROUP BY 1
UNION ALL SELECT key_id, 'unchanged', count(*) FROM s WHERE k % 41 = 6 AND NOT (key_id % 9 = 4 AND k % 8 = 7) AND NOT (key_id % 11 = 5 AND k % 8 IN (2, 6)) GROUP BY 1
UNION ALL SELECT key_id, 'cover', 1 FROM c WHERE key_id % 13 = 7 UNION ALL SELECT key_id, 'marker', count(*) FROM s WHERE k % 43 = 8 GROUP BY 1""")
def key_suite(spark, sf):
    base = derive(spark, sf, "SELECT slot DIV 8 AS key_id, slot AS k, CAST(1 + slot % 8 AS BIGINT) AS slot, family FROM f5")
    slots = base.filter("NOT (key_id % 9 = 4 AND k % 8 = 7)").selectExpr(
        "key_id", "slot", "family", "CASE WHEN key_id % 11 = 5 AND k % 8 IN (2, 6) THEN concat('k', key_id, '/same.py') ELSE concat('k', key_id, '/f', k, '.py') END AS path",
        "CASE WHEN k % 37 = 3 THEN 500 WHEN key_id % 11 = 5 AND k % 8 IN (2, 6) THEN 9 ELSE 10 + slot END AS line", "CASE WHEN k % 31 = 2 THEN 'short' ELSE 'called from the login route' END AS reachability", "k")
    files = slots.select("path").distinct().withColumn("lines", F.lit(100))
    changed = slots.filter("k % 41 <> 6 OR path LIKE '%same.py'").select("key_id", "path").unionByName(
        slots.filter("key_id % 13 = 7 AND slot = 1").select("key_id", F.lit("stray.py").alias("path")))
    added = base.selectExpr("key_id", "concat('f', k) AS path", "CASE WHEN k % 43 = 8 THEN 'planted here' ELSE 'x = 1' END AS text")
    return documents.key_suite(slots, files, changed, added, forbidden="(?i)planted").groupBy("key_id", "rule").agg(F.count("*").alias("n"))


@query("run_completeness", "G7", """
SELECT s_suppkey AS run_id, concat('missing ', n.name) AS problem FROM supplier JOIN (VALUES (0, 'COMPLETION.md'), (1, 'FINDINGS.md'), (2, 'findings.jsonl'), (3, 'candidates.jsonl')) n(i, name) ON s_suppkey % 9 = n.i
UNION ALL SELECT s_suppkey, 'staging not deleted' FROM supplier WHERE s_suppkey % 7 = 3 UNION ALL SELECT s_suppkey, 'no recall line' FROM supplier WHERE s_suppkey % 5 = 1 UNION ALL SELECT s_suppkey, 'target changed' FROM supplier WHERE s_suppkey % 6 = 2""")
def run_completeness(spark, sf):
    runs = derive(spark, sf, "SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 5 = 1 THEN 'nothing' WHEN s_suppkey % 5 = 2 THEN 'RECALL: EXTERNAL-PENDING' ELSE 'RECALL: 7/8 (FAIL)' END AS completion, 'a' AS baseline_fingerprint, CASE WHEN s_suppkey % 6 = 2 THEN 'b' ELSE 'a' END AS current_fingerprint FROM supplier")
    names = runs.select("run_id", F.posexplode(F.array(*[F.lit(n) for n in ("COMPLETION.md", "FINDINGS.md", "findings.jsonl", "candidates.jsonl", "staging")])).alias("i", "name"))
    artifacts = names.filter("run_id % 9 <> i AND (name <> 'staging' OR run_id % 7 = 3)")
    extra = names.filter("name = 'staging' AND run_id % 7 = 3 AND run_id % 9 = 4")
    return run.completeness(artifacts.unionByName(extra), runs)


@query("mint_mix", "G8", """
WITH s AS (SELECT p_partkey // 12 AS run_id, p_partkey % 12 AS i FROM part WHERE NOT (p_partkey // 12 % 4 = 1 AND p_partkey % 12 = 11)),
t AS (SELECT run_id, i >= 8 AS historical, CASE WHEN run_id % 5 = 2 AND i = 0 THEN 1 ELSE i % 4 END AS f FROM s), r AS (SELECT DISTINCT p_partkey // 12 AS run_id FROM part)
SELECT r.run_id, 'too few historical slots' AS problem FROM r LEFT JOIN t ON t.run_id = r.run_id GROUP BY r.run_id HAVING count(*) FILTER (WHERE historical) < 4
UNION ALL SELECT r.run_id, concat('family spread ', n.name) FROM (SELECT DISTINCT run_id FROM t) r CROSS JOIN (VALUES (0, 'L1-auth'), (1, 'L2-secrets'), (2, 'L3-injection'), (3, 'L4-infra')) n(f, name)
  LEFT JOIN t ON t.run_id = r.run_id AND t.f = n.f AND NOT t.historical GROUP BY r.run_id, n.name HAVING count(t.f) <> 2""")
def mint_mix(spark, sf):
    s = derive(spark, sf, "SELECT p_partkey DIV 12 AS run_id, p_partkey % 12 AS i FROM part").filter("NOT (run_id % 4 = 1 AND i = 11)")
    slots = s.selectExpr("run_id", "i >= 8 AS historical", "CASE WHEN run_id % 5 = 2 AND i = 0 THEN 'L2-secrets' ELSE element_at(array('L1-auth', 'L2-secrets', 'L3-injection', 'L4-infra'), CAST(i % 4 + 1 AS INT)) END AS family")
    return run.mint_mix(slots, derive(spark, sf, "SELECT DISTINCT p_partkey DIV 12 AS run_id FROM part"))


@query("declared_totals", "J21", """
WITH f AS (SELECT l_suppkey AS run_id, finding_id, CASE WHEN status = 'conditional-court' THEN 'WP' ELSE final_severity END AS tier, status, l_partkey FROM findings WHERE status <> 'refuted')
SELECT run_id, 'reach' AS rule, count(*) AS n FROM f WHERE tier = 'CRITICAL' AND l_partkey % 10 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT run_id, 'tier_h', 1 FROM f WHERE run_id % 8 = 3 UNION ALL SELECT DISTINCT run_id, 'courted', 1 FROM f WHERE run_id % 9 = 4""")
def declared_totals(spark, sf):
    f = derive(spark, sf, "SELECT l_suppkey AS run_id, status, CASE WHEN status = 'conditional-court' THEN 'WP' ELSE final_severity END AS tier, 'd' AS reach_domain, CASE WHEN l_partkey % 10 = 0 THEN ' ' ELSE 's' END AS reach_stage, 'm' AS reach_method, 'a' AS reach_authorizer FROM findings")
    emitted = f.filter("status <> 'refuted'")
    judged = f.filter("status <> 'conditional'")
    d = emitted.groupBy("run_id").agg(F.count("*").alias("rows_total"), *[F.count_if(F.col("tier").startswith(p)).alias(f"tier_{c}") for c, p in (("c", "CRI"), ("h", "HIG"), ("m", "MED"), ("l", "LOW"))])
    d = d.join(judged.groupBy("run_id").agg(F.count("*").alias("courted")), "run_id").withColumn("tier_h", F.expr("tier_h + CASE WHEN run_id % 8 = 3 THEN 1 ELSE 0 END")).withColumn(
        "courted", F.expr("courted + CASE WHEN run_id % 9 = 4 THEN 1 ELSE 0 END"))
    return documents.declared_totals(emitted, judged, d).groupBy("run_id", "rule").agg(F.count("*").alias("n"))
