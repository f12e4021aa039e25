"""Input views over the generated tables.

One text per view; Spark runs it over parquet-backed DataFrames and the oracle inlines it as a CTE, so both
sides read the whole tables through the same projection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passledger.session import stored_bytes

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {
    # corpus with ordinary paths
    "f1": """
SELECT concat(source, '/', lang, '/doc_', doc_id,
         CASE WHEN doc_id % 5 = 0 THEN '.py' WHEN doc_id % 5 = 1 THEN '.yaml' WHEN doc_id % 5 = 2 THEN '.tf'
              WHEN doc_id % 5 = 3 THEN '.md' ELSE '' END) AS path,
       source AS repo, doc_id, text AS content
FROM documents""",
    # corpus with lockfiles, zones, staging files, special names and shebang scripts
    "f1_mixed": """
SELECT doc_id,
       CASE WHEN doc_id % 29 = 0 THEN concat('PRIORS_', doc_id, '.json')
            WHEN doc_id % 23 = 0 THEN concat(source, '/p', doc_id, '/package-lock.json')
            WHEN doc_id % 19 = 0 THEN concat('.docs/note', doc_id, '.md')
            WHEN doc_id % 17 = 0 THEN concat('OPTIONAL_PRIORS/p', doc_id, '.json')
            WHEN doc_id % 13 = 0 THEN concat(source, '/.git/objects/o', doc_id, '.py')
            WHEN doc_id % 11 = 0 THEN concat(source, '/Test/d', doc_id, '/Dockerfile')
            WHEN doc_id % 7 = 0 THEN concat('root_', doc_id, '.PY')
            ELSE concat(source, '/', lang, '/doc_', doc_id,
              CASE WHEN doc_id % 5 = 0 THEN '.py' WHEN doc_id % 5 = 1 THEN '.yaml' WHEN doc_id % 5 = 2 THEN '.tf'
                   WHEN doc_id % 5 = 3 THEN '.md' ELSE '' END) END AS path,
       CASE WHEN doc_id % 10 = 4 THEN concat('#!/bin/sh', chr(10), text) ELSE text END AS content
FROM documents""",
    # corpus whose files end in configuration and source idioms, one kind per document number
    "f1_code": """
SELECT doc_id,
       CASE WHEN doc_id % 37 = 0 THEN concat(source, '/gradle/w', doc_id, '/gradle-wrapper.properties')
            ELSE concat(CASE WHEN doc_id % 31 = 0 THEN 'vendor/' ELSE '' END, source, CASE doc_id % 8 WHEN 0 THEN '/src/test/f' WHEN 1 THEN '/conf/f' ELSE '/src/f' END, doc_id,
                 CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.properties' WHEN 2 THEN '.yml' WHEN 3 THEN '.gradle' WHEN 4 THEN '.js' ELSE '.txt' END) END AS path,
       concat(text, chr(10), CASE WHEN doc_id % 37 = 0 THEN concat('distributionUrl=https://x/g-', doc_id, '.zip') ELSE '' END, chr(10),
         CASE WHEN doc_id % 74 = 0 THEN 'distributionSha256Sum=abc' ELSE '' END, chr(10),
         CASE doc_id % 12 WHEN 0 THEN 'requests.get(url, verify = False)' WHEN 1 THEN '# debug = true' WHEN 2 THEN concat('db_password = "hunter', doc_id, '"')
              WHEN 3 THEN 'Access-Control-Allow-Origin: *' WHEN 4 THEN 'http.csrf().disable(); debug: true' WHEN 5 THEN '  // verify: false'
              WHEN 6 THEN 'x = obj.__proto__' WHEN 7 THEN 'spring=3.5.+' WHEN 8 THEN '! legacy=4.+' WHEN 9 THEN 'compile "y:z:latest.release"'
              WHEN 10 THEN 'Cipher.getInstance("AES/ECB")' ELSE 'plain words' END, chr(10)) AS content
FROM documents""",
    # raw observations
    "f2": """
SELECT concat('src', l_partkey % 20, '/m', l_partkey % 7, '/f', l_partkey, '.py') AS path,
       l_partkey, 1 + 5 * (l_orderkey % 40) AS line,
       CASE l_linenumber % 4 WHEN 0 THEN 'L1-auth' WHEN 1 THEN 'L2-secrets' WHEN 2 THEN 'L3-injection' ELSE 'L4-infra' END AS lens,
       CASE l_returnflag WHEN 'A' THEN 'sql-injection' WHEN 'N' THEN 'missing-authorization' ELSE 'hardcoded-credential' END AS category,
       CASE WHEN l_quantity > 48 THEN 'PRIORITIZED_CRITICAL' WHEN l_quantity > 42 THEN 'critical' WHEN l_quantity > 30 THEN 'HIGH'
            WHEN l_quantity > 15 THEN 'MEDIUM' WHEN l_quantity > 1 THEN 'LOW' ELSE 'INFO' END AS severity,
       1 + l_suppkey % 3 AS pass,
       concat('UNIT-00', 1 + l_partkey % 5) AS unit_id,
       l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice
FROM lineitem""",
    # valid observations with normalised severity, rank and the raw content-addressed id
    "f2_valid": """
SELECT path, l_partkey, CAST(line AS BIGINT) AS line, lens, category, upper(severity) AS severity,
       CAST(CASE upper(severity) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 5 END AS INT) AS sev_rank,
       CAST(pass AS BIGINT) AS pass, unit_id,
       concat('OBS-', substring({sha256:concat(path, chr(0), CAST(line AS STRING), chr(0), lower(category))}, 1, 16)) AS id,
       concat('claim ', l_orderkey, '-', l_linenumber) AS title,
       concat('seen by ', l_suppkey, ' qty ', CAST(CAST(l_quantity AS BIGINT) AS STRING)) AS evidence,
       concat('edge=e', l_suppkey % 7, ';route=r', l_linenumber) AS reach_basis,
       l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice
FROM f2 WHERE upper(severity) <> 'INFO'""",
    # the same observations as JSONL text with broken, mistyped and incomplete rows
    "lane_text": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       concat('lane-pass', pass, '-', lens, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('-', unit_id) END, '.jsonl') AS lane_file,
       CASE WHEN l_orderkey % 97 = 0 THEN '{"path": '
            WHEN l_orderkey % 89 = 0 THEN '[1, 2]'
            WHEN l_orderkey % 83 = 0 THEN concat('{"path":"', path, '","line":true,"lens":"', lens, '","category":"', category, '","severity":"HIGH","title":"t","evidence":"e","reach_basis":"r"}')
            WHEN l_orderkey % 79 = 0 THEN concat('{"path":"', path, '","line":', line, ',"lens":"', lens, '"}')
            WHEN l_orderkey % 73 = 0 THEN concat('{"path":"../', path, '","line":', line, ',"lens":"', lens, '","category":"', category, '","severity":"LOW","title":"t","evidence":"e","reach_basis":"r"}')
            ELSE concat('{"path":"', path, '","line":', line, ',"lens":"', lens, '","category":"', category, '","severity":"', severity, '","title":"t ', l_orderkey, '","evidence":"e","reach_basis":"r"}')
       END AS value
FROM f2""",
    "f3": """
SELECT DISTINCT concat('UNIT-00', 1 + l_partkey % 5) AS unit_id,
       concat('src', l_partkey % 20, '/m', l_partkey % 7, '/f', l_partkey, '.py') AS path
FROM lineitem""",
    "f4": """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'REFUTED' ELSE 'CONDITIONAL' END AS verdict,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM'
            WHEN '5-LOW' THEN 'LOW' ELSE 'HIGH' END AS severity,
       o_custkey, o_orderpriority
FROM orders""",
    "f5": """
SELECT p_partkey AS slot, concat('HIST-', p_partkey) AS id,
       CASE p_partkey % 4 WHEN 0 THEN 'L1-auth' WHEN 1 THEN 'L2-secrets' WHEN 2 THEN 'L3-injection' ELSE 'L4-infra' END AS family,
       CASE WHEN p_partkey % 11 = 0 THEN concat('gone/x', p_partkey, '.py')
            WHEN p_partkey % 5 = 0 THEN concat('old/f', p_partkey, '.py')
            ELSE concat('src', p_partkey % 20, '/m', p_partkey % 7, '/f', p_partkey, '.py') END AS path,
       CAST(1 + 4 * (p_size % 50) AS BIGINT) AS line, p_name AS title
FROM part""",
    "f6": """
SELECT event_id, ts, CASE WHEN user_id % 50 = 0 THEN ' ' ELSE concat('lane-', user_id) END AS lane,
       CASE event_type WHEN 'error' THEN 'lane-dead' WHEN 'signup' THEN 'lane-relaunched' WHEN 'purchase' THEN 'lane-adopted-empty' ELSE event_type END AS event,
       CAST(floor(value) AS BIGINT) AS size
FROM events""",
    "f7": """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, chr(10), 'added ( line ', doc_id) ELSE text END AS content
FROM documents WHERE doc_id % 13 <> 0""",
    "f8": """
SELECT 'labels' AS lane, doc_id AS item FROM labels UNION ALL SELECT 'benchmark' AS lane, item_id * 37 AS item FROM benchmark""",
    "f9": """
SELECT conv_id AS chain_id, turn AS hop_ord, conv_id * 200 + turn AS finding_key, role FROM conversations""",
    "f10": """
SELECT event_id, ts AS started_at, concat('model-', user_id % 3) AS model, CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'ok' END AS status,
       CAST(floor(value) AS BIGINT) AS output_tokens, user_id
FROM events""",
    # findings: raw valid observations with the verdict of their order
    "findings": """
SELECT v.*, o.verdict, o.severity AS verdict_severity, o.o_custkey,
       CASE WHEN v.sev_rank < 3 THEN 'conditional' WHEN o.verdict = 'VERIFIED' THEN 'verified'
            WHEN o.verdict = 'CONDITIONAL' THEN 'conditional-court' ELSE 'refuted' END AS status,
       CASE WHEN v.sev_rank < 3 THEN v.severity ELSE o.severity END AS final_severity,
       concat(v.l_orderkey, '-', v.l_linenumber, '-', v.l_partkey, '-', v.l_suppkey) AS finding_id,
       v.l_partkey % 97 = 0 AS synthetic
FROM f2_valid v JOIN f4 o ON o.o_orderkey = v.l_orderkey""",
}

_HASH = re.compile(r"\{sha256:(.*)\}, 1, 16\)\) AS id")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def view_text(name: str, dialect: str) -> str:
    text = VIEWS[name]
    call = "sha2(\\1, 256)" if dialect == "spark" else "sha256(\\1)"
    return _HASH.sub(call + ", 1, 16)) AS id", text)


def dependencies(text: str) -> list[str]:
    """Views named in ``text``, prerequisites first."""
    out: list[str] = []
    for word in dict.fromkeys(_WORD.findall(text)):
        if word in VIEWS:
            for need in dependencies(VIEWS[word]) + [word]:
                if need not in out:
                    out.append(need)
    return out


def with_views(sql: str) -> str:
    """DuckDB text: the needed views as CTEs before ``sql`` (which may start with its own WITH list)."""
    names = dependencies(sql)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({view_text(n, 'duckdb').strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"


#: Stored bytes for each core from which a table is split over all cores as it is read, in however few files it lies.
BYTES_FOR_A_CORE = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table stored in fewer files than cores over all cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(cores) if len(files) < cores and stored_bytes(df.sparkSession, files) < cores * BYTES_FOR_A_CORE else df


def fence(df: DataFrame) -> DataFrame:
    """Compute derived columns once per row: predicates on them are not pushed below the generator and re-evaluated."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spread(df)
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the stored times carry no zone and mean UTC
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in ntz}) if ntz else df


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL text that names views and base tables after FROM and JOIN."""
    used = {w for w in _WORD.findall(text) if w in VIEWS or w in TABLES}
    text = text.replace("{", "{{").replace("}", "}}")
    text = re.sub(r"\b(FROM|JOIN) ([a-z0-9_]+)\b", lambda m: f"{m.group(1)} {{{m.group(2)}}}" if m.group(2) in used else m.group(0), text)
    needed = {n: view(spark, sf_dir, n) for n in used if "{" + n + "}" in text}
    return spark.sql(text, **needed)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view (or base table) as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return derive(spark, sf_dir, view_text(name, "spark"))
