"""One query per operator over the given tables, with production parameters and the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passledger.llm import embeddings, fingerprints, language, lines, minhash, packing, passages, pieces, planes, prefixes, secrets, shards, whitening
from passledger.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_marked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"))


@query
def op6_hyperdimensional_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


@query
def op7_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_plan(table(spark, sf_dir, "documents"))


@query
def op8_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_files(table(spark, sf_dir, "documents"))


@query
def op9_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op10_keep_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


ORACLES["op10_keep_bitmaps"] = """
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op4_stable_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op13_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(table(spark, sf_dir, "documents"))


@query
def op11_parentheses_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_parentheses_trie"] = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), bits0 AS (
  SELECT range AS b, range AS v FROM range(256)
), bits1 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits0
), bits2 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits1
), bits3 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits2
), bits4 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits3
), bits5 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits4
), bits6 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits5
), bits7 AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits6
), crc_table AS (SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM bits7
), digits AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS t FROM turns GROUP BY conv_id
), crc AS (
  SELECT * FROM (
    WITH RECURSIVE step AS (
      SELECT conv_id, t, 0 AS i, 4294967295 AS c FROM digits
      UNION ALL
      SELECT s.conv_id, s.t, s.i + 1, xor(x.v, s.c >> 8) FROM step s
      JOIN crc_table x ON x.b = xor(s.c & 255, CAST(ascii(substring(s.t, s.i + 1, 1)) AS BIGINT))
      WHERE s.i < length(s.t)
    ) SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM step WHERE i = length(t))
), rebuilt AS (
  SELECT c.conv_id, t.k AS place, t.role, t.text FROM crc c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, t.k + 1000000, t.role, t.text FROM crc c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h
), chained AS (
  SELECT conv_id, text, row_number() OVER w AS depth,
         md5(string_agg(md5(role) || md5(text), '' ) OVER w) AS node
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), walks AS (
  SELECT conv_id, depth, node, strlen(text) AS bytes FROM chained UNION ALL SELECT conv_id, 0, '', 0 FROM crc
), stops AS (
  SELECT conv_id, max(depth) AS last FROM walks GROUP BY conv_id
), nodes AS (
  SELECT w.depth, w.node, min(w.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w.bytes) AS weight,
         sha256(coalesce(string_agg(CAST(w.conv_id AS VARCHAR), ',' ORDER BY w.conv_id) FILTER (WHERE w.depth = s.last), '')) AS ends_sha256
  FROM walks w JOIN stops s ON s.conv_id = w.conv_id GROUP BY w.depth, w.node
), above AS (
  SELECT n.depth, n.node, u.conv_id AS parent_conv_id, u.node AS parent_node
  FROM nodes n JOIN walks w ON w.conv_id = n.conv_id AND w.depth = n.depth - 1 JOIN nodes u ON u.depth = w.depth AND u.node = w.node
), children AS (
  SELECT depth - 1 AS depth, parent_node AS node, count(*) AS n_children FROM above GROUP BY depth, parent_node
), sums AS (
  SELECT w.depth, w.node, sum(n.weight) AS saved, count(*) FILTER (WHERE c.node IS NULL) AS leaves
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
  JOIN walks w ON w.conv_id = n.conv_id AND w.depth <= n.depth GROUP BY w.depth, w.node
)
SELECT n.conv_id, n.depth, a.parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN above a ON a.depth = n.depth AND a.node = n.node LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
"""


@query
def op12_secular_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
