"""Query op12: the prefix trie of conversations whose first turns come from their block's first conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.conversation_trie import coded_turns, prefix_trie, with_shared_heads
from tallybook.llm.op11 import CRC32

BLOCK, HEADS = 100, 6


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    turns = coded_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    c = F.col("conv_id")
    kept = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    return prefix_trie(with_shared_heads(turns, c - c % BLOCK, kept, HEADS - 1))


ORACLE = rf"""
WITH to_hash AS (SELECT DISTINCT conv_id::VARCHAR AS f FROM conversations WHERE conv_id IS NOT NULL),
{CRC32},
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT f::BIGINT AS conv_id, crc % 6 AS h FROM hashed),
taken AS (
  SELECT c.conv_id, place, role, text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id - c.conv_id % 100 AND place <= h
  UNION ALL
  SELECT c.conv_id, place, role, text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND place > h),
digests AS (SELECT conv_id, place, md5(length(role) || ':' || role || text) AS k, length(text) AS chars FROM taken),
rebuilt AS (SELECT c.conv_id, coalesce(list(k ORDER BY place) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(chars ORDER BY place) FILTER (k IS NOT NULL), []) AS cs FROM convs c LEFT JOIN digests USING (conv_id) GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, len(ks) AS n, d, ks[1:d] AS p, CASE WHEN d = 0 THEN 0 ELSE cs[d] END AS chars FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
above AS (SELECT unnest(list_transform(range(d + 1), lambda e: p[1:e])) AS p, n_children = 0 AS leaf, (n_convs - 1) * chars AS saved FROM counted),
sums AS (SELECT p, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY p)
SELECT c.conv_id, c.d AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (p) LEFT JOIN nodes u ON u.d = c.d - 1 AND u.p = c.p[1:c.d - 1]
"""
