"""Query op11: a quarter of the documents drawn towards the benchmark's distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.importance_resampling import resampled


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: the table of the polynomial from its rule, then a fold over the bytes.
CRC32 = r"""
table_of_bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
hashed AS (
  SELECT f, xor(4294967295::BIGINT, list_reduce(
    list_transform(range(1, len(hex(f)) + 1, 2), lambda i: 16 * (instr('0123456789ABCDEF', hex(f)[i]) - 1) + instr('0123456789ABCDEF', hex(f)[i + 1]) - 1),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) AS crc
  FROM (SELECT DISTINCT f FROM to_hash), table_of_bytes)"""

ORACLE = rf"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (
  SELECT kind, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM cut),
to_hash AS (SELECT f FROM features),
{CRC32},
counted AS (SELECT kind, r, crc % 10000 AS bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM totals),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
  SELECT id AS doc_id, r, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM cut LEFT JOIN weights USING (r) WHERE kind = 'd'),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS place, 25 * count(*) OVER () // 100 AS k FROM scored WHERE n_words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""
