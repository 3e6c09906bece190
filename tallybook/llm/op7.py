"""Query op7: benchmark items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.decontamination import contained_items


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, shared, item_size for every document that contains four fifths of an item's shingles."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, items)


ORACLE = r"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark),
runs AS (
  SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM cut WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT kind, id, array_to_string(ws[i:i+4], ' ') AS h FROM runs),
sizes AS (SELECT id, count(*) AS q FROM shingles WHERE kind = 'i' GROUP BY id),
met AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM shingles d JOIN shingles b ON d.kind = 'd' AND b.kind = 'i' AND d.h = b.h GROUP BY d.id, b.id)
SELECT doc_id, item_id, shared, q AS item_size FROM met JOIN sizes ON item_id = id WHERE 10 * shared >= 8 * q
"""
