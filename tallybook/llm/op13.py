"""Query op13: passages of fifty words or more that an earlier document has too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.repeated_passages import without_repeats


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of `documents`."""
    kept = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
runs AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM cut WHERE len(ws) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM runs),
least AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
late AS (SELECT DISTINCT w.doc_id, w.i FROM windows w JOIN least l ON w.h = l.h AND w.doc_id > l.low),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS places FROM late GROUP BY doc_id),
kept AS (SELECT c.doc_id, ws, coalesce(places, []) AS places, list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(coalesce(places, []), k)) AS stay FROM cut c LEFT JOIN gone g ON g.doc_id = c.doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - len(stay) AS n_removed, sha256(array_to_string(list_transform(stay, lambda k: ws[k]), ' ')) AS kept_sha256 FROM kept
"""
