"""Query op6: license phrases and templates in every document."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.license_scan import PHRASES, scan_licenses
from tallybook.llm.license_templates import TEMPLATES


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of `documents`."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _pattern(template: str) -> str:
    """A template as a regular expression over words that each have a blank on either side."""
    text = re.sub(r"<<var;words=(\d+)-(\d+)>>", r"\\V\1,\2", " ".join(template.split()))
    text = text.replace("<<beginOptional>>", " \\O ").replace("<<endOptional>>", " \\C ")
    parts = {"\\O": "(?:", "\\C": ")?"}
    return "".join(parts.get(w) or (f"(?: [^ ]+ ){{{w[2:]}}}" if w.startswith("\\V") else f" {w} ") for w in text.split())


def _spaced(phrase: str) -> str:
    return f" {'  '.join(phrase.split())} "


def _oracle() -> str:
    """Phrases and templates as searches in the text's words, each with a blank on either side."""
    phrases = ", ".join(f"('{_spaced(p)}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"('{_pattern(t)}', '{label}')" for label, t in TEMPLATES.items())
    return rf"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
j AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, '  ') || ' ' AS t FROM cut),
phrases(p, label, k) AS (VALUES {phrases}),
templates(r, label) AS (VALUES {templates}),
base AS (
  SELECT doc_id, label, len(regexp_extract_all(t, p)) AS n,
         (strpos(t, p) - 1 - length(replace(substr(t, 1, strpos(t, p) - 1), ' ', ''))) // 2 AS first_word,
         n_words - k - (strpos(reverse(t), reverse(p)) - 1 - length(replace(substr(reverse(t), 1, strpos(reverse(t), reverse(p)) - 1), ' ', ''))) // 2 AS last_word
  FROM j JOIN phrases ON contains(t, p)),
accepted AS (SELECT doc_id, label FROM j JOIN templates ON regexp_matches(t, r)),
b AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_base, min(first_word) AS first_word, max(last_word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM accepted) GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(CASE WHEN doc_id IN (SELECT doc_id FROM accepted WHERE NOT label LIKE '%-notice') THEN 1.0 WHEN doc_id IN (SELECT doc_id FROM accepted) THEN 0.75 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM j LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""


ORACLE = _oracle()
