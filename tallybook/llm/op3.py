"""Query op3: documents without the lines of recurring templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.line_templates import drop_recurring_lines


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (what stays), lines, dropped (positions, comma-joined) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_recurring_lines(docs).select("doc_id", "text", "lines", F.array_join("dropped", ",").alias("dropped"))
