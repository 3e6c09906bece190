"""Query op5: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.line_blocks import extract_main_text


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
