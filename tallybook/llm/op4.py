"""Query op4: every document packed into bins of 16 KiB, no source or duplicate cluster twice in a bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.best_fit_packing import pack_documents

CAPACITY = 16_384


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, source, bin, offset of every piece of every document."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), CAPACITY)
