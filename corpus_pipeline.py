"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

Language ID drops texts without a language; line dedup takes recurring boilerplate out of texts (a text of nothing
else goes); of each near-duplicate class the smallest doc_id stays; documents that hold a benchmark item go; what
is left is packed into bins.

Edge cases: null and blank texts go in the first stage; repeated rows and copies are one class in the third, whose
smallest doc_id stays with all its rows; an empty table gives an empty one after every stage. Columns beyond those of
documents are kept up to the last stage, whatever their names; ties are broken by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.best_fit_packing import pack_documents
from tallybook.llm.decontamination import contained_items
from tallybook.llm.language_mixture import keep_identified, train
from tallybook.llm.line_templates import drop_recurring_lines
from tallybook.llm.near_duplicates import near_duplicates
from tallybook.llm.storage import delete, small_side, stage, unused, write_table, written

#: A document whose foremost language holds less than this share of its words is rejected.
LEAST_SHARE = 0.4
CAPACITY = 16_384


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that are null, have no letter, or have no language of their own."""
    with stage(spark):
        return keep_identified(docs, train(docs), LEAST_SHARE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out recurring lines; n_chars follows the text."""
    with stage(spark):
        held, gone = (unused(name, docs.columns) for name in ("lines", "dropped"))
        cleaned = drop_recurring_lines(docs, lines=held, dropped=gone).where((F.size(gone) == 0) | (F.trim("text") != ""))
        n_chars = F.when(F.size(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")
        return cleaned.withColumn("n_chars", n_chars).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every class of near-duplicates."""
    with stage(spark):
        classes = near_duplicates(docs)
        copies = written(classes.where("component_id <> doc_id").select("doc_id").distinct())
        return docs.join(small_side(copies), "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    with stage(spark):
        found = written(contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
        return docs.join(small_side(found), "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left: doc_id, piece, start, length, source, bin, offset."""
    with stage(spark):
        return pack_documents(docs, CAPACITY)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]

#: Language models and bitmap searches are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages in turn to `documents`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, function in STAGES:
        docs, path = write_table(function(spark, docs, sf_dir))
        if before:
            delete(spark, before)  # the next stage's result is written
        before = path
    return docs
